"""Encoding with dictionaries of any size.

``encode`` writes a dense vector and keeps the categories of a column on the
driver. Here the categories of all columns are one DataFrame, the dictionary
(label, value, pos, n), ordered without any column meeting in one task, and a
row is encoded as its non-zero entries. Both directions are joins with the
dictionary: values that more than one row in HOT_SHARE has are broadcast (there
are at most HOT_SHARE a column), all others are joined by shuffle, so that a
value of a third of all rows stays where it is.

Columns of count and continuous type are scaled to [0, 1] and have two entries
(the value, 0 left out; the missing flag); all others, two-valued and constant
ones included, have one entry a row, the place of their value. A NULL counts as
the sentinel, which is a value like any other there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.predicates import DEFAULT_SENTINEL, as_text, is_missing, missing_flag, numeric_value
from tabaudit.functions.rand import hash_uniform
from tabaudit.operators.encode import numeric_ranges, scale_expr
from tabaudit.operators.profile import feature_columns, infer_types, value_counts
from tabaudit.session import cut_lineage
from tabaudit.spec import CONTINUOUS, COUNT

HOT_SHARE = 10_000


@dataclass
class SparseSpec:
    """What the driver holds: one line a column; the dictionary is a table."""
    types: dict[str, str]
    dtypes: dict
    ranges: dict[str, tuple[float, float]]
    offsets: dict[str, int]
    width: int
    rows: int
    dictionary: DataFrame   # label, value, pos, n
    sentinel: str

    @property
    def numbers(self) -> list[str]:
        return [c for c, t in self.types.items() if t in (COUNT, CONTINUOUS)]

    @property
    def texts(self) -> list[str]:
        return [c for c, t in self.types.items() if t not in (COUNT, CONTINUOUS)]

    def hot(self):
        return F.col("n") * HOT_SHARE > self.rows


def value_dictionary(df: DataFrame, columns: list[str], sentinel=DEFAULT_SENTINEL) -> DataFrame:
    """(label, value, pos, n): the distinct values of every column with their
    place in UTF-8 order, from 0, and their rows; written once."""
    from tabaudit.operators.prefix import row_index
    counts = value_counts(df, columns, sentinel).groupBy("label", "value").agg(F.sum("n").alias("n"))
    placed = cut_lineage(row_index(counts.withColumn("_key", F.struct("label", "value")), "_key", name="_at"))
    first = placed.groupBy("label").agg(F.min("_at").alias("_first"))
    return cut_lineage(placed.join(first, "label").select("label", "value", (F.col("_at") - F.col("_first")).alias("pos"), "n"))


def sparse_spec(df: DataFrame, row_id: str = "row_id", columns=None, sentinel=DEFAULT_SENTINEL,
                overrides: dict[str, str] | None = None) -> SparseSpec:
    """Types of all columns, ranges of the numeric ones, dictionary of the others."""
    cols = feature_columns(df, row_id, columns)
    found = infer_types(df, row_id, cols, sentinel, overrides)
    types = {r["label"]: r["type"] for r in found.collect()}     # one row a column
    types = {c: types[c] for c in cols}
    spec = SparseSpec(types, {f.name: f.dataType for f in df.schema.fields}, {}, {}, 0, 0, None, str(sentinel))
    spec.ranges = numeric_ranges(df, spec.numbers, sentinel)
    if spec.texts:
        spec.dictionary = value_dictionary(df, spec.texts, sentinel)
        per = {r["label"]: r for r in spec.dictionary.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
        spec.rows = max(r["n"] for r in per.values()) if per else 0
    for c in cols:
        spec.offsets[c] = spec.width
        spec.width += 2 if c in spec.numbers else (per[c]["k"] if c in per else 0)
    return spec


def _by_dictionary(rows: DataFrame, dictionary: DataFrame, keys: list[str], hot) -> DataFrame:
    """``rows`` joined with the dictionary, its frequent values broadcast."""
    frequent, rare = dictionary.where(hot), dictionary.where(~hot)
    extra = [c for c in dictionary.columns if c not in keys]
    near = rows.join(F.broadcast(frequent), keys, "left")
    known = near.where(F.col("n").isNotNull())
    other = near.where(F.col("n").isNull()).drop(*extra).join(rare, keys)
    return known.unionByName(other)


def encode_sparse(df: DataFrame, spec: SparseSpec, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """(row_id, label, pos, index, value): the non-zero entries of every row;
    ``index`` is the place in the whole vector of ``spec.width``. A value that
    the dictionary has not seen has no entry."""
    rid, parts = F.col(row_id), []
    if spec.texts:
        cells = F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(as_text(F.col(c), spec.dtypes[c]), F.lit(spec.sentinel)).alias("value"))
                          for c in spec.texts])
        long = df.select(rid, F.inline(cells))
        found = _by_dictionary(long, spec.dictionary, ["label", "value"], spec.hot())
        parts.append(found.select(row_id, "label", F.col("pos").cast("long").alias("pos"), F.lit(1.0).alias("value")))
    if spec.numbers:
        cells = []
        for c in spec.numbers:
            t, (lo, hi) = spec.dtypes[c], spec.ranges[c]
            v = numeric_value(F.col(c), t)
            scaled = F.coalesce(scale_expr(v, lo, hi), F.when(v.isNotNull(), F.lit(0.0)))
            filled = F.when(is_missing(F.col(c), t, spec.sentinel), hash_uniform(seed, "fill", c, rid)).otherwise(scaled)
            cells += [F.struct(F.lit(c).alias("label"), F.lit(0).cast("long").alias("pos"), filled.alias("value")),
                      F.struct(F.lit(c).alias("label"), F.lit(1).cast("long").alias("pos"), missing_flag(F.col(c), t, spec.sentinel).alias("value"))]
        parts.append(df.select(rid, F.inline(F.array(*cells))).where("value <> 0"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    offset = F.create_map(*[F.lit(x) for c, o in spec.offsets.items() for x in (c, o)])
    return out.withColumn("index", F.element_at(offset, F.col("label")) + F.col("pos"))


def to_vectors(entries: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, indices, values): one sparse vector a row, by ascending index;
    a row has at most two entries a column."""
    pairs = F.array_sort(F.collect_list(F.struct("index", "value")))
    return entries.groupBy(row_id).agg(pairs.alias("p")).select(row_id, F.col("p.index").alias("indices"), F.col("p.value").alias("values"))


def decode_sparse(entries: DataFrame, spec: SparseSpec, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The table from entries (row_id, label, pos, value) of the rows in
    ``rows`` (row_id): of a column with a dictionary the value with the largest
    entry, the first of equal ones; numbers unscaled, counts rounded half to
    even; the sentinel where the missing flag is at least 1. Texts come back as
    text, numbers as doubles; a text column without an entry is NULL."""
    columns = rows.select(row_id)
    if spec.texts:
        mine = entries.where(F.col("label").isin(spec.texts))
        best = mine.groupBy(row_id, "label").agg(F.min(F.struct((-F.col("value")).alias("v"), "pos"))["pos"].alias("pos"))
        named = _by_dictionary(best, spec.dictionary.withColumn("pos", F.col("pos").cast("long")), ["label", "pos"], spec.hot())
        wide = named.groupBy(row_id).agg(*[F.max(F.when(F.col("label") == c, F.col("value"))).alias(c) for c in spec.texts])
        columns = columns.join(wide, row_id, "left")
    if spec.numbers:
        aggs = [F.max(F.when((F.col("label") == c) & (F.col("pos") == i), F.col("value"))).alias(f"_{k}_{i}")
                for k, c in enumerate(spec.numbers) for i in (0, 1)]
        wide = entries.where(F.col("label").isin(spec.numbers)).groupBy(row_id).agg(*aggs)
        columns = columns.join(wide, row_id, "left")
        for k, c in enumerate(spec.numbers):
            lo, hi = spec.ranges[c]
            v = F.coalesce(F.col(f"_{k}_0"), F.lit(0.0)) * F.lit(float(hi) - float(lo)) + F.lit(float(lo))
            v = F.bround(v, 0) if spec.types[c] == COUNT else v
            columns = columns.withColumn(c, F.when(F.col(f"_{k}_1") >= 1.0, F.lit(float(spec.sentinel))).otherwise(v)).drop(f"_{k}_0", f"_{k}_1")
    return columns.select(row_id, *spec.types)
