"""A generator that keeps the dependence between columns of any kind
(SURVEY G3, G4): a dependence tree (Chow and Liu, 1968).

Every column is a set of states: the values of a text column, quantile ranges
of a numeric one, and the sentinel. One pass counts the states of all pairs of
columns; mutual information of each pair, from those counts, weighs a graph of
the columns, whose maximum spanning tree is found on the driver (one number a
pair of columns). A new row draws its root column's state from the shares and
every other column's from the shares given its parent's, by keyed uniform
draws, so that rows depend neither on partitions nor on retries. Unlike a
latent correlation, the tables know no order among categories.

Counts and tables stay DataFrames. A table of conditional shares is broadcast
up to BROADCAST_STATES entries and joined by shuffle beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.predicates import DEFAULT_SENTINEL, as_text, is_missing, numeric_value
from tabaudit.functions.rand import hash_uniform
from tabaudit.operators.profile import feature_columns, infer_types
from tabaudit.session import cut_lineage
from tabaudit.spec import CONTINUOUS, COUNT

#: Ranges of a numeric column.
BINS = 16
BROADCAST_STATES = 200_000


@dataclass
class TreeModel:
    """Columns in the order in which they are drawn, with their parents; the
    bounds of numeric ranges; (label, given, value, n) counts of the tree."""
    order: list[tuple[str, str | None]]
    bounds: dict[str, list[float]]
    whole: set[str]              # numeric columns of whole numbers
    dtypes: dict[str, T.DataType]
    counts: DataFrame
    sentinel: str


def numeric_bounds(df: DataFrame, columns: list[str], sentinel=DEFAULT_SENTINEL, bins: int = BINS) -> dict[str, list[float]]:
    """Ascending bounds of about equally full ranges of numeric columns, their
    least and greatest values included (one job)."""
    dt = {f.name: f.dataType for f in df.schema.fields}
    probs = [i / bins for i in range(bins + 1)]
    aggs = [F.percentile_approx(F.when(~is_missing(F.col(c), dt[c], sentinel), numeric_value(F.col(c), dt[c])), probs, 10_000).alias(f"q{i}")
            for i, c in enumerate(columns)]
    row = df.agg(*aggs).first() if columns else {}
    return {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(columns)}


def _state(c: str, t: T.DataType, bounds: dict[str, list[float]], sentinel) -> Column:
    """The state of a cell as text: a value, the number of a range, or the sentinel."""
    if c not in bounds:
        return F.coalesce(as_text(F.col(c), t), F.lit(str(sentinel)))
    inner = bounds[c][1:-1]
    v = numeric_value(F.col(c), t)
    number = F.size(F.filter(F.array(*[F.lit(b) for b in inner]), lambda b: b <= v)) if inner else F.lit(0)
    return F.when(is_missing(F.col(c), t, sentinel), F.lit(str(sentinel))).otherwise(number.cast("string"))


def states(df: DataFrame, model: TreeModel, row_id: str | None = None) -> DataFrame:
    """The states of all columns of ``df``."""
    keep = [F.col(row_id)] if row_id else []
    return df.select(*keep, *[_state(c, model.dtypes[c], model.bounds, model.sentinel).alias(c) for c in model.dtypes])


def pair_counts(held: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, va, vb, n) for all pairs of columns, a before b."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"))
                      for i, a in enumerate(columns) for b in columns[i + 1:]])
    return held.select(F.inline(pairs)).groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(a, b, mi) from pair counts."""
    left = counts.groupBy("a", "b", "va").agg(F.sum("n").alias("na"))
    right = counts.groupBy("a", "b", "vb").agg(F.sum("n").alias("nb"))
    total = counts.groupBy("a", "b").agg(F.sum("n").alias("t"))
    j = counts.join(left, ["a", "b", "va"]).join(right, ["a", "b", "vb"]).join(total, ["a", "b"])
    x = F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("na").cast("double") * F.col("nb")))
    return j.groupBy("a", "b").agg(F.sum(x).alias("mi"))


def spanning_tree(columns: list[str], weights: dict[tuple[str, str], float]) -> list[tuple[str, str | None]]:
    """Columns from the first on, each with the drawn column that it depends on most."""
    order: list[tuple[str, str | None]] = [(columns[0], None)]
    left = list(columns[1:])
    while left:
        _, _, c, p = max((weights.get((p, c), weights.get((c, p), 0.0)), -columns.index(c), c, p) for c in left for p, _ in order)
        order.append((c, p))
        left.remove(c)
    return order


def fit_tree(df: DataFrame, row_id: str | None = "row_id", columns=None, sentinel=DEFAULT_SENTINEL, bins: int = BINS,
             overrides: dict[str, str] | None = None) -> TreeModel:
    """Fit on a table; NULLs are the sentinel. Two passes over the rows after
    the one that infers the types."""
    cols = feature_columns(df, row_id, columns)
    types = {r["label"]: r["type"] for r in infer_types(df, row_id, cols, sentinel, overrides).collect()}     # one row a column
    numbers = [c for c in cols if types[c] in (COUNT, CONTINUOUS)]
    dt = {f.name: f.dataType for f in df.schema.fields}
    bounds = {c: b for c, b in numeric_bounds(df, numbers, sentinel, bins).items() if b}
    model = TreeModel([], bounds, {c for c in numbers if types[c] == COUNT}, {c: dt[c] for c in cols}, None, str(sentinel))
    held = states(df, model)
    if len(cols) == 1:
        model.order = [(cols[0], None)]
        single = held.groupBy(F.col(cols[0]).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        model.counts = cut_lineage(single.select(F.lit(cols[0]).alias("label"), F.lit("").alias("given"), "value", "n"))
        return model
    counts = cut_lineage(pair_counts(held, cols))
    weights = {(r["a"], r["b"]): r["mi"] for r in mutual_information(counts).collect()}     # one row a pair of columns
    model.order = spanning_tree(cols, weights)
    root = model.order[0][0]
    first = counts.where((F.col("a") == root) & (F.col("b") == cols[1])).groupBy(F.col("va").alias("value")).agg(F.sum("n").alias("n"))
    parts = [first.select(F.lit(root).alias("label"), F.lit("").alias("given"), "value", "n")]
    for c, p in model.order[1:]:
        a, b = sorted((c, p), key=cols.index)
        edge = counts.where((F.col("a") == a) & (F.col("b") == b))
        given, value = ("va", "vb") if a == p else ("vb", "va")
        parts.append(edge.select(F.lit(c).alias("label"), F.col(given).alias("given"), F.col(value).alias("value"), "n"))
    tables = parts[0]
    for t in parts[1:]:
        tables = tables.unionByName(t)
    model.counts = cut_lineage(tables)
    return model


def sample_tree(spark: SparkSession, model: TreeModel, n: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """n rows numbered from 0, with the columns and types of the fitted table;
    a number is drawn evenly from its range."""
    by = Window.partitionBy("label", "given")
    upto = F.sum("n").over(by.orderBy("value")) / F.sum("n").over(by)
    shares = model.counts.withColumn("upto", upto).groupBy("label", "given").agg(F.array_sort(F.collect_list(F.struct("upto", "value"))).alias("shares"))
    small = model.counts.count() <= BROADCAST_STATES
    rows = spark.range(n).withColumnRenamed("id", row_id)
    for c, p in model.order:
        table = shares.where(F.col("label") == c).select(F.col("given").alias("_given"), "shares")
        given = F.lit("") if p is None else F.col(f"_s_{p}")
        # the draw is a column before the join, so that it is made once a row and not once a share that it is compared with
        drawn = rows.withColumns({"_given": given, "_u": hash_uniform(seed, "tree", c, F.col(row_id))})
        rows = drawn.join(F.broadcast(table) if small else table, "_given")
        rows = rows.withColumn(f"_s_{c}", F.element_at(F.filter("shares", lambda e: e["upto"] > F.col("_u")), 1)["value"]).drop("_given", "_u", "shares")
    out = [F.col(row_id)]
    for c, t in model.dtypes.items():
        s = F.col(f"_s_{c}")
        if c in model.bounds:
            edge = model.bounds[c]
            edges, at = F.array(*[F.lit(float(x)) for x in edge]), F.when(s != model.sentinel, s).cast("int")
            low, high = F.element_at(edges, at + 1), F.element_at(edges, F.least(at + 2, F.lit(len(edge))))
            v = low + (high - low) * hash_uniform(seed, "tree-in", c, F.col(row_id))
            v = F.bround(v, 0) if c in model.whole else v
            s = F.when(s == model.sentinel, F.lit(float(model.sentinel))).otherwise(v)
        out.append(s.cast(t).alias(c))
    return rows.select(*out)
