"""Profiling operators: numeric test, missing handling,
minority class, modal type inference and the column metadata record.

Plan (two small jobs, rows never leave the executors):

1. one ``agg`` over all columns at once (partial aggregation map-side):
   non-missing count, all-numeric flag, numeric min/max, max |v - rint(v)|,
   sentinel count, min/max of the text form and an HLL distinct estimate.
2. only for columns whose distinct count can matter (estimate near max_uniq,
   or non-numeric text that becomes a category list), one
   ``groupBy(label, value).count()`` over an exploded (label, value) pair;
   map-side combine bounds the shuffle by distinct pairs per partition, so a
   value holding a third of all rows costs one row per map task.

The driver receives at most (#columns x 9) numbers from job 1 and at most
the distinct values of text columns as rows from job 2.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.predicates import (DEFAULT_SENTINEL, as_text,
                                           is_missing, is_numeric_cell,
                                           is_sentinel, missing_flag,
                                           numeric_value)
from tabaudit.session import cut_lineage
from tabaudit.spec import (BINARY, CATEGORICAL, CONSTANT, CONTINUOUS, COUNT,
                           ColumnSpec, EncodingSpec)

# The distinct estimate has rsd 0.05: twice max_uniq is far beyond its error,
# so that columns above need no exact pass.

#: Categories of one column; its one-hot vector and the spec on the driver have as many entries.
MAX_CATEGORIES = 100_000

def feature_columns(df: DataFrame, row_id: str | None, columns: Iterable[str] | None = None):
    if columns is not None:
        return list(columns)
    return [c for c in df.columns if c != row_id]


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


# ---------------------------------------------------------------- row-level
def remove_missing(df: DataFrame, column: str, sentinel=DEFAULT_SENTINEL) -> DataFrame:
    """Rows whose ``column`` is not missing (sentinel, '' , NULL, NaN)."""
    dt = _dtypes(df)[column]
    return df.filter(~is_missing(F.col(column), dt, sentinel))


def missing_rows(df: DataFrame, row_id: str, columns=None,
                 sentinel=DEFAULT_SENTINEL) -> DataFrame:
    """(row_id, label) for every missing cell, long format."""
    cols = feature_columns(df, row_id, columns)
    dt = _dtypes(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("label"),
                               is_missing(F.col(c), dt[c], sentinel).alias("m"))
                      for c in cols])
    return (df.select(F.col(row_id), F.explode(pairs).alias("p"))
              .filter(F.col("p.m"))
              .select(row_id, F.col("p.label").alias("label")))


def missing_indicator(df: DataFrame, row_id: str, columns=None,
                      sentinel=DEFAULT_SENTINEL, suffix: str = "__missing") -> DataFrame:
    """One 0/1 flag column per input column (sentinel only, '' is 0)."""
    cols = feature_columns(df, row_id, columns)
    dt = _dtypes(df)
    return df.select(F.col(row_id),
                     *[missing_flag(F.col(c), dt[c], sentinel).alias(c + suffix) for c in cols])


# --------------------------------------------------------------- aggregates
def _pass1(df: DataFrame, cols: list[str], sentinel, group_col: str | None = None):
    """One aggregate over all columns. With ``group_col`` the statistics are
    per group: {group: {column: stats}} (one job for several tables)."""
    dt = _dtypes(df)
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        col, t = F.col(c), dt[c]
        miss = is_missing(col, t, sentinel)
        v = F.when(~miss, numeric_value(col, t))
        txt = F.when(~miss, as_text(col, t))
        aggs += [
            F.count(txt).alias(f"n_{i}"),
            F.bool_and(F.when(~miss, is_numeric_cell(col, t))).alias(f"num_{i}"),
            F.min(v).alias(f"vmin_{i}"),
            F.max(v).alias(f"vmax_{i}"),
            F.max(F.abs(v - F.rint(v))).alias(f"dev_{i}"),
            F.sum(is_sentinel(col, t, sentinel).cast("long")).alias(f"sent_{i}"),
            F.min(txt).alias(f"tmin_{i}"),
            F.max(txt).alias(f"tmax_{i}"),
            F.approx_count_distinct(txt, 0.05).alias(f"hll_{i}"),
        ]
    def unpack(row):
        out = {}
        for i, c in enumerate(cols):
            num = row[f"num_{i}"]
            out[c] = dict(n=row[f"n_{i}"], numeric=True if num is None else bool(num),
                          vmin=row[f"vmin_{i}"], vmax=row[f"vmax_{i}"], dev=row[f"dev_{i}"],
                          sent=row[f"sent_{i}"] or 0, tmin=row[f"tmin_{i}"],
                          tmax=row[f"tmax_{i}"], hll=row[f"hll_{i}"])
        return out
    if group_col is None:
        return unpack(df.agg(*aggs).first())
    rows = df.groupBy(group_col).agg(*aggs).collect()     # one row a table of the stack
    return {r[group_col]: unpack(r) for r in rows}


def value_counts(df: DataFrame, cols: list[str], sentinel=DEFAULT_SENTINEL) -> DataFrame:
    """(label, value, missing, n) for every raw value of the given columns.
    NULL is reported as the sentinel text."""
    dt = _dtypes(df)
    pairs = F.array(*[F.struct(
        F.lit(c).alias("label"),
        F.coalesce(as_text(F.col(c), dt[c]), F.lit(str(sentinel))).alias("value"),
        is_missing(F.col(c), dt[c], sentinel).alias("missing")) for c in cols])
    return (df.select(F.explode(pairs).alias("p"))
              .groupBy(F.col("p.label").alias("label"), F.col("p.value").alias("value"),
                       F.col("p.missing").alias("missing"))
              .agg(F.count(F.lit(1)).alias("n")))


def minority_class(df: DataFrame, columns: list[str], sentinel=DEFAULT_SENTINEL) -> DataFrame:
    """P5: (label, minority, majority) for two-valued columns; ties go to the
    value that sorts first. Stays a DataFrame (one row per column)."""
    vc = value_counts(df, columns, sentinel).filter(~F.col("missing"))
    ranked = vc.groupBy("label").agg(
        F.min_by(F.col("value"), F.struct(F.col("n"), F.col("value"))).alias("minority"),
        F.max_by(F.col("value"), F.struct(F.col("n"), F.col("value"))).alias("majority"),
        F.count(F.lit(1)).alias("n_values"))
    return ranked.select("label", "minority", "majority", "n_values")


def _decide_type(label, s, exact_n, overrides, max_uniq, max_diff) -> str:
    o = overrides.get(label)
    if o in (CATEGORICAL, CONTINUOUS, COUNT, CONSTANT, BINARY):
        return o
    n_uniq = exact_n
    if n_uniq is None:      # the estimate is far above max_uniq
        n_uniq = max_uniq + 1
    if n_uniq == 1:
        return CONSTANT
    if n_uniq == 2:
        return BINARY
    if n_uniq > max_uniq and s["numeric"]:
        return CONTINUOUS if (s["dev"] or 0.0) > max_diff else COUNT
    return CATEGORICAL


def profile(df: DataFrame, row_id: str | None = "row_id", columns=None,
            sentinel=DEFAULT_SENTINEL, overrides: dict[str, str] | None = None,
            max_uniq: int = 10, max_diff: float = 1e-10, max_categories: int = MAX_CATEGORIES, _stats: dict | None = None) -> EncodingSpec:
    """P6 + P7: infer the modal type of every column and collect metadata."""
    cols = feature_columns(df, row_id, columns)
    overrides = dict(overrides or {})
    dt = _dtypes(df)
    stats = _stats if _stats is not None else _pass1(df, cols, sentinel)

    exact_cols = []
    for c in cols:
        s = stats[c]
        if s["n"] == 0 or s["tmin"] == s["tmax"]:
            continue
        candidate_cat = (not s["numeric"]) or overrides.get(c) == CATEGORICAL
        # the estimate is off by some percent: counts are exact wherever max_uniq might not be passed
        if s["hll"] <= 2 * max_uniq + 16 or (candidate_cat and overrides.get(c) not in (CONTINUOUS, COUNT)):
            exact_cols.append(c)

    counts: dict[str, list] = {c: [] for c in exact_cols}
    if exact_cols:
        found = cut_lineage(value_counts(df, exact_cols, sentinel))
        for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():     # one row a column
            if r["n"] > max_categories:
                raise ValueError(f"column {r['label']!r} has {r['n']} distinct values to one-hot encode; "
                                 f"max_categories is {max_categories}")
        for r in found.collect():   # at most max_categories a column
            counts[r["label"]].append((r["value"], bool(r["missing"]), r["n"]))

    specs = []
    for pos, c in enumerate(cols):
        s = stats[c]
        if s["n"] == 0:
            exact_n = 0
        elif s["tmin"] == s["tmax"]:
            exact_n = 1
        elif c in counts:
            exact_n = sum(1 for _, m, _ in counts[c] if not m)
        else:
            exact_n = None
        typ = _decide_type(c, s, exact_n, overrides, max_uniq, max_diff)
        cs = ColumnSpec(label=c, pos=pos, type=typ, dtype=dt[c].simpleString(),
                        missing=s["sent"] > 0)
        if typ == BINARY:
            present = sorted((v, n) for v, m, n in counts.get(c, []) if not m)
            if len(present) >= 2:
                (v0, n0), (v1, n1) = present[0], present[1]
                cs.one, cs.zero = (v0, v1) if n0 <= n1 else (v1, v0)
        elif typ == CONSTANT:
            cs.zero = s["tmin"]
        elif typ in (CONTINUOUS, COUNT):
            cs.min, cs.max = s["vmin"], s["vmax"]
        elif typ == CATEGORICAL:
            if c not in counts:
                counts[c] = [(r["value"], bool(r["missing"]), r["n"])
                             for r in value_counts(df, [c], sentinel).collect()]
            vals = sorted({v for v, _, _ in counts[c]}, key=lambda x: x.encode("utf-8"))
            cs.unique = vals
        specs.append(cs)
    return EncodingSpec(specs, str(sentinel))


def infer_types(df: DataFrame, row_id: str | None = "row_id", columns=None, sentinel=DEFAULT_SENTINEL,
                overrides: dict[str, str] | None = None, max_uniq: int = 10, max_diff: float = 1e-10) -> DataFrame:
    """(label, type) of every column, without the lists of categories, so
    that columns of any number of distinct values have a type. Distinct values
    are counted exactly only where the estimate is near ``max_uniq``."""
    cols = feature_columns(df, row_id, columns)
    stats = _pass1(df, cols, sentinel)
    near = [c for c in cols if stats[c]["n"] and stats[c]["tmin"] != stats[c]["tmax"] and stats[c]["hll"] <= 2 * max_uniq + 16]
    exact = {}
    if near:
        found = value_counts(df, near, sentinel).where(~F.col("missing")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        exact = {r["label"]: r["n"] for r in found.collect()}     # one row a column
    rows = []
    for c in cols:
        s = stats[c]
        n = 0 if s["n"] == 0 else 1 if s["tmin"] == s["tmax"] else exact.get(c)
        rows.append((c, _decide_type(c, s, n, dict(overrides or {}), max_uniq, max_diff)))
    return df.sparkSession.createDataFrame(rows, "label string, type string")


def numeric_test(df: DataFrame, row_id: str | None = "row_id", columns=None,
                 sentinel=DEFAULT_SENTINEL) -> DataFrame:
    """P1 over every non-missing cell: (label, is_numeric). Deliberate change
    from a first-element test: all rows decide. One aggregate pass."""
    cols = feature_columns(df, row_id, columns)
    dt = _dtypes(df)
    aggs = [F.coalesce(F.bool_and(F.when(~is_missing(F.col(c), dt[c], sentinel),
                                         is_numeric_cell(F.col(c), dt[c]))),
                       F.lit(True)).alias(f"c{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"c{i}").alias("is_numeric"))
                      for i, c in enumerate(cols)])
    return wide.select(F.inline(pairs))


def profile_groups(df: DataFrame, group_col: str, train, row_id: str | None = "row_id",
                   columns=None, sentinel=DEFAULT_SENTINEL, **kw):
    """Profile the ``train`` group of a stacked frame and return, from the
    same first pass, every group's (min, max) of each numeric column:
    (spec, {group: {column: (min, max)}})."""
    cols = feature_columns(df.drop(group_col), row_id, columns)
    per = _pass1(df, cols, sentinel, group_col)
    train_rows = df.filter(F.col(group_col) == F.lit(train)).drop(group_col)
    spec = profile(train_rows, row_id, cols, sentinel, _stats=per.get(train), **kw)
    ranges = {g: {c: (st[c]["vmin"], st[c]["vmax"]) for c in cols} for g, st in per.items()}
    return spec, ranges
