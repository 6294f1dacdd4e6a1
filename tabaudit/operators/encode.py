"""Encoding and decoding.

``encode`` turns a mixed table into ``(row_id, x array<double>)`` with every
value in [0, 1] (plus the sentinel pass-through of the standalone scaler).
It is one projection over the rows; the only extra job is one aggregate for
the table's own min/max when ``scale_by='self'`` (the default, as the
reference scales test and synthetic tables by their own range).

``decode`` is the inverse projection driven by the spec. Neither shuffles rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.predicates import (DEFAULT_SENTINEL, as_text,
                                           is_missing, is_sentinel,
                                           missing_flag, numeric_value)
from tabaudit.functions.rand import hash_uniform
from tabaudit.spec import (BINARY, CATEGORICAL, CONSTANT, CONTINUOUS, COUNT,
                           EncodingSpec, Feature)


@dataclass
class Encoded:
    """An encoded DataFrame ``(row_id, x)`` with its feature list."""
    df: DataFrame
    features: list[Feature]
    spec: EncodingSpec
    row_id: str = "row_id"
    group_col: str | None = None

    @property
    def labels(self) -> list[str]:
        return [f.label for f in self.features]

    def wide(self, digits: int | None = None) -> DataFrame:
        """One double column per feature, named by the feature label."""
        cols = []
        for i, f in enumerate(self.features):
            c = F.col("x")[i]
            if digits is not None:
                c = F.round(c, digits)
            cols.append(c.alias(f.label))
        keep = [F.col(self.row_id)] + ([F.col(self.group_col)] if self.group_col else [])
        return self.df.select(*keep, *cols)

    def with_df(self, df: DataFrame, group_col: str | None = None) -> "Encoded":
        return Encoded(df, self.features, self.spec, self.row_id, group_col)

    def group(self, value) -> "Encoded":
        """The rows of one group, without the group column."""
        df = self.df.filter(F.col(self.group_col) == F.lit(value)).drop(self.group_col)
        return Encoded(df, self.features, self.spec, self.row_id)


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


# ------------------------------------------------------------ single columns
def one_hot(col: Column, dtype: T.DataType, unique: list[str],
            add_missing_col: bool = False, sentinel=DEFAULT_SENTINEL) -> Column:
    """array<double> one-hot against ``unique`` (positional labels).
    An unseen value gives all zeros. The extra sentinel column is added only
    when the sentinel text is not already one of the categories."""
    text = F.coalesce(as_text(col, dtype), F.lit(str(sentinel)))
    if not unique:
        seg = F.array().cast("array<double>")
    else:
        # one map lookup for the position, then the vector is assembled from
        # array_repeat pieces (built-ins, code-generated; no per-element lambda)
        k = len(unique)
        lookup = F.create_map(*[x for i, u in enumerate(unique) for x in (F.lit(u), F.lit(i + 1))])
        pos = F.element_at(lookup, text)
        zero = F.lit(0.0)
        seg = F.when(pos.isNull(), F.array_repeat(zero, k)).otherwise(
            F.concat(F.array_repeat(zero, pos - 1), F.array(F.lit(1.0)), F.array_repeat(zero, F.lit(k) - pos)))
    if add_missing_col and str(sentinel) not in unique:
        seg = F.concat(seg, F.array(missing_flag(col, dtype, sentinel)))
    return seg


def scale_expr(v: Column, lo, hi) -> Column:
    """(v - lo) / (hi - lo); NULL when the range is empty (ANSI-safe)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo).cast("double")
    hi_c = hi if isinstance(hi, Column) else F.lit(hi).cast("double")
    return F.try_divide(v - lo_c, hi_c - lo_c)


def unscale(v: Column, lo: float, hi: float) -> Column:
    """V * (max - min) + min."""
    return v * F.lit(float(hi) - float(lo)) + F.lit(float(lo))


def numeric_ranges(df: DataFrame, columns: list[str], sentinel=DEFAULT_SENTINEL,
                   group_col: str | None = None) -> dict:
    """min/max of the non-missing numeric values of each column (one job).
    With ``group_col`` the ranges are per group: {group: {col: (lo, hi)}}."""
    if not columns:
        return {}
    dt = _dtypes(df)
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(~is_missing(F.col(c), dt[c], sentinel), numeric_value(F.col(c), dt[c]))
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    if group_col is None:
        row = df.agg(*aggs).first()
        return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    rows = df.groupBy(group_col).agg(*aggs).collect()     # one row a table of the stack
    return {r[group_col]: {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(columns)}
            for r in rows}


def _by_group(group: Column, values: dict, pick) -> Column:
    """CASE group WHEN g THEN pick(values[g]) ... END (few groups)."""
    expr = None
    for g, v in values.items():
        cond = group.isNull() if g is None else (group == F.lit(g))
        val = F.lit(pick(v)).cast("double")
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr if expr is not None else F.lit(None).cast("double")


def min_max_scale(df: DataFrame, columns: list[str], row_id: str = "row_id",
                  sentinel=DEFAULT_SENTINEL, keep_sentinel: bool = True) -> DataFrame:
    """Scale numeric columns to [0, 1] with the column's own range; a
    sentinel cell passes through unchanged (reference behaviour)."""
    dt = _dtypes(df)
    ranges = numeric_ranges(df, columns, sentinel)
    out = [F.col(row_id)]
    s_val = F.lit(float(sentinel))
    for c in columns:
        lo, hi = ranges[c]
        v = numeric_value(F.col(c), dt[c])
        scaled = scale_expr(v, lo, hi)
        if keep_sentinel:
            scaled = F.when(is_sentinel(F.col(c), dt[c], sentinel), s_val).otherwise(scaled)
        out.append(scaled.alias(c))
    return df.select(*out)


def vector_scale(df: DataFrame, column: str, invert: bool = False,
                 out: str | None = None) -> DataFrame:
    """Min-max scale of one numeric column over the whole frame, optionally
    inverted (max -> 0). One small job fetches (min, max)."""
    out = out or column
    st = df.agg(F.min(column).cast("double").alias("lo"),
                F.max(column).cast("double").alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    scaled = F.try_divide(F.col(column).cast("double") - F.lit(lo).cast("double"),
                          F.lit(hi).cast("double") - F.lit(lo).cast("double"))
    if invert:
        scaled = F.lit(1.0) - scaled
    others = [c for c in df.columns if c != out]
    return df.select(*others, scaled.alias(out))


def clip01(x: Column) -> Column:
    """Clip every element of an array to [0, 1]."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


# ----------------------------------------------------------------- encoding
def missing_presence(df: DataFrame, spec: EncodingSpec) -> dict[str, bool]:
    """For require_missing=False: does each column contain any missing cell."""
    dt = _dtypes(df)
    aggs = [F.max(is_missing(F.col(c.label), dt[c.label], spec.sentinel).cast("int"))
            .alias(f"m{i}") for i, c in enumerate(spec.columns)]
    row = df.agg(*aggs).first()
    return {c.label: bool(row[f"m{i}"]) for i, c in enumerate(spec.columns)}


def encode(df: DataFrame, spec: EncodingSpec, row_id: str = "row_id",
           require_missing: bool = True, seed: int = 0, scale_by: str = "self",
           fill_tag: str = "fill", group_col: str | None = None,
           group_ranges: dict | None = None) -> Encoded:
    """Encode every column per its modal type into ``x array<double>``.

    * constant -> 0 (+ flag)
    * continuous / count -> min-max scaled; missing cells get a keyed uniform
      fill (+ flag)
    * categorical -> one-hot over the spec categories (+ missing column)
    * binary -> 1.0 when equal to the minority value; a sentinel cell gets a
      keyed random bit (+ flag)

    ``group_col`` encodes several tables stacked in one frame (e.g. train /
    test / synthetic) in one pass: with ``scale_by='self'`` each group is
    scaled by its own range, and the group column is kept in the output.
    """
    dt = _dtypes(df)
    sent = spec.sentinel
    if require_missing:
        flags: dict[str, bool] | bool = True
    else:
        flags = missing_presence(df, spec)
    numeric_cols = [c.label for c in spec.columns if c.type in (CONTINUOUS, COUNT)]
    if scale_by == "self" and group_col is not None:
        granges = group_ranges or numeric_ranges(df, numeric_cols, sent, group_col)
        g = F.col(group_col)
        ranges = {c: (_by_group(g, granges, lambda r, c=c: r[c][0]),
                      _by_group(g, granges, lambda r, c=c: r[c][1])) for c in numeric_cols}
    elif scale_by == "self":
        ranges = numeric_ranges(df, numeric_cols, sent)
    elif scale_by == "spec":
        ranges = {c.label: (c.min, c.max) for c in spec.columns if c.type in (CONTINUOUS, COUNT)}
    else:
        raise ValueError("scale_by must be 'self' or 'spec'")

    rid = F.col(row_id)
    segments: list[Column] = []
    for c in spec.columns:
        col, t = F.col(c.label), dt[c.label]
        flag = flags if isinstance(flags, bool) else flags[c.label]
        fl = missing_flag(col, t, sent)
        if c.type == CONSTANT:
            seg = [F.lit(0.0)] + ([fl] if flag else [])
            segments.append(F.array(*seg))
        elif c.type in (CONTINUOUS, COUNT):
            lo, hi = ranges[c.label]
            miss = is_missing(col, t, sent)
            number = numeric_value(col, t)
            # a column with one value has an empty range: it encodes to 0
            val = F.coalesce(scale_expr(number, lo, hi), F.when(number.isNotNull(), F.lit(0.0)))
            if flag:
                val = F.when(miss, hash_uniform(seed, fill_tag, c.label, rid)).otherwise(val)
                segments.append(F.array(val, fl))
            else:
                segments.append(F.array(val))
        elif c.type == CATEGORICAL:
            segments.append(one_hot(col, t, c.unique or [], add_missing_col=flag, sentinel=sent))
        elif c.type == BINARY:
            text = as_text(col, t)
            val = F.when(text == F.lit(c.one), F.lit(1.0)).otherwise(F.lit(0.0))
            if flag:
                rnd = F.when(hash_uniform(seed, fill_tag, c.label, rid) < F.lit(0.5),
                             F.lit(1.0)).otherwise(F.lit(0.0))
                val = F.when(is_sentinel(col, t, sent), rnd).otherwise(val)
                segments.append(F.array(val, fl))
            else:
                segments.append(F.array(val))
        else:
            segments.append(F.array(numeric_value(col, t)))
    x = segments[0] if len(segments) == 1 else F.concat(*segments)
    keep = [rid] + ([F.col(group_col)] if group_col is not None else [])
    out = df.select(*keep, x.alias("x"))
    return Encoded(out, spec.features(flags), spec, row_id, group_col)


# ----------------------------------------------------------------- decoding
def argmax_decode(seg: Column, values: list[str], key: Column | None = None, seed: int = 0, tag: str = "tie") -> Column:
    """Value at the position of the segment maximum. Of equal maxima the
    first is taken, or with ``key`` (a column that names the row) one by a
    keyed draw, each with the same chance."""
    if key is None:
        pos = F.array_position(seg, F.array_max(seg))
    else:
        top = F.array_max(seg)
        equal = F.filter(F.sequence(F.lit(1), F.lit(len(values))), lambda i: F.element_at(seg, i) == top)
        pos = F.element_at(equal, F.floor(hash_uniform(seed, tag, key) * F.size(equal)).cast("int") + 1)
    return F.element_at(F.array(*[F.lit(v) for v in values]), pos.cast("int"))


def plain_text(v: Column) -> Column:
    """A double as text in plain digits: large and small numbers, which a cast
    writes with an exponent, go through a decimal."""
    text = v.cast("string")
    digits = F.regexp_replace(v.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1")
    return F.when(text.contains("E"), F.coalesce(F.regexp_replace(digits, r"\.$", ".0"), text)).otherwise(text)


def decode(enc: Encoded, missing_threshold: float = 1.0) -> DataFrame:
    """Restore the original columns from an encoding.

    A flag at or above ``missing_threshold`` (default exactly 1) restores the
    sentinel; counts are rounded half-to-even; binary values round
    half-to-even, so 0.5 restores the majority value. Numeric input columns
    come back as double, text columns as text.
    """
    spec = enc.spec
    sent = spec.sentinel
    pos = {}
    for i, f in enumerate(enc.features):
        pos.setdefault(f.source, []).append((i, f))
    x = F.col("x")
    out = [F.col(enc.row_id)]
    for c in spec.columns:
        fs = pos.get(c.label, [])
        val_idx = [i for i, f in fs if f.role == "value"]
        flag_idx = [i for i, f in fs if f.role == "flag"]
        is_flag = (x[flag_idx[0]] >= F.lit(missing_threshold)) if flag_idx else F.lit(False)
        numeric_out = c.numeric_input
        s_out = F.lit(float(sent)) if numeric_out else F.lit(str(sent))
        if c.type == CONSTANT:
            z = F.lit(c.zero)
            z = z.cast("double") if numeric_out else z
            col = F.when(is_flag, s_out).otherwise(z)
        elif c.type in (CONTINUOUS, COUNT):
            v = unscale(x[val_idx[0]], c.min, c.max)
            if c.type == COUNT:
                v = F.bround(v, 0)
            v = v if numeric_out else plain_text(v)
            col = F.when(is_flag, s_out).otherwise(v)
        elif c.type == CATEGORICAL:
            idx = [i for i, _ in fs]
            values = list(c.unique or [])
            if any(f.role == "missing_onehot" for _, f in fs):
                values.append(str(sent))
            seg = F.slice(x, idx[0] + 1, len(idx)) if idx else F.array()
            col = argmax_decode(seg, values)
            if numeric_out:
                col = col.cast("double")
        elif c.type == BINARY:
            one = F.lit(c.one).cast("double") if numeric_out else F.lit(c.one)
            zero = F.lit(c.zero).cast("double") if numeric_out else F.lit(c.zero)
            col = (F.when(is_flag, s_out)
                    .when(F.bround(x[val_idx[0]], 0) == F.lit(1.0), one)
                    .otherwise(zero))
        else:
            col = x[val_idx[0]]
        out.append(col.alias(c.label))
    return enc.df.select(*out)


def split_outcome(enc: Encoded, outcome: str) -> tuple[DataFrame, list[Feature]]:
    """(row_id, y int, x without the outcome column). The outcome is the
    feature labelled ``outcome`` or ``outcome__outcome``; its missing flag
    stays a feature, as in the reference."""
    labels = enc.labels
    d = enc.spec.delim
    if outcome in labels:
        k = labels.index(outcome)
    elif f"{outcome}{d}{outcome}" in labels:
        k = labels.index(f"{outcome}{d}{outcome}")
    else:
        raise KeyError(f"outcome {outcome!r} is not an encoded feature")
    feats = [f for i, f in enumerate(enc.features) if i != k]
    x = F.col("x")
    d = len(enc.features)
    rest = F.concat(F.slice(x, 1, k), F.slice(x, k + 2, max(d - k - 1, 0)))
    keep = [F.col(enc.group_col)] if enc.group_col else []
    df = enc.df.select(F.col(enc.row_id), *keep, F.bround(x[k], 0).cast("int").alias("y"),
                       rest.alias("x"))
    return df, feats
