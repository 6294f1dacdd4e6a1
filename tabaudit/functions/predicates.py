"""Missing-value and numeric predicates as Column expressions.

Three predicates are kept apart on purpose, because the audit semantics
differ between them:

* ``is_sentinel``  - the value equals the job's sentinel (or is NULL/NaN, our
  extension: SQL NULL and NaN count as the sentinel).
* ``is_missing``   - sentinel, or the empty string. Used to drop values when
  profiling and to choose which cells get a random fill when encoding.
* the missing *flag* written by the encoder uses ``is_sentinel`` only, so an
  empty string is filled but not flagged.

String columns compare against ``str(sentinel)``; numeric columns compare
numerically against ``float(sentinel)`` when the sentinel is numeric.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SENTINEL = "-999999"

# Fixed value: the numeric-literal pattern both Spark and DuckDB accept the
# same way (optional sign, digits with optional fraction, optional exponent).
NUMERIC_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def sentinel_as_float(sentinel) -> float | None:
    try:
        return float(sentinel)
    except (TypeError, ValueError):
        return None


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_sentinel(col: Column, dtype: T.DataType, sentinel=DEFAULT_SENTINEL) -> Column:
    s_float = sentinel_as_float(sentinel)
    if is_numeric_type(dtype):
        cond = col.isNull()
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            cond = cond | F.isnan(col)
        if s_float is not None and not math.isnan(s_float):
            cond = cond | (col.cast("double") == F.lit(s_float))
        return cond
    text = as_text(col, dtype)
    cond = col.isNull() | (text == F.lit(str(sentinel)))
    if s_float is not None and math.isnan(s_float):
        cond = cond | (F.lower(text) == F.lit("nan"))
    return cond


def is_missing(col: Column, dtype: T.DataType, sentinel=DEFAULT_SENTINEL) -> Column:
    cond = is_sentinel(col, dtype, sentinel)
    if not is_numeric_type(dtype):
        cond = cond | (as_text(col, dtype) == F.lit(""))
    return cond


def numeric_value(col: Column, dtype: T.DataType) -> Column:
    """Double value of a cell, or NULL when it does not parse as a number.
    Strings must match NUMERIC_PATTERN first so every engine agrees."""
    if is_numeric_type(dtype):
        return col.cast("double")
    trimmed = F.trim(as_text(col, dtype))
    return F.when(trimmed.rlike(NUMERIC_PATTERN), trimmed.try_cast("double"))


def is_numeric_cell(col: Column, dtype: T.DataType) -> Column:
    if is_numeric_type(dtype):
        return F.lit(True)
    return F.trim(as_text(col, dtype)).rlike(NUMERIC_PATTERN)


def missing_flag(col: Column, dtype: T.DataType, sentinel=DEFAULT_SENTINEL) -> Column:
    """1.0 when the cell is the sentinel, else 0.0 ('' is not flagged)."""
    return F.when(is_sentinel(col, dtype, sentinel), F.lit(1.0)).otherwise(F.lit(0.0))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Text form of a cell used for distinct values / one-hot matching."""
    if isinstance(dtype, T.StringType):
        return col
    return col.cast("string")
