"""tabaudit: profile, encode, generate and audit mixed-type tables on Spark.

Public functions take and return DataFrames. The only driver-side object is
``EncodingSpec`` (one entry per input column), which is bounded by the number
of columns, never by the number of rows.
"""

from tabaudit.spec import ColumnSpec, EncodingSpec

__all__ = ["ColumnSpec", "EncodingSpec"]
