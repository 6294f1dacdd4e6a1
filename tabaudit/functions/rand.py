"""Keyed, partition-independent randomness.

Every random draw is a pure function of (seed, tag, key...), so a result does
not depend on partitioning, task retries or executor loss, and the same
number can be produced in any SQL engine with md5:

    u = int(first 8 hex digits of md5("seed|tag|key...")) / 2**32   in [0, 1)

``sql_uniform`` renders the identical expression as SQL text for an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _part(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def hash_int(*parts) -> Column:
    """32-bit unsigned integer from md5 of the '|'-joined parts (as bigint)."""
    key = F.concat_ws("|", *[_part(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) keyed by the parts."""
    return hash_int(*parts).cast("double") / F.lit(TWO_32)


def hash_bit(*parts, p: float | Column = 0.5) -> Column:
    """1.0 with probability ``p`` else 0.0."""
    pc = p if isinstance(p, Column) else F.lit(float(p))
    return F.when(hash_uniform(*parts) < pc, F.lit(1.0)).otherwise(F.lit(0.0))


def sql_uniform(*parts: str) -> str:
    """SQL text (DuckDB/Spark) for ``hash_uniform``; parts are SQL expressions."""
    return ("(CAST(('0x' || substr(md5(concat_ws('|', "
            + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
            + ")), 1, 8)) AS BIGINT) / 4294967296.0)")


def sql_lit(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"
