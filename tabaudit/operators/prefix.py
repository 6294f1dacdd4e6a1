"""Distributed global prefix sums / ranks.

A window without ``partitionBy`` runs in one task. Instead:

1. range-partition the rows by the ordering key itself, whatever its type, and
   write them with the number of their range; ranges follow the number of keys,
2. total each range (one row a range) and turn the totals into offsets,
3. run the running sum as a window *within* each range, plus the offset.

The ranges are written before they are read, so retries see the same ones.
Rows that share an ordering key always fall into the same range; callers that
need per-key totals aggregate by key first, which also removes any skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.session import cut_lineage

BUCKET = "_bucket"


#: Keys that one window task orders.
BUCKET_KEYS = 100_000


def _bucketize(df: DataFrame, key: str, n_buckets: int | None) -> DataFrame:
    if n_buckets is None:
        n_buckets = -(-df.count() // BUCKET_KEYS)
    if n_buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    return cut_lineage(df.repartitionByRange(n_buckets, key).withColumn(BUCKET, F.spark_partition_id()))


def prefix_sums(df: DataFrame, key: str, values: list[str], descending: bool = False,
                n_buckets: int | None = None, inclusive: bool = True, tiebreak: str | None = None) -> DataFrame:
    """Add ``cum_<v>`` = running sum of each value column in key order
    (ties on key ordered by ``tiebreak``). Returns all input columns. The number
    of buckets follows the number of rows unless given."""
    b = _bucketize(df, key, n_buckets)
    order_key = F.col(key).desc() if descending else F.col(key).asc()
    bucket_order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    totals = b.groupBy(BUCKET).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_small = Window.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BUCKET, *[F.coalesce(F.sum(f"_t_{v}").over(w_small), F.lit(0))
                                      .alias(f"_o_{v}") for v in values])
    orders = [order_key] + ([F.col(tiebreak).asc()] if tiebreak else [])
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy(BUCKET).orderBy(*orders).rowsBetween(*frame)
    joined = b.join(offsets, on=BUCKET, how="inner")
    out = joined.select(*df.columns, *[
        (F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values])
    return out


def row_index(df: DataFrame, key: str, n_buckets: int | None = None, name: str = "idx") -> DataFrame:
    """1-based position of each row in ``key`` order (keys unique)."""
    out = prefix_sums(df.withColumn("_one", F.lit(1)), key, ["_one"], n_buckets=n_buckets)
    return out.withColumnRenamed("cum__one", name).drop("_one")
