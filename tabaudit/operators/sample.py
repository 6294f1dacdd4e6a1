"""Sampling and splitting.

Exact-size selection without a global sort: every row gets a keyed 32-bit
hash; the k rows with the smallest (hash, row_id) are found with two
histogram passes (2**16 buckets each, so the driver sees at most 65,536
counts per pass whatever the table size) and a final filter. Ties on the
full 32-bit hash are settled by row_id among the few rows sharing it.
Nothing depends on partitioning, so retries and executor loss are safe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.rand import hash_int, hash_uniform
from tabaudit.operators.prefix import row_index
from tabaudit.session import cut_lineage

_H = "_h"


def _with_hash(df: DataFrame, row_id: str, seed, tag: str) -> DataFrame:
    return df.withColumn(_H, hash_int(seed, tag, F.col(row_id)))


def _boundary(counts: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """(bucket holding the k-th row, rows needed from it)."""
    before = 0
    for b, n in sorted(counts):
        if before + n >= k:
            return b, k - before
        before += n
    raise ValueError("k larger than the number of rows")


def smallest_k_predicate(df: DataFrame, row_id: str, k: int, seed=0,
                         tag: str = "sample") -> Column | None:
    """Predicate (on a frame carrying the hash column ``_h``) selecting
    exactly the k rows with the smallest (hash, row_id). None means all."""
    h = F.col(_H)
    hi, lo = F.shiftright(h, 16), F.col(_H).bitwiseAND(F.lit(0xFFFF))
    c1 = [(r[0], r[1]) for r in df.groupBy(hi.alias("b")).count().collect()]
    total = sum(n for _, n in c1)
    if k >= total:
        return None
    if k <= 0:
        return F.lit(False)
    b1, r1 = _boundary(c1, k)
    c2 = [(r[0], r[1]) for r in df.filter(hi == F.lit(b1))
          .groupBy(lo.alias("b")).count().collect()]
    b2, r2 = _boundary(c2, r1)
    hb = (b1 << 16) | b2
    # rows sharing the boundary hash: take the r2 smallest row ids
    t = (df.filter(h == F.lit(hb)).select(row_id).orderBy(row_id).limit(r2)
           .agg(F.max(row_id).alias("t")).first()["t"])
    return (h < F.lit(hb)) | ((h == F.lit(hb)) & (F.col(row_id) <= F.lit(t)))


def split_exact(df: DataFrame, frac: float = 0.75, row_id: str = "row_id", seed=0,
                tag: str = "split", rounding: str = "round") -> tuple[DataFrame, DataFrame]:
    """Exactly round(n*frac) (or floor, D2) rows without replacement,
    and the complement (same predicate negated: no join, no extra scan)."""
    n = df.count()
    k = round(n * frac) if rounding == "round" else int(math.floor(frac * n))
    hd = _with_hash(df, row_id, seed, tag)
    pred = smallest_k_predicate(hd, row_id, k, seed, tag)
    if pred is None:
        return df, df.limit(0)
    return hd.filter(pred).drop(_H), hd.filter(~pred).drop(_H)


def set_difference(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (left anti join)."""
    return df.join(other.select(key), on=key, how="left_anti")


def split_proportional(synth: DataFrame, n_train: int, n_test: int, row_id: str = "row_id",
                       seed=0, tag: str = "synth_split") -> tuple[DataFrame, DataFrame]:
    """D3: split a table in the train:test proportion of the real tables."""
    frac = n_train / (n_train + n_test)
    return split_exact(synth, frac, row_id, seed, tag)


def row_cap(df: DataFrame, k: int, row_id: str = "row_id", seed=0,
            tag: str = "cap") -> DataFrame:
    """At most k rows, chosen without replacement by keyed hash."""
    hd = _with_hash(df, row_id, seed, tag)
    pred = smallest_k_predicate(hd, row_id, k, seed, tag)
    return df if pred is None else hd.filter(pred).drop(_H)


def bootstrap(df: DataFrame, row_id: str = "row_id", seed=0, tag: str = "boot") -> DataFrame:
    """Exactly n rows drawn with replacement. Every row makes one draw: a
    keyed uniform names a position in row_id order, and the row there is
    repeated once for each draw that names it. Adds ``copy`` 1..m. Draws are
    counted before the join, so a row's copies are made at the end."""
    placed = cut_lineage(row_index(df, row_id, name="_at"))
    n = placed.count()
    drawn = placed.select((F.floor(hash_uniform(seed, tag, F.col(row_id)) * F.lit(float(n))) + 1).cast("long").alias("_at")) \
        .groupBy("_at").agg(F.count(F.lit(1)).alias("_m"))
    hit = placed.join(drawn, "_at")
    return hit.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int")))).select(*df.columns, "copy")
