"""Test-table views built from the driver's parquet tables.

``cohort`` turns ``orders`` into a mixed-type (EHR-like) table: one constant,
one binary (tier H/L), one categorical with injected sentinels, a second categorical, a
count and a continuous column with injected sentinels. Rows are split into
train / test / synthetic stand-in by a keyed hash of the order key, so every
row of the table is used and the split is reproducible in SQL.

Every value here is also written as SQL text (see ``tabaudit.plans.oracle``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.functions.rand import hash_uniform

# Fixed values of the fixture (shared with the oracle SQL).
SEED = 7
SENTINEL = "-999999"
CAT_MISS_RATE = 0.06
CONT_MISS_RATE = 0.05
BINARY_CUT = 250000.0
TIER_NOISE = 0.2          # share of tier labels flipped, so the outcome is not separable
FEATURES = ["constant", "tier", "categorical", "priority", "count", "continuous"]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table; ``columns`` are projected before anything else so the
    scan reads only those columns."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if columns:
        df = df.select(*columns)
    return df


def cohort(spark: SparkSession, sf_dir: str, with_role: bool = True) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority"])
    k = F.col("o_orderkey")
    u = hash_uniform(SEED, "split", k)
    cols = [
        k.alias("row_id"),
        F.lit("helloworld").alias("constant"),
        F.when((F.col("o_totalprice") > F.lit(BINARY_CUT))
               != (hash_uniform(SEED, "tier_noise", k) < F.lit(TIER_NOISE)), F.lit("H"))
         .otherwise(F.lit("L")).alias("tier"),
        F.when(hash_uniform(SEED, "miss_categorical", k) < F.lit(CAT_MISS_RATE), F.lit(SENTINEL))
         .otherwise(F.col("o_orderstatus")).alias("categorical"),
        F.col("o_orderpriority").alias("priority"),
        F.dayofmonth("o_orderdate").cast("double").alias("count"),
        F.when(hash_uniform(SEED, "miss_continuous", k) < F.lit(CONT_MISS_RATE), F.lit(float(SENTINEL)))
         .otherwise(F.col("o_totalprice")).alias("continuous"),
    ]
    if with_role:
        cols.append(F.when(u < F.lit(0.5), F.lit("train"))
                     .when(u < F.lit(0.75), F.lit("test"))
                     .otherwise(F.lit("synth")).alias("role"))
    return o.select(*cols)


def cohort_roles(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = cohort(spark, sf_dir)
    return {r: c.filter(F.col("role") == F.lit(r)).drop("role")
            for r in ("train", "test", "synth")}


def example_dataset(keys: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """The reference's multimodal example table, one row per key of a
    driver table (so it grows with the data): constant, a fair 0/1 column,
    a rare A/B column (B only on the largest key), X/Y/Z, a count in 5..19
    and a uniform continuous value. Deterministic by keyed hash."""
    k = F.col(key)
    top = keys.agg(F.max(key).alias("t")).first()["t"]     # one number
    u = lambda tag: hash_uniform(seed, tag, k)
    return keys.select(k.alias("row_id"),
                       F.lit("helloworld").alias("constant"),
                       F.when(u("binary01") < 0.5, F.lit("0")).otherwise(F.lit("1")).alias("binary01"),
                       F.when(k == F.lit(top), F.lit("B")).otherwise(F.lit("A")).alias("binaryAB"),
                       F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")),
                                    (F.floor(u("categorical") * 3) + 1).cast("int")).alias("categorical"),
                       (F.floor(u("count") * 15) + 5).cast("long").alias("count"),
                       u("continuous").alias("continuous"))
