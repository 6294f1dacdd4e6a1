"""Metamorphic checks: results do not depend on partitioning, and a value
holding a third of all rows does not change results or break operators."""

import math

from pyspark.sql import functions as F

from tabaudit.operators import encode as E
from tabaudit.operators import metrics as M
from tabaudit.operators import profile as P
from tabaudit.operators import realism as R
from tabaudit.operators.neighbors import nearest_neighbors
from tabaudit.sources import fixtures as X
from tests.conftest import SF001


def test_frequency_same_under_1_and_8_partitions(spark):
    c = X.cohort(spark, SF001, with_role=True)
    res = []
    for parts in (1, 8):
        enc = R.prepare_stacked(c.repartition(parts), "role", "train", "row_id", X.SENTINEL)
        res.append({r["feature"]: r for r in R.frequency_of(enc).collect()})
    a, b = res
    assert a.keys() == b.keys()
    for k in a:
        for col in ("real_train", "real_test", "synth"):
            assert math.isclose(a[k][col], b[k][col], rel_tol=1e-12, abs_tol=1e-15)


def test_encoding_same_under_repartition(spark):
    c = X.cohort(spark, SF001)
    spec = P.profile(c, "row_id", sentinel=X.SENTINEL)
    one = {r["row_id"]: r["x"] for r in E.encode(c.repartition(1), spec).df.collect()}
    many = {r["row_id"]: r["x"] for r in E.encode(c.repartition(7, "priority"), spec).df.collect()}
    assert one == many


def hot(spark, n=3000):
    # value 'A' holds a third of all rows; the rest are spread out
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("A")).otherwise(F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("cat"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("num"))


def test_profile_with_hot_value(spark):
    df = hot(spark)
    spec = P.profile(df, "row_id")
    assert spec["cat"].type == "categorical" and spec["cat"].unique[0] == "A"
    vc = {r["value"]: r["n"] for r in P.value_counts(df, ["cat"]).collect()}
    assert vc["A"] == 1000 and sum(vc.values()) == 3000
    assert spec["num"].type == "count"


def test_auc_with_hot_score(spark):
    df = hot(spark).select("row_id", F.col("num").alias("s"), (F.col("row_id") % 2).cast("int").alias("y"))
    rows = df.collect()
    pos = [r["s"] for r in rows if r["y"] == 1]
    neg = [r["s"] for r in rows if r["y"] == 0]
    import numpy as np
    p, n = np.array(pos), np.array(neg)
    want = ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))
    assert math.isclose(M.auc(df, "s", "y").first()["auc"], want, rel_tol=1e-12)


def test_nn_with_many_duplicates(spark):
    df = hot(spark, 600).select("row_id", F.array(F.col("num"), F.lit(0.0)).alias("x"))
    out = {r["row_id"]: r["dist"] for r in nearest_neighbors(df, block_rows=64).collect()}
    assert len(out) == 600 and out[0] == 0.0          # duplicates of the hot value
