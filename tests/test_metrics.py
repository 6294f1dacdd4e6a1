"""Metrics (R12-R19) against brute-force computations on small fixtures."""

import math

import numpy as np

from tabaudit.operators import metrics as M
from tabaudit.operators.prefix import prefix_sums, row_index


def scored(spark, scores, labels):
    return spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))],
                                 "row_id long, s double, y int")


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_with_ties(spark):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 40, 600).astype(float)
    y = (rng.random(600) < 0.3 + s / 100).astype(int)
    got = M.auc(scored(spark, s, y), "s", "y", n_buckets=7).first()["auc"]
    assert math.isclose(got, brute_auc(s, y), rel_tol=1e-12)


def test_auc_label_flip(spark):
    rng = np.random.default_rng(1)
    s, y = rng.random(300), rng.integers(0, 2, 300)
    a = M.auc(scored(spark, s, y), "s", "y").first()["auc"]
    b = M.auc(scored(spark, s, 1 - y), "s", "y").first()["auc"]
    assert math.isclose(a + b, 1.0, rel_tol=1e-12)


def test_auc_one_class_is_null(spark):
    assert M.auc(scored(spark, [0.1, 0.2], [1, 1]), "s", "y").first()["auc"] is None


def test_roc_curve_endpoints_and_collinear_drop(spark):
    s = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
    y = [1, 1, 1, 0, 0, 0]
    pts = sorted((r["fpr"], r["tpr"], r["threshold"]) for r in M.roc_curve(scored(spark, s, y), "s", "y").collect())
    assert pts[0] == (0.0, 0.0, 1.9)
    assert pts[-1][:2] == (1.0, 1.0)
    # perfect ranking: only the corner survives between the end points
    assert (0.0, 1.0, 0.7) in pts and len(pts) == 4
    full = M.roc_curve(scored(spark, s, y), "s", "y", drop_collinear=False).count()
    assert full == 7


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 10, 1000)
    df = spark.createDataFrame([(float(i), int(x)) for i, x in enumerate(v)], "k double, v long")
    got = sorted((r["k"], r["cum_v"]) for r in prefix_sums(df, "k", ["v"], n_buckets=13).collect())
    assert [c for _, c in got] == list(np.cumsum(v))
    idx = sorted((r["k"], r["idx"]) for r in row_index(df, "k", n_buckets=5).collect())
    assert [i for _, i in idx] == list(range(1, 1001))


def test_kl_divergence(spark):
    p = spark.createDataFrame([(0, 0.2), (1, 0.0), (2, 0.8)], "k long, p double")
    q = spark.createDataFrame([(0, 0.4), (1, 0.5), (2, 0.1)], "k long, q double")
    got = M.kl_divergence(p, q, "k").first()["kl"]
    assert math.isclose(got, 0.2 * math.log(0.5) + 0.8 * math.log(8.0))


def test_normal_pdf(spark):
    v = spark.range(1).select(M.normal_pdf(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(1.0))).first()[0]
    assert math.isclose(v, math.exp(-0.5) / math.sqrt(2 * math.pi))


def test_categorical_distance_identical_and_unseen(spark):
    a = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "row_id long, c string")
    assert M.categorical_distance(a, a, ["c"]).first()["distance"] == 0.0
    b = spark.createDataFrame([(i, "z") for i in range(4)], "row_id long, c string")
    # synthetic-only value 'z' is ignored; real has 0.5/0.5
    assert math.isclose(M.categorical_distance(a, b, ["c"]).first()["distance"], math.sqrt(0.5))


def test_reconstruction_bce(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "row_id long, x array<double>")
    o = spark.createDataFrame([(0, [0.9, 0.2]), (1, [0.3, 0.6])], "row_id long, x array<double>")
    e = 1e-12
    want = np.mean([-(math.log(0.9 + e) + math.log(0.8 + e)), -(math.log(0.7 + e) + math.log(0.6 + e))])
    assert math.isclose(M.reconstruction_bce(t, o).first()["loss"], want, rel_tol=1e-12)


def test_threshold_accuracy(spark):
    df = spark.createDataFrame([(0.1, 0), (0.6, 1), (0.5, 0), (0.4, 1)], "p double, y int")
    assert M.threshold_accuracy(df, "p", "y").first()["accuracy"] == 75.0


def test_auc_of_billions_of_rows_a_class(spark):
    counts = spark.createDataFrame([(0.1, 10 ** 9, 3 * 10 ** 9), (0.9, 3 * 10 ** 9, 10 ** 9)], "score double, pos long, neg long")
    assert abs(M.auc_of_counts(counts).first()["auc"] - 0.75) < 1e-9


def test_null_scores_and_unmatched_keys_raise(spark):
    import pytest
    df = spark.createDataFrame([(0.5, 1), (None, 0), (0.2, 0)], "s double, y int")
    with pytest.raises(Exception, match="NULL"):
        M.auc(df, "s", "y")
    p = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k long, p double")
    with pytest.raises(Exception, match="one side only"):
        M.kl_divergence(p, p.where("k = 1").withColumnRenamed("p", "q"), "k").collect()
