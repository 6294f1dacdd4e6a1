"""Realism (R1-R11) and privacy (N4-N10) analyses: the reference's
metamorphic checks plus NumPy solves of the two regression objectives."""

import math

import numpy as np
from pyspark.sql import functions as F

from tabaudit.operators import privacy as PV
from tabaudit.operators import realism as R
from tabaudit.operators.encode import encode
from tabaudit.operators.profile import profile


def matrix_df(spark, m, start=0, prefix="col"):
    cols = [f"{prefix}{j:02d}" for j in range(m.shape[1])]
    rows = [(start + i, *[float(v) for v in r]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in cols))


def test_frequency_identical_tables(spark):
    rng = np.random.default_rng(0)
    m = (rng.random((300, 6)) < 0.3).astype(float)
    df = matrix_df(spark, m)
    f = R.feature_frequency(df, df, df).collect()
    assert all(math.isclose(r["real_train"], r["synth"]) and math.isclose(r["real_test"], r["synth"])
               for r in f)
    c = R.frequency_correlation(R.feature_frequency(df, df, df)).first()
    assert math.isclose(c["corr_train"], 1.0)


def prediction_data(spark, n=600, seed=0, flip=False):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 6)) < 0.5).astype(float)
    beta = np.array([-3, -2, -1, 1, 2, 3], float)
    y = (1 / (1 + np.exp(-(x @ beta - 0.5 + rng.normal(0, 1, n)))) > 0.5).astype(int)
    if flip:
        y = 1 - y
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y int, x array<double>"), x, y


def test_l2_effects_match_numpy_newton(spark):
    xy, x, y = prediction_data(spark)
    coef, b = R.fit_effects(xy, C=1.0)
    X1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(X1.shape[1])
    for _ in range(50):           # Newton on sum logloss + 0.5*||w_features||^2
        p = 1 / (1 + np.exp(-X1 @ w))
        reg = np.r_[w[:-1], 0.0]
        g = X1.T @ (p - y) + reg
        H = X1.T @ (X1 * (p * (1 - p))[:, None]) + np.diag(np.r_[np.ones(6), 0.0])
        w -= np.linalg.solve(H, g)
    assert np.allclose(coef, w[:-1], atol=1e-4) and math.isclose(b, w[-1], abs_tol=1e-4)


def test_l1_liblinear_objective_matches_numpy(spark):
    xy, x, y = prediction_data(spark, seed=3)
    m = R.fit_lr_l1(xy, C=1.0)
    X1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(X1.shape[1])
    L = 0.25 * np.linalg.norm(X1, 2) ** 2
    for _ in range(20000):
        v = w - X1.T @ (1 / (1 + np.exp(-X1 @ w)) - y) / L
        w = np.sign(v) * np.maximum(np.abs(v) - 1 / L, 0)
    assert np.allclose(np.r_[m.w, m.b], w, atol=2e-3)


def test_prediction_auc_same_and_flipped(spark):
    a, _, _ = prediction_data(spark, seed=5)
    b, _, _ = prediction_data(spark, seed=6)
    bf, _, _ = prediction_data(spark, seed=6, flip=True)
    same = R.validate_prediction(a, b, "lr")["auc"].first()["auc"]
    real = R.validate_prediction(b, b, "lr")["auc"].first()["auc"]
    flipped = R.validate_prediction(bf, b, "lr")["auc"].first()["auc"]
    assert abs(same - real) < 0.05 and abs(flipped - real) > 0.05


def test_constant_outcome_returns_none(spark):
    xy = spark.createDataFrame([(i, 1, [float(i % 2)]) for i in range(10)], "row_id long, y int, x array<double>")
    assert R.validate_prediction(xy, xy, "lr") is None


def test_mlp_runs(spark):
    a, _, _ = prediction_data(spark, seed=7)
    res = R.validate_prediction(a, a, "mlp", n_epoch=5)
    assert 0.0 <= res["auc"].first()["auc"] <= 1.0


def test_memorization_real_closer_than_random(spark):
    rng = np.random.default_rng(8)
    real = matrix_df(spark, rng.random((400, 3)))
    synth = matrix_df(spark, rng.random((400, 3)), start=10_000)
    spec = profile(real, "row_id")
    nn = PV.memorization(encode(real, spec), encode(synth, spec))
    m = {r["kind"]: r["mean_dist"] for r in PV.mean_nn(nn).collect()}
    assert set(m) == {"real", "synth", "prob", "rand"} and m["real"] < m["rand"]
    h = PV.distance_histogram(nn, 30)
    assert h.count() == 4 * 30 and h.agg(F.sum("n")).first()[0] == 1600


def test_membership_attack_high_and_no_risk(spark):
    rng = np.random.default_rng(9)
    train = rng.normal(0, 1, (600, 8))
    test_far = rng.normal(100, 1, (600, 8))
    tr, te = matrix_df(spark, train), matrix_df(spark, test_far, start=10_000)
    res = PV.membership_inference(tr, te, tr)        # synthetic = train: high risk
    s = res["scores"].groupBy("label").agg(F.avg("prob").alias("p")).collect()
    p = {r["label"]: r["p"] for r in s}
    assert p[1] - p[0] > 0.05
    test_same = rng.normal(0, 1, (600, 8))
    synth = rng.normal(10, 1, (600, 8))
    res2 = PV.membership_inference(tr, matrix_df(spark, test_same, start=10_000),
                                   matrix_df(spark, synth, start=20_000))
    p2 = {r["label"]: r["p"] for r in res2["scores"].groupBy("label").agg(F.avg("prob").alias("p")).collect()}
    assert abs(p2[1] - p2[0]) < 0.05


def test_constant_outcome_has_no_effects(spark):
    xy, _, _ = prediction_data(spark, seed=11)
    w, b = R.fit_effects(xy.where("y = 1"))
    assert all(math.isnan(v) for v in w) and math.isnan(b)


def test_curves_are_made_on_demand(spark):
    xy, _, _ = prediction_data(spark, seed=11)
    arm = R.validate_prediction(xy, xy)
    assert set(arm) == {"scores"} and 0.5 < arm["auc"].first()["auc"] <= 1.0 and set(arm) == {"scores", "auc"}


def test_column_means_of_wide_and_undefined_features(spark):
    """One path for all widths: means leave undefined values out, and a
    feature without a defined value has no mean."""
    rng = np.random.default_rng(12)
    x = (rng.random((60, 1200)) < 0.4).astype(float)
    x[:30, 3], x[:, 7] = np.nan, np.nan
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "row_id long, g string, x array<double>")

    class Wide:
        labels, group_col = [f"f{i}" for i in range(1200)], "g"
    Wide.df = df
    got = {r["feature"]: (r["m"], r["n"]) for r in R.column_means(Wide, {"a": "m", "b": "n"}).collect()}
    for i in range(1200):
        for k in (0, 1):
            own = x[k::2, i][np.isfinite(x[k::2, i])]
            assert (got[f"f{i}"][k] is None) == (len(own) == 0)
            assert len(own) == 0 or math.isclose(got[f"f{i}"][k], own.mean(), abs_tol=1e-12)
