"""Realism analyses: feature frequency, effect sizes,
train-on-one / test-on-other prediction, feature distances.

Three tables (real train, real test, synthetic) are stacked into one frame
with a group column, profiled on the train rows only and encoded in one
projection; every per-table statistic is then a conditional aggregate of the
same pass, so the inputs are scanned once per analysis, not once per table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.predicates import DEFAULT_SENTINEL
from tabaudit.operators.encode import Encoded, encode
from tabaudit.operators.pivots import matrix
from tabaudit.operators.profile import profile
from tabaudit.spec import EncodingSpec

GROUP = "_src"
TRAIN, TEST, SYNTH = "train", "test", "synth"


def stack(tables: dict[str, DataFrame], group_col: str = GROUP) -> DataFrame:
    """Union of several tables (by column name) tagged with their name."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn(group_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def prepare(train: DataFrame, test: DataFrame, synth: DataFrame,
            row_id: str = "row_id", sentinel=DEFAULT_SENTINEL,
            spec: EncodingSpec | None = None, seed: int = 0,
            require_missing: bool = True, scale_by: str = "self") -> Encoded:
    """Profile the train table, encode the three tables stacked."""
    stacked = stack({TRAIN: train, TEST: test, SYNTH: synth})
    return prepare_stacked(stacked, GROUP, row_id=row_id, sentinel=sentinel,
                           spec=spec, seed=seed, require_missing=require_missing,
                           scale_by=scale_by)


def prepare_stacked(df: DataFrame, group_col: str, train=TRAIN, row_id: str = "row_id",
                    sentinel=DEFAULT_SENTINEL, spec: EncodingSpec | None = None,
                    seed: int = 0, require_missing: bool = True,
                    scale_by: str = "self") -> Encoded:
    ranges = None
    if spec is None:
        # one grouped first pass: train statistics for the profile and every
        # table's numeric ranges for the encoding
        from tabaudit.operators.profile import profile_groups
        spec, ranges = profile_groups(df, group_col, train, row_id, sentinel=sentinel)
    return encode(df, spec, row_id, require_missing=require_missing, seed=seed,
                  scale_by=scale_by, group_col=group_col, group_ranges=ranges)


def column_means(enc: Encoded, groups: dict[str, str]) -> DataFrame:
    """Mean of every encoded feature per group, long format
    (feature, <one column per group>). One pass in which every batch is added
    up in NumPy and a task sends one row a feature and group, whatever the
    number of features; undefined values are left out of sums and counts, and
    a feature without a defined value in a group has a NULL mean."""
    labels = list(enc.labels)
    names = list(groups)
    g = F.coalesce(*[F.when(F.col(enc.group_col) == F.lit(v), F.lit(i)) for i, v in enumerate(names)])

    def add(batches):
        total, seen = np.zeros((len(names), len(labels))), np.zeros((len(names), len(labels)), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, k = matrix(batch.column(1)), batch.column(0).to_numpy()
                known = np.isfinite(x)
                x = np.where(known, x, 0.0)
                for i in range(len(names)):
                    total[i] += x[k == i].sum(axis=0)
                    seen[i] += known[k == i].sum(axis=0)
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]), pa.array(seen[i, j])],
                                         names=["g", "pos", "s", "n"])

    parts = enc.df.select(g.alias("g"), "x").where("g IS NOT NULL").mapInArrow(add, "g int, pos int, s double, n long")
    per = parts.groupBy("pos").agg(*[
        F.try_divide(F.sum(F.when(F.col("g") == i, F.col("s"))), F.sum(F.when(F.col("g") == i, F.col("n")))).alias(groups[v])
        for i, v in enumerate(names)])
    every = enc.df.sparkSession.createDataFrame(list(enumerate(labels)), "pos int, feature string")
    return every.join(per, "pos", "left").select("feature", *groups.values())


def univariate(real: Encoded, synth: Encoded) -> DataFrame:
    """R1 for two separately encoded tables: (feature, real, synth)."""
    st = real.with_df(real.df.withColumn(GROUP, F.lit("r"))
                      .unionByName(synth.df.withColumn(GROUP, F.lit("s"))), GROUP)
    return column_means(st, {"r": "real", "s": "synth"})


def feature_frequency(train: DataFrame, test: DataFrame, synth: DataFrame,
                      row_id: str = "row_id", sentinel=DEFAULT_SENTINEL,
                      spec: EncodingSpec | None = None, seed: int = 0) -> DataFrame:
    """R2: (feature, real_train, real_test, synth) mean of each encoded
    feature; the spec comes from the real train table."""
    enc = prepare(train, test, synth, row_id, sentinel, spec, seed)
    return frequency_of(enc)


def frequency_of(enc: Encoded, train=TRAIN, test=TEST, synth=SYNTH) -> DataFrame:
    return column_means(enc, {train: "real_train", test: "real_test", synth: "synth"})


def frequency_correlation(freq: DataFrame) -> DataFrame:
    """Pearson correlation of the real and synthetic frequency vectors."""
    return freq.agg(F.corr("real_train", "synth").alias("corr_train"),
                    F.corr("real_test", "synth").alias("corr_test"))


# ------------------------------------------------------ R4-R11: model fits
from pyspark.ml.classification import MultilayerPerceptronClassifier  # noqa: E402
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402

from tabaudit.operators.encode import split_outcome  # noqa: E402
from tabaudit.operators.metrics import auc as _auc  # noqa: E402
from tabaudit.operators.metrics import auc_by  # noqa: E402
from tabaudit.operators.metrics import roc_curve as _roc  # noqa: E402


def _vectors(xy: DataFrame) -> DataFrame:
    return xy.select("row_id", F.col("y").cast("double").alias("label"),
                     array_to_vector(F.col("x")).alias("features"))


def fit_effects(xy: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-13):
    """L2 logistic regression with an unpenalised intercept (sklearn's
    lbfgs objective  0.5||w||^2 + C * sum(logloss)). A constant outcome has no
    finite fit: all effects are NaN."""
    d = xy.select(F.size("x").alias("d")).first()["d"]
    beta = fit_arms(xy.withColumn("arm", F.lit(0)), d, 1, C, "l2", max_iter, tol)[0]
    return (beta[:-1].tolist(), float(beta[-1])) if beta is not None else ([float("nan")] * d, float("nan"))


def _scale_vec(v: list[float]) -> list[float]:
    lo, hi = min(v), max(v)
    return [(x - lo) / (hi - lo) if hi != lo else float("nan") for x in v]


def feature_effect(enc: Encoded, outcome: str, groups: dict[str, str] | None = None,
                   scaled: bool = False, C: float = 1.0) -> DataFrame:
    """(feature, effect_<group>...) coefficients of one L2 fit per group
    (real train, real test, synthetic); the outcome column is removed."""
    groups = groups or {TRAIN: "effect_real_train", TEST: "effect_real_test",
                        SYNTH: "effect_synth"}
    beta, feats = effects_by_group(enc, outcome, list(groups), C)
    cols = {}
    for g, name in groups.items():
        coef = [float("nan")] * len(feats) if beta[g] is None else beta[g][:-1].tolist()
        cols[name] = _scale_vec(coef) if scaled else coef
    rows = [(f.label, *[float(cols[n][i]) for n in groups.values()]) for i, f in enumerate(feats)]
    schema = "feature string, " + ", ".join(f"{n} double" for n in groups.values())
    return enc.df.sparkSession.createDataFrame(rows, schema)


def effects_by_group(enc: Encoded, outcome: str, groups: list[str], C: float = 1.0):
    """({group: effects and intercept, None where its outcome is constant},
    features), all groups fitted together."""
    from tabaudit.session import cut_lineage
    xy, feats = split_outcome(enc, outcome)
    data = cut_lineage(xy.select(_number(F.col(enc.group_col), groups).alias("arm"), "y", "x").where("arm IS NOT NULL"))
    return dict(zip(groups, fit_arms(data, len(feats), len(groups), C, "l2"))), feats


def _number(col: Column, names: list[str]) -> Column:
    """The place of a name in a list; NULL for others."""
    return F.coalesce(*[F.when(col == F.lit(n), F.lit(i)) for i, n in enumerate(names)])


def _split_xy(enc: Encoded, outcome: str) -> DataFrame:
    """E10 keeping the group column."""
    xy, _ = split_outcome(enc, outcome)
    return xy


class LinearModel:
    """sigmoid(x . w + b) scored JVM-side."""

    def __init__(self, w: list[float], b: float):
        self.w, self.b = w, b

    def score(self, xy: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(v)) for v in self.w])
        dot = F.aggregate(F.zip_with(F.col("x"), w, lambda a, c: a * c), F.lit(0.0), lambda s, t: s + t)
        return xy.select("row_id", "y", (F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(self.b))))).alias("p"))


def _newton_stats(data: DataFrame, betas: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """One pass for all arms: log-loss at beta, A = sum w x x^T and
    b = sum (w*eta + y - p) x with p = sigmoid(x.beta), w = p(1-p); x has a 1
    for the intercept appended here. Every task adds its batches up with NumPy
    and sends one row for each arm and row of A (from its diagonal on) and one
    for the loss and b; they are summed by (arm, row number) with partial sums,
    the same for any width. The driver gets d + 1 rows an arm."""
    from pyspark.ml.stat import Summarizer
    d = len(next(iter(betas.values())))

    def partial(batches):
        A, b = {k: np.zeros((d, d)) for k in betas}, {k: np.zeros(d) for k in betas}
        loss, seen = dict.fromkeys(betas, 0.0), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            arm, y_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x_all = np.hstack([matrix(batch.column(2)), np.ones((batch.num_rows, 1))])
            for k, beta in betas.items():
                mine = arm == k
                if not mine.any():
                    continue
                seen.add(k)
                X, y = x_all[mine], y_all[mine]
                eta = X @ beta
                p = 1.0 / (1.0 + np.exp(-eta))
                w = p * (1.0 - p)
                loss[k] += (np.logaddexp(0.0, eta) - y * eta).sum()
                A[k] += (X * w[:, None]).T @ X
                b[k] += X.T @ (w * eta + y - p)
        for k in sorted(seen):
            rows = [*[A[k][i, i:].tolist() for i in range(d)], [float(loss[k]), *b[k].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array([k] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["arm", "i", "s"])

    wanted = F.col("arm").isin(list(betas))
    rows = (data.where(wanted).select(F.col("arm").cast("int").alias("arm"), F.col("y").cast("double").alias("y"), F.col("x").cast("array<double>").alias("x"))
            .mapInArrow(partial, "arm int, i int, s array<double>").groupBy("arm", "i")
            .agg(Summarizer.sum(array_to_vector(F.col("s"))).alias("v")).collect())
    total = {(r["arm"], r["i"]): r["v"].toArray() for r in rows}
    out = {}
    for k in betas:
        A = np.zeros((d, d))
        for i in range(d):
            A[i, i:] = total[k, i]
        out[k] = float(total[k, d][0]), A + np.triu(A, 1).T, total[k, d][1:]
    return out


def _penalised_quadratic(A, b, l1, l2, start, tol=1e-13, max_sweeps=10_000):
    """argmin 0.5 b'A b - b'x + sum l1|x| + 0.5 sum l2 x^2 (coordinate descent;
    a direct solve when there is no L1 term). Driver-side, d x d."""
    if not np.any(l1):
        return np.linalg.solve(A + np.diag(l2), b)
    x = np.array(start, dtype=float)
    diag = np.diag(A) + l2
    for _ in range(max_sweeps):
        delta = 0.0
        for j in range(len(x)):
            if diag[j] <= 0:
                continue
            rho = b[j] - A[j] @ x + A[j, j] * x[j]
            new = np.sign(rho) * max(abs(rho) - l1[j], 0.0) / diag[j]
            delta = max(delta, abs(new - x[j]))
            x[j] = new
        if delta < tol:
            break
    return x


def newton_logistic(data: DataFrame, arms: list[int], l1: np.ndarray, l2: np.ndarray, max_iter: int = 100,
                    tol: float = 1e-12) -> dict[int, np.ndarray]:
    """Penalised logistic regressions of several arms by (proximal) Newton /
    IRLS, each minimising sum logloss(y, x.beta) + sum l1_j|beta_j| + 0.5 sum
    l2_j beta_j^2. A step of all arms that have not converged is ONE aggregate
    over ``data`` (arm, y, x); the d x d subproblems are solved on the driver."""
    beta = {k: np.zeros(len(l1)) for k in arms}
    last: dict[int, tuple[float, np.ndarray]] = {}
    done: dict[int, np.ndarray] = {}
    for _ in range(max_iter):
        left = {k: v for k, v in beta.items() if k not in done}
        if not left:
            return done
        for k, (loss, A, b) in _newton_stats(data, left).items():
            here = beta[k]
            obj = loss + float(l1 @ np.abs(here)) + 0.5 * float(l2 @ (here * here))
            if k in last and obj > last[k][0] * (1 + 1e-13):
                beta[k] = (here + last[k][1]) / 2                  # damped step
                continue
            if k in last and abs(last[k][0] - obj) <= tol * max(1.0, abs(obj)):
                done[k] = here
                continue
            last[k] = obj, here
            beta[k] = _penalised_quadratic(A, b, l1, l2, here)
    if len(done) == len(arms):
        return done
    raise RuntimeError(f"no convergence in {max_iter} steps")


def fit_arms(data: DataFrame, d: int, n_arms: int, C: float = 1.0, penalty: str = "l1", max_iter: int = 100,
             tol: float = 1e-12) -> list[np.ndarray | None]:
    """Coefficients and intercept of the arms 0 .. n_arms - 1 of ``data`` (arm,
    y, x with d values): ``l2`` leaves the intercept out of the penalty, ``l1``
    penalises it too. None for an arm whose outcome is constant (or empty)."""
    span = {r["arm"]: r for r in data.groupBy("arm").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    arms = [k for k in range(n_arms) if k in span and span[k]["lo"] is not None and span[k]["lo"] != span[k]["hi"]]
    if not arms:
        return [None] * n_arms
    l1 = np.full(d + 1, 1.0 / C if penalty == "l1" else 0.0)
    l2 = np.zeros(d + 1) if penalty == "l1" else np.append(np.full(d, 1.0 / C), 0.0)
    found = newton_logistic(data, arms, l1, l2, max_iter, tol)
    return [found.get(k) for k in range(n_arms)]


def optimality(data: DataFrame, betas: list[np.ndarray | None], penalty: str, C: float = 1.0) -> DataFrame:
    """(arm, pos, residual): how far each coefficient (the intercept last) is
    from the conditions of a minimum, from one plain aggregate of the rows: the
    gradient for ``l2``; for ``l1`` the distance of the loss's gradient from
    the subgradient of the penalty. 0 at a minimum."""
    d = len(next(b for b in betas if b is not None)) - 1
    w = F.coalesce(*[F.when(F.col("arm") == k, F.array(*[F.lit(float(v)) for v in b])) for k, b in enumerate(betas) if b is not None])
    x1 = F.concat(F.col("x"), F.array(F.lit(1.0)))
    eta = F.aggregate(F.zip_with(x1, w, lambda a, c: a * c), F.lit(0.0), lambda s, t: s + t)
    part = data.select("arm", (F.lit(C) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)) - F.col("y"))).alias("r"), x1.alias("x"))
    long = part.select("arm", "r", F.posexplode("x").alias("pos", "v")).groupBy("arm", "pos").agg(F.sum(F.col("r") * F.col("v")).alias("g"))
    flat = [(k, j, float(b[j])) for k, b in enumerate(betas) if b is not None for j in range(d + 1)]
    coef = data.sparkSession.createDataFrame(flat, "arm int, pos int, w double")
    joined = long.join(coef, ["arm", "pos"])
    if penalty == "l2":
        res = F.abs(F.col("g") + F.when(F.col("pos") < d, F.col("w")).otherwise(0.0))
    else:
        res = F.when(F.col("w") != 0, F.abs(F.col("g") + F.signum("w"))).otherwise(F.greatest(F.lit(0.0), F.abs(F.col("g")) - 1.0))
    return joined.select("arm", "pos", res.alias("residual"))


def fit_lr_l1(xy: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-12) -> LinearModel:
    """L1 logistic regression whose intercept is penalised too (the
    liblinear objective  ||w||_1 + C * sum(logloss)), by proximal Newton
    (one aggregate per step, usually < 10 steps)."""
    d = xy.select(F.size("x").alias("d")).first()["d"]
    beta = fit_arms(xy.withColumn("arm", F.lit(0)), d, 1, C, "l1", max_iter, tol)[0]
    if beta is None:
        raise ValueError("the outcome is constant")
    return LinearModel(beta[:-1].tolist(), float(beta[-1]))


class MLPModel:
    def __init__(self, model):
        self.model = model

    def score(self, xy: DataFrame) -> DataFrame:
        v = xy.select("row_id", "y", array_to_vector(F.col("x")).alias("features"))
        out = self.model.transform(v)
        return out.select("row_id", "y", vector_to_array(F.col("probability"))[1].alias("p"))


def fit_mlp(xy: DataFrame, n_epoch: int = 5, hidden: int = 256, seed: int = 0) -> MLPModel:
    """R7 (substitute): MLlib perceptron, one hidden layer, full-batch
    gradient descent with step 0.01 for ``n_epoch`` iterations. MLlib uses
    sigmoid hidden units and a softmax output, so numbers differ from a
    ReLU/sigmoid network; the train/test protocol is the same."""
    d = xy.select(F.size("x").alias("d")).first()["d"]
    data = _vectors(xy)
    mlp = MultilayerPerceptronClassifier(layers=[d, hidden, 2], solver="gd", stepSize=0.01,
                                         maxIter=n_epoch, seed=seed, tol=0.0)
    return MLPModel(mlp.fit(data))


def constant_outcome(xy: DataFrame) -> bool:
    """True when the outcome has a single value."""
    r = xy.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    return r["lo"] is None or r["lo"] == r["hi"]


class ScoredArm(dict):
    """The scores of an arm; its 'roc' and 'auc' are made when asked for."""

    def __missing__(self, key: str) -> DataFrame:
        if key not in ("roc", "auc"):
            raise KeyError(key)
        self[key] = (_roc if key == "roc" else _auc)(self["scores"], "p", "y")
        return self[key]


def validate_prediction(train_xy: DataFrame, test_xy: DataFrame, model_type: str = "lr",
                        n_epoch: int = 5, seed: int = 0) -> dict | None:
    """Fit on one table, score the other: {'scores', 'roc', 'auc'}, the curves only if asked for; None
    when the training outcome is constant (reference behaviour)."""
    if constant_outcome(train_xy):
        return None
    if model_type == "lr":
        model = fit_lr_l1(train_xy)
    elif model_type == "mlp":
        model = fit_mlp(train_xy, n_epoch=n_epoch, seed=seed)
    else:
        raise ValueError(model_type)
    scores = model.score(test_xy)
    return ScoredArm(scores=scores)


def gan_train(synth_xy, real_xy, **kw):
    """Train on synthetic, test on real."""
    return validate_prediction(synth_xy, real_xy, **kw)


def gan_test(synth_xy, real_xy, **kw):
    """Train on real, test on synthetic."""
    return validate_prediction(real_xy, synth_xy, **kw)


ARMS = ("gan_real", "gan_train", "gan_test")


def comparison_arms(enc: Encoded, outcome: str, seed: int = 0) -> tuple[DataFrame, int]:
    """R11's rows, written once: (row_id, y, x, arm, on_real, on_synth). The
    synthetic rows are split in the real train:test proportion; ``arm`` is the
    one that fits on a row (0 real train, 1 synthetic train, 2 real test; NULL
    for none), ``on_real`` marks the rows that arms 0 and 1 score, ``on_synth``
    those of arm 2. Also the number of features."""
    from tabaudit.operators.sample import split_proportional
    from tabaudit.session import cut_lineage
    g = enc.group_col
    xy, feats = split_outcome(enc, outcome)
    # read for the counts, the split, every step of the fits and the scores
    xy = cut_lineage(xy)
    n = {r[g]: r["n"] for r in xy.groupBy(g).agg(F.count(F.lit(1)).alias("n")).collect()}
    s_tr, s_te = split_proportional(xy.where(F.col(g) == SYNTH), n.get(TRAIN, 0), n.get(TEST, 0), "row_id", seed=seed)
    none = F.lit(None).cast("int")
    parts = [(xy.where(F.col(g) == TRAIN), F.lit(0), False, False), (s_tr, F.lit(1), False, False),
             (xy.where(F.col(g) == TEST), F.lit(2), True, False), (s_te, none, False, True)]
    out = None
    for df, arm, real, synth in parts:
        df = df.select("row_id", "y", "x", arm.cast("int").alias("arm"), F.lit(real).alias("on_real"), F.lit(synth).alias("on_synth"))
        out = df if out is None else out.unionByName(df)
    return out, len(feats)


def score_arms(data: DataFrame, betas: list[np.ndarray | None]) -> DataFrame:
    """(arm, row_id, y, p) of all arms over the rows that they are tested on."""
    out = None
    for k, beta in enumerate(betas):
        if beta is not None:
            rows = data.where("on_synth" if k == 2 else "on_real")
            part = LinearModel(beta[:-1].tolist(), float(beta[-1])).score(rows).select(F.lit(ARMS[k]).alias("arm"), "row_id", "y", "p")
            out = part if out is None else out.unionByName(part)
    return out


class Comparison(dict):
    """The result of R11; 'roc' (arm, fpr, tpr, threshold) is made when asked for."""

    def __missing__(self, key: str) -> DataFrame:
        if key != "roc":
            raise KeyError(key)
        out = None
        for arm in self["arms"]:
            curve = _roc(self["scores"].where(F.col("arm") == arm), "p", "y")
            curve = curve.select(F.lit(arm).alias("arm"), "fpr", "tpr", "threshold")
            out = curve if out is None else out.unionByName(curve)
        self[key] = out
        return out


def train_test_comparison(enc: Encoded, outcome: str, model_type: str = "lr", n_epoch: int = 5,
                          seed: int = 0) -> Comparison:
    """R11 on a stacked encoding (train / test / synth groups): arms gan_real
    (fit real train, test real test), gan_train (fit synth train, test real
    test) and gan_test (fit real *test*, test synth test). All arms are fitted,
    scored and rated together. Returns 'auc': (arm, auc, status), 'scores':
    (arm, row_id, y, p) and 'roc'."""
    data, d = comparison_arms(enc, outcome, seed)
    spark = enc.df.sparkSession
    if model_type == "lr":
        betas = fit_arms(data.where("arm IS NOT NULL"), d, len(ARMS))
        fitted = [a for a, b in zip(ARMS, betas) if b is not None]
        scores = score_arms(data, betas)
    else:
        scores, fitted = None, []
        for k, arm in enumerate(ARMS):
            res = validate_prediction(data.where(F.col("arm") == k), data.where("on_synth" if k == 2 else "on_real"), model_type, n_epoch, seed)
            if res is not None:
                part = res["scores"].select(F.lit(arm).alias("arm"), "row_id", "y", "p")
                scores = part if scores is None else scores.unionByName(part)
                fitted.append(arm)
    failed = spark.createDataFrame([(a, None, "constant_outcome") for a in ARMS if a not in fitted], "arm string, auc double, status string")
    if scores is None:
        return Comparison(auc=failed, scores=spark.createDataFrame([], "arm string, row_id long, y int, p double"), arms=[], roc=None)
    rated = auc_by(scores, "arm", "p", "y").select("arm", "auc", F.lit("ok").alias("status"))
    return Comparison(auc=rated.unionByName(failed), scores=scores, arms=fitted)
