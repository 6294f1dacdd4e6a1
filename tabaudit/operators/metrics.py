"""Metrics: ROC, AUC, KL divergence, normal pdf,
categorical frequency distance, per-feature distance, reconstruction BCE,
threshold accuracy.

ROC/AUC first aggregate by distinct score (so a score shared by a third of
the rows is one row), then use distributed prefix sums (``prefix``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.predicates import DEFAULT_SENTINEL, as_text, numeric_value
from tabaudit.operators.prefix import prefix_sums
from tabaudit.spec import BINARY, CATEGORICAL, CONSTANT, CONTINUOUS, COUNT, EncodingSpec

SQRT_2PI = math.sqrt(2.0 * math.pi)


# ----------------------------------------------------------------- ROC/AUC
def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) per distinct score (map-side combined). A NULL score
    or label is an error: leaving it out would change the curve."""
    y = F.col(label).cast("long")
    known = F.when(F.col(score).isNull() | y.isNull(), F.raise_error(F.lit("a score or label is NULL")).cast("double")) \
        .otherwise(F.col(score).cast("double"))
    return df.groupBy(known.alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def auc(df: DataFrame, score: str, label: str, n_buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve (trapezoid on the full curve, i.e. the
    Mann-Whitney statistic with half weight for ties). One row ``auc``;
    NULL when a class is empty. Computed eagerly: the per-score counts are
    written once for the few small jobs of the prefix sum; products are
    doubles, as counts of 1e9 a class overflow a bigint."""
    from tabaudit.session import cut_lineage
    sc = cut_lineage(score_counts(df, score, label))
    return auc_of_counts(sc, n_buckets)


def auc_of_counts(sc: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """AUC from (score, pos, neg) rows."""
    cum = prefix_sums(sc, "score", ["pos", "neg"], descending=True, n_buckets=n_buckets)
    # each distinct score adds neg/N * (tps_i + tps_{i-1}) / 2P
    area = F.col("neg").cast("double") * (2 * F.col("cum_pos").cast("double") - F.col("pos"))
    value = cum.agg(F.try_divide(F.sum(area), 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double"))
                    .alias("auc")).first()["auc"]
    return sc.sparkSession.createDataFrame([(value,)], "auc double")


def auc_by(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """R13 for several sets of scores at once: (``by``, auc), one order over
    (``by``, score) for all of them; NULL where a class is empty."""
    from tabaudit.session import cut_lineage
    y = F.col(label).cast("long")
    known = F.when(F.col(score).isNull() | y.isNull(), F.raise_error(F.lit("a score or label is NULL")).cast("double")) \
        .otherwise(F.col(score).cast("double"))
    sc = cut_lineage(df.groupBy(F.col(by).alias("set"), known.alias("score")).agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))
    cum = cut_lineage(prefix_sums(sc.withColumn("_key", F.struct("set", "score")), "_key", ["pos"], descending=True))
    # the order is by set first: a set's sums start from those of the sets before it
    start = cum.groupBy("set").agg(F.min(F.col("cum_pos") - F.col("pos")).alias("before"))
    area = F.col("neg").cast("double") * (2 * (F.col("cum_pos") - F.col("before")).cast("double") - F.col("pos"))
    return cum.join(start, "set").groupBy(F.col("set").alias(by)).agg(
        F.try_divide(F.sum(area), 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str, drop_collinear: bool = True,
              n_buckets: int | None = None) -> DataFrame:
    """(fpr, tpr, threshold) at each distinct score, descending, plus
    the (0, 0) start with threshold max+1. ``drop_collinear`` removes points
    whose neighbours are collinear with them (keeps first and last)."""
    from tabaudit.session import cut_lineage
    # per-score counts feed several jobs below: materialise them once in the
    # shared checkpoint directory (bounded by the number of distinct scores)
    sc = cut_lineage(score_counts(df, score, label))
    cum = cut_lineage(prefix_sums(sc.withColumn("_one", F.lit(1)), "score", ["pos", "neg", "_one"], descending=True,
                                  n_buckets=n_buckets).withColumnRenamed("cum__one", "idx"))
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max("score").alias("smax"))
    pts = cum.select("idx", "score", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))
    if drop_collinear:
        prev = pts.select((F.col("idx") + 1).alias("idx"), F.col("tps").alias("tp0"),
                          F.col("fps").alias("fp0"))
        nxt = pts.select((F.col("idx") - 1).alias("idx"), F.col("tps").alias("tp2"),
                         F.col("fps").alias("fp2"))
        j = pts.join(prev, "idx", "left").join(nxt, "idx", "left")
        keep = (F.col("tp0").isNull() | F.col("tp2").isNull()
                | ((F.col("fp2") - 2 * F.col("fps") + F.col("fp0")) != 0)
                | ((F.col("tp2") - 2 * F.col("tps") + F.col("tp0")) != 0))
        pts = j.filter(keep).select("idx", "score", "tps", "fps")
    t = tot.first()     # one row: P, N, max score
    P_, N_ = float(t["P"] or 0), float(t["N"] or 0)
    curve = pts.select(
        F.try_divide(F.col("fps").cast("double"), F.lit(N_)).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), F.lit(P_)).alias("tpr"),
        F.col("score").alias("threshold"))
    start = pts.sparkSession.createDataFrame(
        [(0.0, 0.0, float(t["smax"]) + 1.0 if t["smax"] is not None else None)],
        "fpr double, tpr double, threshold double")
    return start.unionByName(curve)


# ----------------------------------------------------------------- scalars
def normal_pdf(v: Column) -> Column:
    """Standard normal density."""
    x = v.cast("double")
    return F.exp(-(x * x) / F.lit(2.0)) / F.lit(SQRT_2PI)


def aligned(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows matched by key; a row without a partner raises."""
    j = left.withColumn("_in_l", F.lit(True)).join(right.withColumn("_in_r", F.lit(True)), on, "full")
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    return j.where(F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("a key is on one side only")).cast("boolean"))) \
        .drop("_in_l", "_in_r")


def kl_divergence(p: DataFrame, q: DataFrame, key: str, p_col: str = "p",
                  q_col: str = "q") -> DataFrame:
    """Sum of p*ln(p/q) where both are non-zero, row-aligned on ``key``
    (an explicit key replaces array position; a key on one side only is an
    error). One row ``kl``."""
    j = aligned(p.select(key, F.col(p_col).alias("_p")), q.select(key, F.col(q_col).alias("_q")), [key])
    term = F.when((F.col("_p") != 0) & (F.col("_q") != 0),
                  F.col("_p") * F.log(F.col("_p") / F.col("_q"))).otherwise(F.lit(0.0))
    return j.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("kl"))


def categorical_distance(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, L2 norm between the value-frequency vectors of the
    real and synthetic column over the values seen in real. One pass per
    side (partial aggregation), output one row per column."""
    def freqs(df, side):
        dt = {f.name: f.dataType for f in df.schema.fields}
        pairs = F.array(*[F.struct(F.lit(c).alias("label"),
                                   F.coalesce(as_text(F.col(c), dt[c]), F.lit("")).alias("value"))
                          for c in columns])
        return (df.select(F.explode(pairs).alias("p"))
                  .groupBy(F.col("p.label").alias("label"), F.col("p.value").alias("value"))
                  .agg(F.count(F.lit(1)).alias(f"n_{side}")))
    r, s = freqs(real, "r"), freqs(synth, "s")
    n_r = real.count()
    n_s = synth.count()
    j = r.join(s, ["label", "value"], "left")
    diff = (F.col("n_r") / F.lit(float(n_r))) - (F.coalesce(F.col("n_s"), F.lit(0)) / F.lit(float(n_s)))
    return j.groupBy("label").agg(F.sqrt(F.sum(diff * diff)).alias("distance"))


def feature_distance(real: DataFrame, synth: DataFrame, spec: EncodingSpec, key: str,
                     categorical_metric: str = "euclidean",
                     numerical_metric: str = "kl") -> DataFrame:
    """(label, type, distance) per column: categorical-like columns by
    R16, numeric columns by KL of the standard-normal pdf of the raw values,
    rows aligned on ``key``. Unknown metric names give NULL."""
    cat_cols = [c.label for c in spec.columns if c.type in (CONSTANT, BINARY, CATEGORICAL)]
    num_cols = [c.label for c in spec.columns if c.type in (CONTINUOUS, COUNT)]
    types = real.sparkSession.createDataFrame([(c.label, c.type) for c in spec.columns],
                                              "label string, type string")
    parts = []
    if cat_cols:
        cd = categorical_distance(real, synth, cat_cols)
        if categorical_metric != "euclidean":
            cd = cd.select("label", F.lit(None).cast("double").alias("distance"))
        parts.append(cd)
    if num_cols:
        dt_r = {f.name: f.dataType for f in real.schema.fields}
        dt_s = {f.name: f.dataType for f in synth.schema.fields}

        def long(df, dt, side):
            pairs = F.array(*[F.struct(F.lit(c).alias("label"),
                                       normal_pdf(numeric_value(F.col(c), dt[c])).alias("v"))
                              for c in num_cols])
            return df.select(key, F.explode(pairs).alias("p")).select(
                key, F.col("p.label").alias("label"), F.col("p.v").alias(side))
        j = aligned(long(real, dt_r, "_p"), long(synth, dt_s, "_q"), [key, "label"])
        term = F.when((F.col("_p") != 0) & (F.col("_q") != 0),
                      F.col("_p") * F.log(F.col("_p") / F.col("_q"))).otherwise(F.lit(0.0))
        nd = j.groupBy("label").agg(F.sum(term).alias("distance"))
        if numerical_metric != "kl":
            nd = nd.select("label", F.lit(None).cast("double").alias("distance"))
        parts.append(nd)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return types.join(out, "label", "left").select("label", "type", "distance")


def reconstruction_bce(target: DataFrame, output: DataFrame, key: str = "row_id",
                       x_col: str = "x", eps: float = 1e-12) -> DataFrame:
    """Mean over rows of sum_j BCE(target_j, output_j), aligned on key."""
    j = aligned(target.select(key, F.col(x_col).alias("_y")), output.select(key, F.col(x_col).alias("_o")), [key])
    e = F.lit(eps)
    terms = F.zip_with("_y", "_o", lambda y, o: y * F.log(o + e) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - o + e))
    per_row = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return j.agg(F.avg(-per_row).alias("loss"))


def threshold_accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    """100 * share of rows with |p - y| <= 0.5."""
    ok = (F.abs(F.col(pred).cast("double") - F.col(label).cast("double")) <= F.lit(0.5)).cast("double")
    return df.agg((F.lit(100.0) * F.avg(ok)).alias("accuracy"))
