"""Registered queries: one callable per SURVEY section-2 operator, each
taking (spark, sf_dir) and returning a DataFrame over the whole tables.

Every double that is the result of arithmetic is rounded to 6 digits here
(the oracle rounds identically), so the comparison is insensitive to
summation order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.operators import encode as E
from tabaudit.operators import profile as P
from tabaudit.operators import realism as R
from tabaudit.sources import fixtures as X

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Q] = {}

DIGITS = 6


def query(name: str):
    def deco(fn: Q) -> Q:
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, DIGITS)


def _roles(spark, sf):
    return X.cohort_roles(spark, sf)


def _spec(spark, sf):
    return P.profile(_roles(spark, sf)["train"], "row_id", sentinel=X.SENTINEL)


def _cohort(spark, sf, role=False):
    return X.cohort(spark, sf, with_role=role)


# ------------------------------------------------------------------ P1-P7
@query("profile_metadata")
def profile_metadata(spark, sf):
    spec = _spec(spark, sf)
    return spec.to_frame(spark).select(
        "label", "pos", "type", r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"),
        "zero", "one", F.array_join("unique", ",").alias("unique_values"), "missing")


@query("variable_type")
def variable_type(spark, sf):
    return P.infer_types(X.table(spark, sf, "events"), "event_id", sentinel=X.SENTINEL)


@query("minority_class")
def minority_class(spark, sf):
    lab = X.table(spark, sf, "labels", ["quality", "toxic"])
    return P.minority_class(lab, ["quality", "toxic"], X.SENTINEL)


@query("missing_indicator")
def missing_indicator(spark, sf):
    return P.missing_indicator(_cohort(spark, sf), "row_id", X.FEATURES, X.SENTINEL)


@query("numeric_test")
def numeric_test(spark, sf):
    c = _cohort(spark, sf)
    text = c.select("row_id", *[F.col(n).cast("string").alias(n) for n in X.FEATURES])
    return P.numeric_test(text, "row_id", X.FEATURES, X.SENTINEL)


STRING_FEATURES = ["constant", "tier", "categorical", "priority"]


def _as_written(name):
    """A feature as text; numbers with two decimals."""
    return F.col(name) if name in STRING_FEATURES else F.col(name).cast("decimal(18,2)").cast("string")


@query("remove_missing")
def remove_missing(spark, sf):
    c = _cohort(spark, sf)
    parts = [P.remove_missing(c, n, X.SENTINEL)
             .select("row_id", F.lit(n).alias("label"), _as_written(n).alias("value"))
             for n in X.FEATURES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("missing_rows")
def missing_rows(spark, sf):
    return P.missing_rows(_cohort(spark, sf), "row_id", X.FEATURES, X.SENTINEL)


# ----------------------------------------------------------------- E1-E10
@query("one_hot")
def one_hot(spark, sf):
    spec = _spec(spark, sf)
    c = _cohort(spark, sf)
    pr = spec["priority"]
    seg = E.one_hot(F.col("priority"), c.schema["priority"].dataType, pr.unique,
                    add_missing_col=True, sentinel=X.SENTINEL)
    n = len(pr.unique) + 1
    return c.select("row_id", seg.alias("s")).select(
        "row_id", *[F.col("s")[i].alias(f"priority__{i}") for i in range(n)])


@query("min_max_scale")
def min_max_scale(spark, sf):
    out = E.min_max_scale(_cohort(spark, sf), ["count", "continuous"], "row_id", X.SENTINEL)
    return out.select("row_id", r6(F.col("count")).alias("count"),
                      r6(F.col("continuous")).alias("continuous"))


@query("unscale")
def unscale(spark, sf):
    c = _cohort(spark, sf)
    scaled = E.min_max_scale(c, ["count", "continuous"], "row_id", X.SENTINEL)
    rng = E.numeric_ranges(c, ["count", "continuous"], X.SENTINEL)
    s = float(X.SENTINEL)
    cols = []
    for n in ("count", "continuous"):
        lo, hi = rng[n]
        v = F.col(n)
        cols.append(r6(F.when(v == F.lit(s), v).otherwise(E.unscale(v, lo, hi))).alias(n))
    return scaled.select("row_id", *cols)


@query("inverted_scale")
def inverted_scale(spark, sf):
    docs = X.table(spark, sf, "documents", ["doc_id", "n_chars"])
    out = E.vector_scale(docs, "n_chars", invert=True, out="score")
    return out.select("doc_id", r6(F.col("score")).alias("score"))


@query("random_fill")
def random_fill(spark, sf):
    spec = _spec(spark, sf)
    enc = E.encode(_cohort(spark, sf), spec, "row_id")
    i = enc.labels.index("continuous__continuous")
    j = enc.labels.index(f"continuous__{X.SENTINEL}")
    return enc.df.select("row_id", r6(F.col("x")[i]).alias("continuous"),
                         F.col("x")[j].alias("continuous_missing"))


def _all_roles(spark, sf, scale_by="self"):
    """The whole cohort encoded in one pass, by the spec of the train rows;
    ``self``: every role has its own ranges."""
    return R.prepare_stacked(_cohort(spark, sf, role=True), "role", "train", "row_id", X.SENTINEL, scale_by=scale_by)


@query("encode_table")
def encode_table(spark, sf):
    return _all_roles(spark, sf).wide(DIGITS)


@query("argmax_decode")
def argmax_decode(spark, sf):
    from tabaudit.functions.rand import hash_bit
    spec = _spec(spark, sf)
    cat = spec["categorical"]
    k = len(cat.unique)
    c = _cohort(spark, sf).select("row_id")
    bits = F.array(*[hash_bit(X.SEED, "argmax", i, F.col("row_id")) for i in range(k)])
    return c.select("row_id", E.argmax_decode(bits, cat.unique).alias("categorical"))


@query("restore_table")
def restore_table(spark, sf):
    out = E.decode(_all_roles(spark, sf))
    return out.select("row_id", "constant", "tier", "categorical", "priority",
                      r6(F.col("count")).alias("count"), r6(F.col("continuous")).alias("continuous"))


@query("clip")
def clip(spark, sf):
    enc = _all_roles(spark, sf, scale_by="spec")
    i, j = enc.labels.index("continuous__continuous"), enc.labels.index("count__count")
    x = E.clip01(F.col("x"))
    return enc.df.select("row_id", "role", r6(x[i]).alias("continuous"), r6(x[j]).alias("count"))


@query("outcome_split")
def outcome_split(spark, sf):
    df, feats = E.split_outcome(_all_roles(spark, sf), "tier")
    return df.select("row_id", "role", "y", *[r6(F.col("x")[i]).alias(f.label) for i, f in enumerate(feats)])


@query("encode_optional_flags")
def encode_optional_flags(spark, sf):
    """E6 with require_missing=False: flags only for columns with missing cells."""
    return R.prepare_stacked(_cohort(spark, sf, role=True), "role", "train", "row_id", X.SENTINEL, require_missing=False).wide(DIGITS)


@query("argmax_random_tie")
def argmax_random_tie(spark, sf):
    """E7 with a keyed draw among equal maxima."""
    from tabaudit.functions.rand import hash_bit
    cat = _spec(spark, sf)["categorical"]
    c = _cohort(spark, sf).select("row_id")
    bits = F.array(*[hash_bit(X.SEED, "argmax", i, F.col("row_id")) for i in range(len(cat.unique))])
    return c.select("row_id", E.argmax_decode(bits, cat.unique, F.col("row_id"), X.SEED).alias("categorical"))


@query("type_overrides")
def type_overrides(spark, sf):
    return P.infer_types(_cohort(spark, sf), "row_id", sentinel=X.SENTINEL, overrides={"count": "continuous", "tier": "categorical"})


@query("spec_roundtrip")
def spec_roundtrip(spark, sf):
    """The spec is written and read back."""
    from tabaudit.session import scratch_path
    from tabaudit.spec import EncodingSpec
    path = scratch_path(spark, "spec")
    _spec(spark, sf).save(spark, path)
    return EncodingSpec.load(spark, path).to_frame(spark).select(
        "label", "pos", "type", r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"),
        "zero", "one", F.array_join("unique", ",").alias("unique_values"), "missing")


def _sparse_events(spark, sf):
    from tabaudit.operators.sparse import sparse_spec
    events = X.table(spark, sf, "events")
    return events, sparse_spec(events, "event_id", sentinel=X.SENTINEL)


@query("sparse_encode")
def sparse_encode(spark, sf):
    """E1/E6 with dictionaries of any size: every column of events, one of
    them with as many values as rows."""
    from tabaudit.operators.sparse import encode_sparse
    events, spec = _sparse_events(spark, sf)
    out = encode_sparse(events, spec, "event_id")
    return out.select("event_id", "label", "pos", r6(F.col("value")).alias("value"))


@query("sparse_vectors")
def sparse_vectors(spark, sf):
    from tabaudit.operators.sparse import encode_sparse, to_vectors
    events, spec = _sparse_events(spark, sf)
    v = to_vectors(encode_sparse(events, spec, "event_id"), "event_id")
    return v.select("event_id", F.size("indices").alias("n"), F.element_at("indices", 1).alias("first"), F.element_at("indices", -1).alias("last"),
                    r6(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("sparse_restore")
def sparse_restore(spark, sf):
    """E7/E8 through the dictionary."""
    from tabaudit.operators.sparse import decode_sparse, encode_sparse
    events, spec = _sparse_events(spark, sf)
    out = decode_sparse(encode_sparse(events, spec, "event_id"), spec, events, "event_id")
    return out.select("event_id", "ts", r6(F.col("user_id")).alias("user_id"), "event_type", r6(F.col("value")).alias("value"), "props")


# ------------------------------------------------------------ R1-R3, S9
def _frequency(spark, sf):
    return R.frequency_of(_all_roles(spark, sf))


@query("feature_frequency")
def feature_frequency(spark, sf):
    f = _frequency(spark, sf)
    return f.select("feature", *[r6(F.col(n)).alias(n) for n in ("real_train", "real_test", "synth")])


@query("freq_correlation")
def freq_correlation(spark, sf):
    f = R.frequency_correlation(_frequency(spark, sf))
    return f.select(r6(F.col("corr_train")).alias("corr_train"),
                    r6(F.col("corr_test")).alias("corr_test"))


@query("summary")
def summary(spark, sf):
    from tabaudit.operators.report import summarize_frequency
    return summarize_frequency(_frequency(spark, sf), n_decimal=2)


# ----------------------------------------------------------------- D1-D5, X
from tabaudit.operators import sample as D  # noqa: E402


@query("split_exact")
def split_exact(spark, sf):
    c = _cohort(spark, sf)
    tr, te = D.split_exact(c, 0.75, "row_id", seed=X.SEED, tag="split_exact")
    return tr.select("row_id", F.lit("train").alias("part")).unionByName(
        te.select("row_id", F.lit("test").alias("part")))


@query("split_floor")
def split_floor(spark, sf):
    """floor(n * share) rows."""
    tr, te = D.split_exact(_cohort(spark, sf), 0.3333, "row_id", seed=X.SEED, tag="split_floor", rounding="floor")
    return tr.select("row_id", F.lit("train").alias("part")).unionByName(te.select("row_id", F.lit("test").alias("part")))


@query("split_complement")
def split_complement(spark, sf):
    c = _cohort(spark, sf)
    tr, _ = D.split_exact(c, 0.75, "row_id", seed=X.SEED, tag="split_exact")
    return D.set_difference(c, tr, "row_id").select("row_id")


@query("split_proportional")
def split_proportional(spark, sf):
    r = _roles(spark, sf)
    n_tr, n_te = r["train"].count(), r["test"].count()
    s_tr, s_te = D.split_proportional(r["synth"], n_tr, n_te, "row_id", seed=X.SEED)
    return s_tr.select("row_id", F.lit("train").alias("part")).unionByName(
        s_te.select("row_id", F.lit("test").alias("part")))


@query("row_cap")
def row_cap(spark, sf):
    c = _cohort(spark, sf)
    return D.row_cap(c, c.count() // 3, "row_id", seed=X.SEED).select("row_id")


@query("bootstrap")
def bootstrap(spark, sf):
    return D.bootstrap(_cohort(spark, sf), "row_id", seed=X.SEED).select("row_id", "copy")


@query("union_rows")
def union_rows(spark, sf):
    return R.stack(_roles(spark, sf), "role").select("row_id", "role")


@query("sorted_distinct")
def sorted_distinct(spark, sf):
    from tabaudit.operators.sparse import value_dictionary
    return value_dictionary(_cohort(spark, sf), X.FEATURES, X.SENTINEL).select("label", "value", F.col("pos").cast("int").alias("pos"))


# ------------------------------------------------------------------- G1, G2
from tabaudit.operators import generate as G  # noqa: E402


def _enc_train(spark, sf):
    return _all_roles(spark, sf).group("train")


@query("marginal_sample")
def marginal_sample(spark, sf):
    return G.marginal_sample(_enc_train(spark, sf), seed=X.SEED).wide()


@query("uniform_bits")
def uniform_bits(spark, sf):
    return G.uniform_bits(_enc_train(spark, sf), seed=X.SEED).wide()


# ----------------------------------------------------------------- R12-R19
from tabaudit.operators import metrics as M  # noqa: E402
from tabaudit.operators.prefix import row_index  # noqa: E402


def _ranked(spark, sf):
    """Real rows (train and test) and, by rank, the synthetic rows they are
    compared with (ranks start anew when synthetic rows run out); numbers
    standardised by the real rows, keyed by rank. Both are written once."""
    from tabaudit.session import cut_lineage
    c = cut_lineage(_cohort(spark, sf, role=True))
    synthetic = F.col("role") == "synth"
    real, synth = (cut_lineage(row_index(c.where(k).drop("role"), "row_id", name="rk")) for k in (~synthetic, synthetic))
    n = synth.count()
    st = real.agg(*[f(c).alias(f"{k}_{c}") for c in ("count", "continuous") for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()

    def scaled(df):
        return df.withColumns({c: (F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"] for c in ("count", "continuous")})
    ranks = real.select(F.col("rk").alias("to"), ((F.col("rk") - 1) % n + 1).alias("rk"))
    partner = ranks.join(synth, "rk").drop("rk", "row_id").withColumnRenamed("to", "row_id")
    return cut_lineage(scaled(real.drop("row_id").withColumnRenamed("rk", "row_id"))), cut_lineage(scaled(partner))


@query("kl_divergence")
def kl_divergence(spark, sf):
    test, synth = _ranked(spark, sf)
    p = test.select("row_id", M.normal_pdf(F.col("count")).alias("p"))
    qq = synth.select("row_id", M.normal_pdf(F.col("count")).alias("q"))
    return M.kl_divergence(p, qq, "row_id").select(r6(F.col("kl")).alias("kl"))


@query("normal_pdf")
def normal_pdf(spark, sf):
    c = _cohort(spark, sf)
    return c.select("row_id", F.round(M.normal_pdf(F.col("count")), 9).alias("pdf"))


@query("categorical_distance")
def categorical_distance(spark, sf):
    r = _roles(spark, sf)
    out = M.categorical_distance(r["test"], r["synth"], STRING_FEATURES)
    return out.select("label", r6(F.col("distance")).alias("distance"))


@query("feature_distance")
def feature_distance(spark, sf):
    test, synth = _ranked(spark, sf)
    out = M.feature_distance(test, synth, _spec(spark, sf), "row_id")
    return out.select("label", "type", r6(F.col("distance")).alias("distance"))


@query("reconstruction_bce")
def reconstruction_bce(spark, sf):
    target = _all_roles(spark, sf).df
    output = _all_roles(spark, sf, scale_by="spec").df.select("row_id", E.clip01(F.col("x")).alias("x"))
    return M.reconstruction_bce(target, output, "row_id").select(r6(F.col("loss")).alias("loss"))


def _scored_docs(spark, sf):
    docs = X.table(spark, sf, "documents", ["doc_id", "n_chars"])
    lab = X.table(spark, sf, "labels", ["doc_id", "quality"])
    return docs.join(lab, "doc_id")


@query("threshold_accuracy")
def threshold_accuracy(spark, sf):
    d = E.vector_scale(_scored_docs(spark, sf), "n_chars", out="p")
    return M.threshold_accuracy(d, "p", "quality").select(r6(F.col("accuracy")).alias("accuracy"))


@query("roc_curve")
def roc_curve(spark, sf):
    out = M.roc_curve(_scored_docs(spark, sf), "n_chars", "quality")
    return out.select(r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"),
                      r6(F.col("threshold")).alias("threshold"))


@query("auc")
def auc(spark, sf):
    return M.auc(_scored_docs(spark, sf), "n_chars", "quality").select(r6(F.col("auc")).alias("auc"))


# ------------------------------------------------------------------ N1-N10
from tabaudit.operators import neighbors as N  # noqa: E402
from tabaudit.operators import privacy as PV  # noqa: E402


def _emb(spark, sf):
    return X.table(spark, sf, "embeddings", ["vec_id", "label", "embedding"]).select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("paired_distance")
def paired_distance(spark, sf):
    e = _emb(spark, sf)
    per = (e.select("label", F.posexplode("x").alias("pos", "v"))
            .groupBy("label", "pos").agg(F.avg("v").alias("m")))
    cent = per.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("x"))
    j = e.join(cent.withColumnRenamed("x", "c"), "label")
    return j.select("vec_id",
                    r6(N.vector_distance(F.col("x"), F.col("c"), "euclidean")).alias("euclidean"),
                    r6(N.vector_distance(F.col("x"), F.col("c"), "cosine")).alias("cosine"),
                    r6(N.vector_distance(F.col("x"), F.col("c"), "cityblock")).alias("cityblock"))


@query("nn_self")
def nn_self(spark, sf):
    out = N.nearest_neighbors(_emb(spark, sf), None, "euclidean", id_col="vec_id")
    return out.select("vec_id", r6(F.col("dist")).alias("dist"))


def _enc_roles(spark, sf):
    """Every role encoded by the train rows' spec, from one first pass."""
    enc = _all_roles(spark, sf)
    return {k: enc.group(k) for k in ("train", "test", "synth")}


@query("nn_cross")
def nn_cross(spark, sf):
    e = _enc_roles(spark, sf)
    out = N.nearest_neighbors(e["test"].df, e["synth"].df, "euclidean")
    return out.select("row_id", r6(F.col("dist")).alias("dist"))


def _memorization(spark, sf):
    e = _enc_roles(spark, sf)
    return PV.memorization(e["train"], e["synth"], "euclidean", seed=X.SEED)


@query("memorization")
def memorization(spark, sf):
    return _memorization(spark, sf).select("row_id", "kind", r6(F.col("dist")).alias("dist"))


@query("mean_nn")
def mean_nn(spark, sf):
    return PV.mean_nn(_memorization(spark, sf)).select("kind", r6(F.col("mean_dist")).alias("mean_dist"))


@query("distance_histogram")
def distance_histogram(spark, sf):
    h = PV.distance_histogram(_memorization(spark, sf), 30)
    return h.select("kind", "bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


@query("cosine_min")
def cosine_min(spark, sf):
    e = _emb(spark, sf)
    out = N.nearest_neighbors(e.filter(F.col("label") < 5), e.filter(F.col("label") >= 5),
                              "cosine", id_col="vec_id")
    return out.select("vec_id", r6(F.col("dist")).alias("dist"))


def _membership(spark, sf):
    e = _enc_roles(spark, sf)
    return PV.membership_scores(e["train"], e["test"], e["synth"])


@query("membership_score")
def membership_score(spark, sf):
    s = _membership(spark, sf)
    return s.select("row_id", "label", r6(F.col("dist")).alias("dist"), r6(F.col("prob")).alias("prob"))


@query("membership_attack")
def membership_attack(spark, sf):
    return M.auc(_membership(spark, sf), "prob", "label").select(r6(F.col("auc")).alias("auc"))


@query("membership_roc")
def membership_roc(spark, sf):
    """N7's curve, over probabilities of 6 digits."""
    s = _membership(spark, sf).withColumn("prob", r6(F.col("prob")))
    return M.roc_curve(s, "prob", "label").select(r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"), r6(F.col("threshold")).alias("threshold"))


@query("summary_membership")
def summary_membership(spark, sf):
    from tabaudit.operators.report import summarize_membership
    return summarize_membership(M.auc(_membership(spark, sf), "prob", "label"))


# ------------------------------------------------------------------ S5, S8
@query("default_header")
def default_header(spark, sf):
    from tabaudit.sources.files import with_default_header
    return with_default_header(X.table(spark, sf, "customer"))


@query("example_dataset")
def example_dataset(spark, sf):
    return X.example_dataset(X.table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey")


# ---------------------------------------------------------------- R4-R11
OUTCOME = "tier"


def _stacked(spark, sf):
    return _all_roles(spark, sf)


@query("feature_effect")
def feature_effect(spark, sf):
    out = R.feature_effect(_stacked(spark, sf), OUTCOME)
    return out.select("feature", *[F.round(F.col(c), 4).alias(c)
                                   for c in ("effect_real_train", "effect_real_test", "effect_synth")])


def _xy(spark, sf):
    enc = _stacked(spark, sf)
    xy, _ = E.split_outcome(enc, OUTCOME)
    return {k: xy.filter(F.col("role") == F.lit(k)).drop("role") for k in ("train", "test", "synth")}


@query("predict_lr")
def predict_lr(spark, sf):
    xy = _xy(spark, sf)
    res = R.validate_prediction(xy["train"], xy["test"], "lr", seed=X.SEED)
    return res["scores"].select("row_id", "y", F.round("p", 4).alias("p"))


@query("predict_mlp")
def predict_mlp(spark, sf):
    xy = _xy(spark, sf)
    res = R.validate_prediction(xy["train"], xy["test"], "mlp", n_epoch=5, seed=X.SEED)
    return res["scores"].select("row_id", "y", F.round("p", 4).alias("p"))


@query("train_on_synth")
def train_on_synth(spark, sf):
    xy = _xy(spark, sf)
    res = R.gan_train(xy["synth"], xy["test"], model_type="lr", seed=X.SEED)
    return res["auc"].select(F.lit("gan_train").alias("arm"), F.round("auc", 4).alias("auc"))


@query("test_on_synth")
def test_on_synth(spark, sf):
    xy = _xy(spark, sf)
    res = R.gan_test(xy["synth"], xy["test"], model_type="lr", seed=X.SEED)
    return res["auc"].select(F.lit("gan_test").alias("arm"), F.round("auc", 4).alias("auc"))


@query("train_test_comparison")
def train_test_comparison(spark, sf):
    res = R.train_test_comparison(_stacked(spark, sf), OUTCOME, "lr", seed=X.SEED)
    return res["auc"].select("arm", F.round("auc", 4).alias("auc"), "status")


def _named_residuals(data, betas, feats, arms, penalty):
    """(arm, feature, residual) of fitted arms; 4 digits, as the sums have some 1e5 terms."""
    names = data.sparkSession.createDataFrame([(k, a) for k, a in enumerate(arms)], "arm int, name string")
    labels = data.sparkSession.createDataFrame(list(enumerate([f.label for f in feats] + ["intercept"])), "pos int, feature string")
    out = R.optimality(data, betas, penalty).join(names, "arm").join(labels, "pos")
    return out.select(F.col("name").alias("arm"), "feature", (F.round("residual", 4) + F.lit(0.0)).alias("residual"))


@query("effect_residual")
def effect_residual(spark, sf):
    """How far the effects of each table are from the conditions of the L2 minimum."""
    from tabaudit.session import cut_lineage
    enc, roles = _stacked(spark, sf), ["train", "test", "synth"]
    xy, feats = E.split_outcome(enc, OUTCOME)
    data = cut_lineage(xy.select(R._number(F.col("role"), roles).alias("arm"), "y", "x"))
    return _named_residuals(data, R.fit_arms(data, len(feats), 3, 1.0, "l2"), feats, roles, "l2")


@query("arm_residual")
def arm_residual(spark, sf):
    """How far the models of the three arms are from the conditions of the L1 minimum."""
    enc = _stacked(spark, sf)
    data, d = R.comparison_arms(enc, OUTCOME, X.SEED)
    fitted = data.where("arm IS NOT NULL").select("arm", "y", "x")
    feats = E.split_outcome(enc, OUTCOME)[1]
    return _named_residuals(fitted, R.fit_arms(fitted, d, 3), feats, R.ARMS, "l1")


@query("arm_rows")
def arm_rows(spark, sf):
    """The rows that each arm is fitted and tested on, with their outcome."""
    data, _ = R.comparison_arms(_stacked(spark, sf), OUTCOME, X.SEED)
    return data.select("row_id", "y", "arm", "on_real", "on_synth")


@query("constant_outcome_guard")
def constant_outcome_guard(spark, sf):
    """R8 on each table's outcome, and on the train rows of either class."""
    xy = _split_xy_all(spark, sf)
    arms = {r: xy.where(F.col("role") == r) for r in ("train", "test", "synth")}
    arms |= {f"train_{y}": arms["train"].where(F.col("y") == y) for y in (0, 1)}
    rows = [(arm, bool(R.constant_outcome(df))) for arm, df in arms.items()]
    return spark.createDataFrame(rows, "arm string, constant boolean")


def _split_xy_all(spark, sf):
    xy, _ = E.split_outcome(_stacked(spark, sf), OUTCOME)
    return xy


# ------------------------------------------------------------------ G3-G5
def _copula(spark, sf):
    enc = _enc_train(spark, sf)
    model = G.fit_copula(enc)
    n = enc.df.count()
    gen = G.sample_copula(spark, model, n, seed=X.SEED)
    return enc, enc.with_df(gen)


@query("generate_copula")
def generate_copula(spark, sf):
    _, gen = _copula(spark, sf)
    return gen.wide(DIGITS)


@query("generator_fidelity")
def generator_fidelity(spark, sf):
    """Every category, bit and missing flag that train rows have: whether the
    generated share is within 0.02 of the train share."""
    enc, gen = _copula(spark, sf)
    numbers = {i for i, f in enumerate(enc.features) if f.role == "value" and f.source in ("count", "continuous")}
    labels = [f for i, f in enumerate(enc.labels) if i not in numbers]
    out = R.univariate(enc, gen).where(F.col("feature").isin(labels) & (F.col("real") > 0))
    return out.select("feature", (F.abs(F.col("real") - F.col("synth")) <= 0.02).alias("ok"))


@query("generate_restore")
def generate_restore(spark, sf):
    _, gen = _copula(spark, sf)
    out = E.decode(gen)
    return out.select("row_id", "constant", "tier", "categorical", "priority",
                      r6(F.col("count")).alias("count"), r6(F.col("continuous")).alias("continuous"))


def _tree(spark, sf):
    from tabaudit.operators import tree as T
    train = _roles(spark, sf)["train"]
    model = T.fit_tree(train, "row_id", sentinel=X.SENTINEL)
    return T, train, model


@query("generate_tree")
def generate_tree(spark, sf):
    """G4 by a dependence tree: as many rows as the train table has."""
    T, train, model = _tree(spark, sf)
    out = T.sample_tree(spark, model, train.count(), seed=X.SEED)
    return out.withColumns({c: r6(F.col(c)) for c in ("count", "continuous")})


@query("tree_joint_shares")
def tree_joint_shares(spark, sf):
    """For all pairs of columns and all pairs of states that train rows have:
    whether the generated share of the pair is within 0.03 of the train share."""
    from tabaudit.session import cut_lineage
    T, train, model = _tree(spark, sf)
    n = train.count()
    gen = T.sample_tree(spark, model, n, seed=X.SEED)
    real, synth = (T.pair_counts(T.states(df, model), X.FEATURES) for df in (train, gen))
    both = cut_lineage(real.join(synth.withColumnRenamed("n", "m"), ["a", "b", "va", "vb"], "left"))
    off = F.abs(F.col("n") - F.coalesce(F.col("m"), F.lit(0))) / F.lit(float(n))
    return both.groupBy("a", "b").agg(F.bool_and(off <= 0.03).alias("ok"), (F.sum("n") == n).alias("whole"))


# ------------------------------------------------------------ S1, S4, S6
@query("file_roundtrip")
def file_roundtrip(spark, sf):
    from tabaudit.session import scratch_path
    from tabaudit.sources.files import read_table, write_table
    c = _cohort(spark, sf)
    path = scratch_path(spark, "roundtrip") + ".csv"
    write_table(c, path)
    back = read_table(spark, path, fmt="csv")
    return back.select(F.col("row_id").cast("long").alias("row_id"), "constant", "tier", "categorical",
                       "priority", F.col("count").cast("double").alias("count"),
                       F.col("continuous").cast("double").alias("continuous"))


@query("file_row_ids")
def file_row_ids(spark, sf):
    """S1 for files without a key: the cohort in order of its keys, written
    without them to several files, and numbered by reading them."""
    from tabaudit.session import scratch_path
    from tabaudit.sources.files import read_table, write_table
    path = scratch_path(spark, "keyless") + ".csv"
    write_table(_cohort(spark, sf).repartitionByRange(5, "row_id").sortWithinPartitions("row_id").drop("row_id"), path)
    back = read_table(spark, path, fmt="csv", row_id="line")
    return back.select("line", "tier", "categorical", "priority", F.col("continuous").cast("double").alias("continuous"))


@query("summary_nearest")
def summary_nearest(spark, sf):
    from tabaudit.operators.report import summarize_nearest
    return summarize_nearest(_memorization(spark, sf), n_decimal=2)


@query("feather_roundtrip")
def feather_roundtrip(spark, sf):
    """Cohort -> Feather files written by the executors -> read back by
    the Python data source (one partition per file)."""
    from tabaudit.session import scratch_path
    from tabaudit.sources.files import read_table, write_feather
    path = scratch_path(spark, "feather")
    write_feather(_cohort(spark, sf), path)
    return read_table(spark, path, fmt="feather").select(
        "row_id", "constant", "tier", "categorical", "priority", "count", "continuous")


@query("npy_roundtrip")
def npy_roundtrip(spark, sf):
    """S3: cohort -> .npy matrices of bounded size (header row + text cells),
    written by the executors -> read back file-parallel and re-typed."""
    from tabaudit.session import scratch_path
    from tabaudit.sources.files import read_table, write_npy
    path = scratch_path(spark, "npy")
    write_npy(_cohort(spark, sf), path)
    back = read_table(spark, path, fmt="npy")
    return back.select(F.col("row_id").cast("long").alias("row_id"), "constant", "tier", "categorical",
                       "priority", F.col("count").cast("double").alias("count"),
                       F.col("continuous").cast("double").alias("continuous"))
