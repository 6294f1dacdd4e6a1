"""Nearest neighbours (N1-N3, N5): literal cases and blocked plan vs brute
force with several blocks per side."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import neighbors as N


def vecs(spark, rows, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(rows)],
                                 "row_id long, x array<double>")


def test_paired_distance_literals(spark):
    a = vecs(spark, [[1, 1]])
    b = vecs(spark, [[2, 1]])
    assert N.paired_distance(a, b, "row_id", "euclidean").first()["dist"] == 1.0
    c = vecs(spark, [[1, 1]])
    assert N.paired_distance(a, c, "row_id", "hamming").first()["dist"] == 0.0


def test_nn_three_points(spark):
    df = vecs(spark, [[1, 1], [4, 4], [5, 4]])
    out = {r["row_id"]: r["dist"] for r in N.nearest_neighbors(df).collect()}
    assert math.isclose(out[0], math.sqrt(18)) and out[1] == 1.0 and out[2] == 1.0


def test_self_exclusion_by_id_duplicates_are_zero(spark):
    df = vecs(spark, [[1, 2], [1, 2], [7, 7]])
    out = {r["row_id"]: r["dist"] for r in N.nearest_neighbors(df).collect()}
    assert out[0] == 0.0 and out[1] == 0.0


def brute(a, b, metric, self_join):
    out = []
    for i, x in enumerate(a):
        ds = []
        for j, y in enumerate(b):
            if self_join and i == j:
                continue
            if metric == "euclidean":
                ds.append(np.sqrt(((x - y) ** 2).sum()))
            elif metric == "cosine":
                nx, ny = np.linalg.norm(x), np.linalg.norm(y)
                if nx == 0 or ny == 0:
                    continue
                ds.append(1 - x @ y / (nx * ny))
            elif metric == "cityblock":
                ds.append(np.abs(x - y).sum())
            elif metric == "hamming":
                ds.append((x != y).mean())
        out.append(min(ds) if ds else None)
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "cityblock", "hamming"])
@pytest.mark.parametrize("self_join", [True, False])
def test_blocked_matches_brute_force(spark, metric, self_join):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, (120, 5)).astype(float)
    b = a if self_join else rng.integers(0, 3, (70, 5)).astype(float)
    da = vecs(spark, a)
    db = None if self_join else vecs(spark, b, start=1000)
    got = {r["row_id"]: r["dist"] for r in N.nearest_neighbors(da, db, metric, block_rows=16).collect()}
    want = brute(a, b, metric, self_join)
    for i, w in enumerate(want):
        if w is None:
            assert got[i] is None
        else:
            assert math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-12)


def test_cosine_zero_vector_is_null(spark):
    a = vecs(spark, [[0, 0], [1, 0]])
    b = vecs(spark, [[1, 1]], start=10)
    out = {r["row_id"]: r["dist"] for r in N.nearest_neighbors(a, b, "cosine").collect()}
    assert out[0] is None and math.isclose(out[1], 1 - 1 / math.sqrt(2))


def test_vector_distance_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 2.0, 5.0])], "a array<double>, b array<double>")
    r = df.select(*[N.vector_distance(F.col("a"), F.col("b"), m).alias(m)
                    for m in ("euclidean", "cityblock", "chebyshev", "hamming")]).first()
    assert math.isclose(r["euclidean"], math.sqrt(5)) and r["cityblock"] == 3.0
    assert r["chebyshev"] == 2.0 and math.isclose(r["hamming"], 2 / 3)


def test_custom_metric(spark):
    N.register_metric("l4", lambda a, b: (np.abs(a - b) ** 4).sum(axis=1) ** 0.25)
    df = vecs(spark, [[0, 0], [1, 0], [3, 0]])
    out = {r["row_id"]: r["dist"] for r in N.nearest_neighbors(df, None, "l4").collect()}
    assert math.isclose(out[0], 1.0) and math.isclose(out[2], 2.0)


def _nn(spark, rows, other=None, metric="euclidean", kind="long"):
    a = spark.createDataFrame(rows, f"row_id {kind}, x array<double>")
    b = None if other is None else spark.createDataFrame(other, f"row_id {kind}, x array<double>")
    return {r["row_id"]: r["dist"] for r in N.nearest_neighbors(a, b, metric, block_rows=3).collect()}


def test_undefined_rows_are_null_and_no_candidates(spark):
    nan = float("nan")
    got = _nn(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [nan, 0.0]), (4, [None, 1.0]), (5, [0.0, 1.0])])
    assert got[1] == 1.0 and got[5] == 1.0 and got[3] is None and got[4] is None
    got = _nn(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])], [(1, [0.0, 0.0]), (2, [2.0, 0.0])], "cosine")
    assert abs(got[1]) < 1e-12 and got[2] is None
    assert _nn(spark, [(1, [1.0])]) == {1: None}


def test_large_offsets_are_exact(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = 1e8 + rng.random((200, 3))
    got = _nn(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(abs(got[i] - d[i].min()) <= 1e-9 for i in range(200))


def test_any_id_type_and_repeated_ids(spark):
    import pytest
    assert _nn(spark, [("a", [0.0]), ("b", [2.0])], kind="string") == {"a": 2.0, "b": 2.0}
    with pytest.raises(Exception, match="repeat"):
        _nn(spark, [(1, [0.0]), (1, [2.0]), (2, [5.0])])


def test_vectorised_metrics_match_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (40, 6)).astype(float)
    for metric in ("hamming", "cityblock", "chebyshev"):
        got = _nn(spark, [(i, v.tolist()) for i, v in enumerate(x)], metric=metric)
        for i in range(40):
            others = np.delete(x, i, 0)
            assert abs(got[i] - N.pair_distance(np.repeat(x[i:i + 1], 39, 0), others, metric).min()) < 1e-12


def test_boxes_spare_most_of_random_bits():
    from tabaudit.operators import pivots as P
    rng = np.random.default_rng(6)
    refs = np.unique(rng.integers(0, 2, (6000, 13)).astype(float), axis=0)
    x = np.hstack([rng.integers(0, 2, (300, 11)).astype(float), rng.random((300, 2))])
    d = np.sqrt(((x[:, None] - refs[None]) ** 2).sum(-1))
    tree = P.Tree(refs, 64)
    _, lo, hi = P.boxes(refs, tree.of, tree.leaves)
    tree.enclose(lo, hi)
    asked = np.zeros((300, tree.leaves), bool)
    for leaf, rows in tree.reached(x, d.min(axis=1) * (1 + 1e-9), "euclidean"):
        asked[rows, leaf] = True
    assert asked[np.arange(300), tree.of[d.argmin(axis=1)]].all() and asked.mean() < 0.2
    got = P.pruned_min(x, refs, np.arange(300), None, np.full(300, np.inf), "euclidean")
    assert np.allclose(got, d.min(axis=1), rtol=1e-12)


def test_rows_sent_at_a_time_are_bounded(spark, monkeypatch):
    from tabaudit.operators import pivots as P
    sizes, made = [], P._ask_rows

    def noted(qid, v, rows, kind, block, best):
        sizes.append(len(rows))
        return made(qid, v, rows, kind, block, best)

    import pyarrow as pa
    monkeypatch.setattr(P, "ASK_ROWS", 7)
    monkeypatch.setattr(P, "_ask_rows", noted)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 24))
    v = pa.array(x.tolist(), pa.list_(pa.float64()))
    tree = P.Tree(x, 2)
    _, lo, hi = P.boxes(x, tree.of, tree.leaves)
    n = np.bincount(tree.of)
    router = P.Router({0: tree}, {0: lo}, "euclidean", {(0, c): (int(n[c]), 1e9, lo[c], hi[c]) for c in range(tree.leaves)}, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), v, pa.array(np.full(40, np.inf))], names=["qid", "v", "b0"])
    sent = list(P.ask_others([batch], router, "euclidean"))
    assert max(sizes) <= 7 and sum(len(b) for b in sent) == 40 * (router.blocks - 1)


def test_vectors_are_worked_out_once_a_row(spark):
    """Both sides' expressions, however long, and the same distances."""
    from tabaudit.operators.pivots import nearest_by_kind
    calls = spark.sparkContext.accumulator(0)

    def shifted(x):
        calls.add(1)
        return [v + 1.0 for v in x]

    made = F.udf(shifted, "array<double>")
    a = vecs(spark, [[i, 2 * i] for i in range(20)]).select(F.col("row_id").alias("id"), made("x").alias("v"))
    b = vecs(spark, [[i + 0.25, 2 * i] for i in range(30)]).select(made("x").alias("v"))
    got = [r["dist"] for r in nearest_by_kind(a, {"b": b}, None).collect()]
    assert got == [0.25] * 20 and calls.value == 50


def test_cleaned_vectors(spark):
    from tabaudit.operators.pivots import cleaned
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, -0.0]), (2, [nan, 1.0]), (3, None), (4, [None, 1.0]), (5, [0.0, -0.0]), (6, [inf, 0.0]), (7, []), (8, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    got = {r["id"]: r["v"] for r in cleaned(df, "euclidean").collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: None, 4: None, 5: [0.0, 0.0], 6: None, 7: [], 8: [2.0, 3.0]}
    assert math.copysign(1, got[1][1]) == math.copysign(1, got[5][1]) == 1.0
    got = {r["id"]: r["v"] for r in cleaned(df, "cosine").collect()}
    assert [i for i, v in got.items() if v is not None] == [1, 8]
