import numpy as np
import pytest

from tabaudit.llm import topk as K
from tests.llm.helpers import clashing


def code(v):
    return sum(1 << (63 - i) for i, x in enumerate(v[:64]) if x is not None and x > 0)


def brute(rows, k, every):
    known = sorted({(i, code(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for q in sorted({(i, c) for i, c in known if i % every == 0}):
        near = sorted((bin(q[1] ^ c).count("1"), i) for i, c in known if i != q[0])[:k]
        out += [(q[0], r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def vectors(n, seed, copies=0, noise=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 64))
    rows = [(i, (centers[i % 6] + rng.normal(size=64) * (noise if i % 2 else 2.0)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in K.top_k(df, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"entry_block": 40, "query_block": 4}, {"k": 3, "segments": 8}, {"k": 400}])
def test_matches_brute_force(spark, kw):
    rows = vectors(260, 3, copies=60)
    assert run(spark, rows, **kw) == brute(rows, kw.get("k", 10), 20)


def test_awkward_rows(spark):
    v = [1.0] * 64
    rows = [(0, v), (1, v), (1, v), (2, None), (None, v), (20, [float("nan")] * 64), (3, [1.0]), (4, []), (5, [None] * 64), (6, [0.0] * 64), (40, v)]
    assert run(spark, rows) == brute([(i, None if x is None else [0.0 if y is None or y != y else y for y in x]) for i, x in rows], 10, 20)
    assert run(spark, []) == [] and run(spark, [(1, v)]) == [] and run(spark, [(20, v)]) == []
    df = clashing(spark.createDataFrame([(0, v), (1, v)], "vec_id long, embedding array<double>"), "id", "code", "rank", "distance", "n")
    assert [tuple(r) for r in K.top_k(df).collect()] == [(0, 1, 1, 0)]


def test_search_stops_only_when_the_kth_distance_is_covered():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2 ** 63, 3000, dtype=np.uint64))
    near = codes[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))
    codes = np.unique(np.concatenate((codes, near)))
    index = K.MultiIndex(codes)
    ones = np.ones(len(codes), np.int64)
    for q in codes[::200]:
        d = np.bitwise_count(codes ^ q).astype(int)
        for k in (1, 2, 9):
            at, far = index.search(q, k, ones, K.BITS)
            kth = np.sort(d)[k - 1]
            assert sorted(far.tolist()) == sorted(d[d <= kth].tolist()) and len(set(at.tolist())) == len(at)


def test_the_index_alone_answers():
    """Searches take codes from buckets only, far fewer than all, and find what a scan finds."""
    import numpy as np
    from tabaudit.llm import topk as T
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = np.unique(centres[rng.integers(0, 60, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    index = T.MultiIndex(codes)
    assert len(index.cuts) == T.segment_count(len(codes)) and sum(w for _, w in index.cuts) == 64
    for query in codes[::50]:
        at, d = index.search(query, 11, np.ones(len(codes), np.int64), 64)
        far = np.sort(np.bitwise_count(codes ^ query))
        assert np.array_equal(np.sort(d), far[far <= far[10]])
    assert index.looked_up < 0.5 * len(codes) * len(codes[::50])
