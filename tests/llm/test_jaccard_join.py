import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabaudit.llm import jaccard_join as J
from tests.conftest import SF001
from tests.llm.helpers import clashing, docs


def shingles(t):
    w = (t or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for group in holders.values():
        for i in group:
            for j in group:
                if i < j and find(i) != find(j):
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in J.similarity_components(df, **kw).collect()), key=repr)


def corpus(seed, n=120):
    """Copies, near copies on both sides of the threshold, chains, a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows, last = [], [word() for _ in range(60)]
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            last = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 200]))]
        elif kind < 4:
            last = last.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                last[rng.randrange(len(last))] = word()
            if rng.random() < 0.3:
                last += [word() for _ in range(rng.randrange(4))]
        text = " ".join(last if kind < 5 else [word() for _ in range(60)] + passage)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"frequent": 3}), (3, {"chunk_sets": 2, "frequent": 5}), (6, {"chunk_tokens": 100}), (4, {"likely": 101}), (5, {"likely": 0})])
def test_matches_brute_force(spark, seed, kw):
    rows = corpus(seed)
    assert run(spark, rows, **kw) == brute(rows)


def test_awkward_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "ONE  two"), (9, "two one"), (10, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"),
            (2, "quite another text with the id of a copy"), (None, "a b c d e"), (None, "nobody has this text but a row without id"), (11, long), (4, long + " end"),
            (12, "É b c d e f"), (13, "é b c d e f"), (14, " a b c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = clashing(docs(spark, [(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1)]), "sig", "nid", "n", "group", "gid", "label", "component_id", "_id")
    assert sorted(tuple(r) for r in J.similarity_components(df).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_sets_are_those_of_each_text():
    texts = ["a b c d e f", None, "", "  a  b ", "A B C D E F", "a b c d e f a b c d e", "e f"]
    got = [len(s) for s in J.shingle_sets(pa.array(texts))]
    assert got == [len(shingles(t)) for t in texts]
    s = list(J.shingle_sets(pa.array(texts)))
    assert (s[0] == s[4]).all() and not len(np.intersect1d(s[3], s[6]))


def test_prefixes_of_similar_sets_meet_often_enough():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        base = rng.choice(10 ** 6, n + 30, replace=False).astype(np.uint64) << np.uint64(40)
        a = np.sort(base[:n])
        b = np.sort(np.concatenate((base[int(rng.integers(0, max(1, n // 5))):n], base[n:n + int(rng.integers(0, max(1, n // 6)))])))
        often = np.sort(rng.choice(base, 10, replace=False)) >> np.uint64(32), rng.integers(9, 12, 10)
        if J.similar(a, b):
            shared = len(np.intersect1d(J.prefix(a, often, 0), J.prefix(b, often, 0)))
            overlap = -(-80 * (len(a) + len(b)) // 180)
            assert shared >= max(1, overlap - (-(-80 * max(len(a), len(b)) // 100) - 1) - 1)


def test_components_of_a_long_chain(spark):
    links = [(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(300)]
    random.Random(1).shuffle(links)
    out = J.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert len(out) == 301 and {bytes(r.label) for r in out} == {b"\x00\x00"}


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)
