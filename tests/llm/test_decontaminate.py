import hashlib
import re

import pytest

from tabaudit.llm import decontaminate as D
from tests.llm.helpers import clashing, docs

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(data, items):
    out = []
    for d, t in data:
        ws, hit, found = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(len(iw), 10)
            for i in range(len(iw) - n + 1) if n else ():
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[i:i + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, data, items, **kw):
    d = spark.createDataFrame(data, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = D.decontaminate(d, i, **kw).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in out), key=repr)


DATA = [
    (1, f"before {LONG} after"), (2, LONG.upper().replace(" ", "--")), (3, " ".join(LONG.split()[:9])), (4, None), (5, ""),
    (6, "..."), (7, f"{LONG} x {LONG}"), (7, f"{LONG} x {LONG}"), (None, f"y {' '.join(LONG.split()[2:12])}"),
    (8, "Éa éa kurz wort hier"), (9, "w " * 3000 + LONG), (10, "éa kurz"), (11, " ".join(LONG.split()[::-1])),
]
ITEMS = [(10, LONG), (2, f"zero {LONG}"), (3, "kurz wort"), (4, None), (5, "!!"), (6, "Éa"), (10, LONG), (7, "unseen words that nobody wrote in any of the documents here at all")]


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 0}, {"k": 3}, {"k": 10}])
def test_matches_brute_force(spark, kw):
    assert run(spark, DATA, ITEMS, **kw) == brute(DATA, ITEMS)


def test_every_shared_span_of_ten_words_shares_a_fingerprint(spark):
    import random
    rng = random.Random(3)
    span = [f"s{i}" for i in range(10)]
    data = [(i, " ".join([f"a{rng.random()}" for _ in range(rng.randrange(30))] + span + [f"b{rng.random()}" for _ in range(rng.randrange(30))]))
            for i in range(60)]
    assert all(r[2] == 10 for r in run(spark, data, [(1, " ".join(["x", *span, "y"]))]))


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DATA, []) == brute(DATA, [])
    df = clashing(docs(spark, [(1, LONG, "en", "s", 3)]), "ws", "lens", "text_key", "item_id", "window", "n_hit")
    assert D.decontaminate(df, spark.createDataFrame([(1, LONG)], "item_id long, text string")).first()["n_hit"] == 13
