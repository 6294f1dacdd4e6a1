"""Merkle manifest and octopus proofs against a tree built by plain loops."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabaudit.llm import merkle as M
from tests.llm.helpers import SCHEMA, clashing, docs


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text=None):
    doc_id, t, lang, source, n = row
    t = t if text is None else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, t)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """Siblings left to right, and how a digest folds to the top."""
    runs = []
    for level in tree[:-1]:
        a = i // 8 * 8
        runs.append((level[a:i], level[i + 1:a + 8]))
        i //= 8
    return runs


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for c in langs:
        trees[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[c] = levels([leaf(r) for r in trees[c]])
    top = levels([built[c][-1][0] for c in langs])
    out = []
    for k, c in enumerate(langs):
        for i, r in enumerate(trees[c]):
            runs = path(built[c], i) + path(top, k)
            shown = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                shown = leaf(r, "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in r[1]))
            for left, right in runs:
                shown = h("".join([*left, shown, *right]))
            out.append((r[0], leaf(r), built[c][-1][0], top[-1][0], h("".join(x for a, b in runs for x in a + b)), shown, shown == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_proofs_equal_a_plain_tree(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, i, i, i - 1]), rng.choice([None, "", "Ab c", "é" * 50, "x Y " * 400]) if i % 2 else f"Text {i}",
             rng.choice(["de", "en", "en", "en", None, "zh"]), rng.choice(["s", None]), rng.choice([None, i])) for i in range(700)]
    rows += [rows[5]] * 3 + [(9999, "Lone", "it", "s", 4)]
    assert got(M.prove_documents(clashing(docs(spark, rows), "leaf", "idx", "n", "tree", "root"))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_small_trees(spark, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert got(M.prove_documents(docs(spark, rows, SCHEMA))) == brute(rows)


def test_a_part_of_the_leaves(spark):
    """Coordinates of a subset are the least ones, and its proofs those of the whole."""
    rows = [(i, f"T{i}", "en", "s", i) for i in range(300)]
    frame = docs(spark, rows).select("doc_id", F.lit("=en").alias("tree"), M.leaf_digest(*[F.col(c) for c in M.FIELDS]).alias("leaf"))
    manifest = M.build(frame, "doc_id")
    part = manifest.leaves.where("doc_id % 37 = 5").withColumn("key", F.col("doc_id").cast("string"))
    want = {str(r[0]): r[4] for r in brute(rows)}
    found = {r["key"]: (r["proof"], r["folded_root"] == r["root"]) for r in M.prove(part, manifest, "digest").collect()}
    assert found == {str(i): (want[str(i)], True) for i in range(300) if i % 37 == 5}


def test_missing_coordinates_are_minimal():
    assert M.missing_coordinates([0], 1) == []
    assert M.missing_coordinates([0, 1, 2, 3, 4, 5, 6, 7], 8) == []
    assert M.missing_coordinates([8], 9) == [(1, 0)]
    asked = M.missing_coordinates([0, 1, 9], 20)
    assert asked == [(0, i) for i in range(2, 8)] + [(0, 8), *[(0, i) for i in range(10, 16)]] + [(1, 2)]
