import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from tabaudit.llm import toxicity as X
from tests.conftest import SF01
from tests.llm.helpers import clashing, docs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    words = {"idiot": 5.0, "moron": 4.0, "scum": 3.0, "morons": 2.0}
    stems = {"trash": 2.5}
    a = X.LexiconAutomaton(words, stems)
    pool = set(words)
    for w in words:
        for i in range(len(w) + 1):
            for c in "aixz":
                pool |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:], w[:i] + c + w[i:] + c}
    pool |= {"trashy", "trash", "trasher", "tras", "xtrash", "", "m", "scumm", "scu"}
    for w in pool:
        if w in words:
            exp = (words[w], 0)
        elif any(w.startswith(s) for s in stems):
            exp = (2.5, 1)
        else:
            near = [words[x] for x in words if len(x) >= X.FUZZY_LETTERS and w[:1] == x[0] and edits(w, x) <= 1]
            # an edit after the first letter; the first letter is taken as written
            exp = (max(near), 2) if near else (0.0, 1)
        assert a.match(w)[0] == exp[0] and (not exp[0] or a.match(w)[1] == exp[1]), w


def test_one_edit():
    for a, b in itertools.product(["", "a", "ab", "abc", "abd", "bc", "abcd", "xabc"], repeat=2):
        assert X._one_edit(a, b) == (edits(a, b) <= 1), (a, b)


def test_features_know_spelling_and_quotation():
    model = X.ToxicityModel({"idiot": 5.0, "scum": 4.0}, {})
    s = X.Scanner(model)
    assert [m[0] for m in s.features("You IDIOT, id1ot, idi*t, idioot and scum!!")[1]] == ["idiot", "id1ot", "idi*t", "idioot", "scum"]
    x, found = s.features('They said "you idiot" to us.')
    assert found[0][4] and x[3] > 0 and x[0] == 0
    x, found = s.features("You are an idiot.")
    assert not found[0][4] and x[0] > 0 and x[3] == 0
    assert s.features("A clean text.")[1] == [] and s.features("")[1] == []


def test_swapped_masked_and_signed_misspellings():
    s = X.Scanner(X.ToxicityModel({"idiot": 5.0, "disgusting": 4.0, "scum": 3.0, "stupid": 2.0, "clown": 1.0}, {}, {"clowns", "scam"}))
    said = {m[0]: m[2] for m in s.features("idoit disgsuting sc*m scuum $cum $tupid @idiot !$tupid clowns clwon cl0wn scam scan")[1]}
    assert said == {"idoit": 5.0, "disgsuting": 4.0, "sc*m": 3.0, "scuum": 3.0, "$cum": 3.0, "$tupid": 2.0, "@idiot": 5.0, "clwon": 1.0, "cl0wn": 1.0}
    assert s.features("an $tupid remark")[1][0][:2] == ("$tupid", 1)
    assert s.features("it costs $100 @home !now |x")[1] == []


def labelled(spark):
    rng = np.random.default_rng(5)
    pool = [f"w{a}{b}ord" for a in "abcdefgh" for b in "ijklmnop"]
    data, labels = [], []
    for i in range(400):
        ws = list(rng.choice(pool, 30))
        bad = i % 5 == 0
        if bad:
            ws[3] = ["blockhead", "nitwitted"][i % 2]
        data.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return docs(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_scores_awkward_rows(spark):
    d, labels = labelled(spark)
    model = X.fit(d, labels)
    assert {"blockhead", "nitwitted"} <= set(model.words) and len(model.words) <= 4
    rows = [(1, "wai word blockhead waj", None, None, 0), (2, "waiord wajord", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0),
            (None, "nitwitted " * 9, None, None, 0), (2, "waiord wajord", None, None, 0), (5, "waiord " * 50000 + "blockhead", None, None, 0)]
    out = X.score(clashing(docs(spark, rows), "score", "n_matches", "toxic"), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[1] >= X.THRESHOLD and by[None] >= X.THRESHOLD and max(by[2], by[3], by[4]) < X.THRESHOLD


def test_a_clean_near_miss_leaves_the_other_misspellings(spark):
    """A clean text with 'clowns' takes that word out, not what else looks like 'clown'."""
    d, labels = labelled(spark)
    first = next(i for i in range(1, 400) if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2)
    text = F.replace(F.replace("text", F.lit("blockhead"), F.lit("clown")), F.lit("nitwitted"), F.lit("loser"))
    d = d.withColumn("text", F.when(F.col("doc_id") == first, F.concat(F.lit('two clowns played, "clownn" was said '), text)).otherwise(text))
    model = X.fit(d, labels)
    assert "clown" in model.words and not model.stems and model.clean == {"clowns"}
    s = X.Scanner(model)
    assert [m[0] for m in s.features("clowns clwon clownn cl0wn clowwn")[1]] == ["clwon", "clownn", "cl0wn", "clowwn"]


def test_labels_of_the_held_out_quarter_are_not_read(spark):
    d, labels = labelled(spark)
    sample, stands_for = X.draw_sample(d, labels)
    texts = {r.text: r.doc_id for r in d.collect()}
    assert {texts[r.text] for r in sample.collect()} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert stands_for == {0: 1.0, 1: 1.0}


def test_the_sample_is_bounded_and_copies_count_once(spark):
    d, labels = labelled(spark)
    hot = docs(spark, [(1, "one and the same row", "en", "s", 0)] * 500)
    sample, stands_for = X.draw_sample(d.unionByName(hot), labels, max_toxic=20, max_clean=40)
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert 5 <= n[1] <= 40 and 15 <= n[0] <= 80 and stands_for[1] > 2


def test_no_labels(spark):
    d, labels = labelled(spark)
    model = X.fit(d, labels.limit(0))
    assert all(r.score < X.THRESHOLD for r in X.score(d, model).collect())
    assert X.score(d.limit(0), model).count() == 0


def test_precision_on_the_test_tables(spark):
    out = X.op1_toxicity(spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    said = [r for r in rows if r.predicted]
    assert said and sum(r.toxic for r in said) >= 0.8 * len(said)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic for r in rows)
