import numpy as np
import pyarrow as pa

from tabaudit.llm import langid as L
from tabaudit.llm.common import text_buffers
from tests.llm.helpers import clashing, docs
from tests.conftest import SF01

LOREM = {"en": "the quick brown fox jumps over the lazy dog and then it was there with them ",
         "de": "der schnelle braune fuchs springt über den faulen hund und dann war er nicht da ",
         "fr": "le renard brun rapide saute par dessus le chien paresseux et puis il était là "}


def learned(spark):
    data = []
    for k, (lang, t) in enumerate(LOREM.items()):
        ws = t.split()
        data += [(1000 * k + i, " ".join(ws[(i + j) % len(ws)] for j in range(3 + i % 9)), lang, "s", 0) for i in range(40)]
    return docs(spark, data)


def brute_grams(text):
    m, out = "", []
    for c in text:
        c = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " "
        if not (c == " " and m.endswith(" ")):
            m += c
    for n in L.ORDERS:
        out += [m[i:i + n] for i in range(len(m) - n + 1) if not (n == 1 and m[i] == " ")]
    return out


def test_grams_are_those_of_each_text():
    texts = ["Ab, cÉ", None, "", "..", "xßy z", "İI 日本"]
    data, offsets = text_buffers(pa.array(texts))
    got = [0] * len(texts)
    cells = [[] for _ in texts]
    for c, d in L.grams(data, offsets):
        for cell, doc in zip(c.tolist(), d.tolist()):
            got[doc] += 1
            cells[doc].append(cell)
    assert got == [len(brute_grams(t or "")) for t in texts]
    again = [sorted(c) for c in cells]
    for i, t in enumerate(texts):  # a text alone has the cells that it has among others
        data, offsets = text_buffers(pa.array([t], pa.string()))
        assert sorted(x for c, _ in L.grams(data, offsets) for x in c.tolist()) == again[i]


def test_predicts_held_out_and_awkward_rows(spark):
    model = L.fit(L.learning_rows(learned(spark)))
    assert model.languages == ["de", "en", "fr"] and (model.weights == 0).mean() > 0.9
    rows = [(1, "the dog was there and it jumps", None, None, 0), (2, "der hund war nicht da und springt", None, None, 0),
            (3, None, None, None, 0), (4, "", None, None, 0), (5, "123 !!", None, None, 0), (None, "le chien était là", None, None, 0),
            (1, "the dog was there and it jumps", None, None, 0), (6, "the fox " * 20000, None, None, 0)]
    out = L.predict(clashing(docs(spark, rows), "score", "lang_pred", "cells"), model)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "cells" in out.columns
    got = {(r.doc_id, r.lang_pred) for r in out.collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "fr"), (6, "en")}
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == len(rows)


def test_no_learning_rows(spark):
    model = L.fit(L.learning_rows(docs(spark, [])))
    out = L.predict(docs(spark, [(1, "hello", "en", "s", 5)]), model).first()
    assert (out.lang_pred, out.score) == ("und", 0.0)
    assert L.predict(docs(spark, []), model).count() == 0


def test_document_frequencies_cover_all_texts(spark):
    texts = ["ab", "ab", None, "", "b"]
    df, n = L.document_frequencies(docs(spark, [(i, t, "x", "s", 0) for i, t in enumerate(texts)]).repartition(3))
    data, offsets = text_buffers(pa.array(["b"]))
    cell = next(c for c, _ in L.grams(data, offsets))[0]
    assert n == 5 and df[cell] == 3


def test_accuracy_on_the_test_tables(spark):
    out = L.op7_langid(spark, SF01)
    docs_ = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs_, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98


def test_parts_of_a_long_text_have_its_grams():
    text = ("Ab  c, Été dans l'été 12 x  " * 50 + " \n z").encode()
    data = np.frombuffer(text, np.uint8)
    whole = np.sort(np.concatenate(list(L._cells(data, np.array([0, len(data)])))))
    for limit in (1, 2, 7, 50, 10 ** 6):
        assert np.array_equal(whole, np.sort(np.concatenate(list(L.long_grams(data, limit)))))
