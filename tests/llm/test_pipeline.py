import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tabaudit.llm import langid, packing, toxicity
from tests.conftest import SF001
from tests.llm.helpers import clashing, crc, docs
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_jaccard_join import brute as brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_brute_force(spark):
    """Each stage on what the one before kept; the models are deterministic,
    so their own predictions say what stages 1 and 2 must keep."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = C.language_stage(spark, docs, SF001)
    assert kept.columns == COLUMNS
    model = langid.fit(langid.learning_rows(docs))
    said = langid.predict(docs, model).collect()
    expect = {r.doc_id for r in said if r.lang_pred != "und" and r.score >= C.MIN_LANGUAGE_SCORE}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == expect and len(ids) >= 0.98 * len(rows)

    clean = C.toxicity_stage(spark, kept, SF001)
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    scores = toxicity.score(kept, toxicity.fit(kept, labels)).collect()
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores if r.score < toxicity.THRESHOLD}

    single = C.near_duplicate_stage(spark, clean, SF001)
    have = [(r.doc_id, r.text) for r in clean.collect()]
    assert single.columns == COLUMNS
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute_components(have)})

    free = C.decontamination_stage(spark, single, SF001)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in single.collect()]
    hit = {d for d, _, _, _, _, bad in brute_windows(left, items) if bad}
    assert hit and free.columns == COLUMNS and {r.doc_id for r in free.collect()} == {d for d, _ in left} - hit

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expect = {}
    for d in {d for d, _ in left} - hit:
        ids = t.encode(rows[d] or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.piece_cuts(len(ids), packing.CAPACITY)):
            expect[d, k] = (a, n, crc(ids[a:a + n]))
    packed = C.packing_stage(spark, free, SF001).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == expect
    assert C.run(spark, SF001).count() == len(packed)


def test_stages_take_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f g h i j k", "en", "s", 1),
                      (2, "a b c d e f g h i j k", "en", "s", 1), (3, "word " * 30000, None, None, None)]):
        for name, stage in C.STAGES[:-1]:
            df = clashing(spark.createDataFrame(data, schema), "sig", "text_key", "score", "label", "_keep")
            out = stage(spark, df, SF001)
            assert out.columns == df.columns, name
            rows = [tuple(r) for r in out.collect()]
            assert {r[0] for r in rows} <= {r[0] for r in data}
        assert C.packing_stage(spark, spark.createDataFrame(data, schema), SF001).count() >= len(data)


def test_near_duplicates_keep_a_row_of_every_component(spark):
    """Ids that are NULL or repeated lose no component."""
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(20)) for w in ("ash", "elm", "oak", "fir"))
    rows = [(None, one), (None, two), (None, two + " more"), (1, three), (1, four), (2, three), (2, four + " more"), (3, two), (3, two),
            (None, ""), (None, ""), (None, None), (4, None), (4, ""), (4, "")]
    df = docs(spark, [(i, t, "en", "s", 0) for i, t in rows])
    expect = [(1, four), (1, three), (3, two), (4, ""), (4, None), (None, ""), (None, ""), (None, None), (None, one)]
    got = [(r.doc_id, r.text) for r in C.near_duplicate_stage(spark, df.repartition(7), SF001).collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)
