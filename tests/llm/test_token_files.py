import io

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabaudit.llm import token_files as F
from tabaudit.llm.files import shared_folder
from tests.llm.helpers import clashing, crc, docs

WORD = Tokenizer.from_file(public_tokenizers.path(F.TOKENIZER))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 49407) | st.integers(0, 2 ** 64 - 1), max_size=400))
def test_codec_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, escaped = F.encode_block(ids)
    assert (F.decode_block(words, escaped) == ids).all() and len(F.decode_block(words, escaped)) == len(ids)


def test_codec_sizes():
    assert len(F.encode_block(np.zeros(480, np.uint64))[0]) == 2
    assert len(F.encode_block(np.ones(60, np.uint64))[0]) == 1
    assert len(F.encode_block(np.full(4, 2 ** 15 - 1, np.uint64))[0]) == 1
    words, escaped = F.encode_block(np.array([2 ** 60, 2 ** 60 - 1], np.uint64))
    assert len(words) == 2 and escaped.tolist() == [2 ** 60]


def test_file_with_many_blocks(monkeypatch):
    monkeypatch.setattr(F, "BLOCK_IDS", 64)
    sink = io.BytesIO()
    sink.close = lambda: None
    w = F.TokenFileWriter(sink)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 500, 3)]
    for i, p in enumerate(parts):
        w.add(i if i else None, p)
    w.close()
    blocks, documents = F.read_footer(sink, sink.tell())
    ids = F.read_blocks(sink, blocks, 0, len(blocks) - 1)
    assert (ids == np.concatenate(parts)).all()
    assert documents[:, 2].tolist() == [len(p) for p in parts] and documents[0, 1] == 0
    with pytest.raises(ValueError):
        F.read_footer(io.BytesIO(sink.getvalue()[:-1]), len(sink.getvalue()) - 1)


def test_round_trip_by_ranges(spark, monkeypatch):
    texts = ["Hello World, it's", None, "", "a b " * 400, "ÄÖÜ ñ", "x"]
    data = [(i * 7 % 31, texts[i % len(texts)], "en", "s", 0) for i in range(40)] + [(3, "twice", None, None, 0), (None, "none", None, None, 0)]
    df = clashing(docs(spark, data), "range_no", "start", "ids")
    folder = shared_folder(spark, "test-tokens")
    files = F.write_tokens(df, folder, range_bytes=2000, file_ids=300)
    assert files.count() > 2
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in F.read_tokens(files, folder).collect()), key=lambda r: r[2])
    exp, at = [], 0
    for d, t, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = WORD.encode(t or "", add_special_tokens=False).ids + [1]
        exp.append((d is not None, d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == exp


def test_equal_input_gives_equal_files(spark):
    data = [(i, f"text {i} " * (i % 9), "en", "s", 0) for i in range(200)]
    made = []
    for parts in (1, 5):
        folder = shared_folder(spark, "test-tokens")
        files = F.write_tokens(docs(spark, data).repartition(parts), folder, range_bytes=1500).collect()
        store = F.open_store(folder)
        made.append(sorted((r.path, store.open(r.path).read()) for r in files))
    assert made[0] == made[1]


def test_empty_table(spark):
    folder = shared_folder(spark, "test-tokens")
    files = F.write_tokens(docs(spark, []), folder)
    assert files.count() == 0 and F.read_tokens(files, folder).count() == 0
