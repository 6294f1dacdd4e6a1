import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabaudit.llm import packing as P
from tests.llm.helpers import clashing, crc, docs, rows

BYTE = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
TEXTS = ["Hello, world! It's a test.", None, "", "a  b \n c ", " x", "word " * 5000, "déjà vu über ñ", "same", "same", "tab\tand\r\nlines"]


def expected(data, capacity):
    out = []
    for d, t in data:
        ids = BYTE.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(min(first, len(ids)), len(ids), capacity), len(ids)]
        out += [(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity,bucket", [(2048, 16384), (16, 3)])
def test_pieces_and_sequences(spark, capacity, bucket):
    df = clashing(docs(spark, rows(*TEXTS)), "offset", "bucket", "_bucket", "piece")
    out = P.pack_documents(df, capacity=capacity, bucket_rows=bucket).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr)
    assert got == expected(list(enumerate(TEXTS)), capacity)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, [(1, "same text", None, None, 0)] * 3 + [(None, "x", None, None, 0)])
    out = P.pack_documents(df).collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4
    assert P.pack_documents(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_each_piece_goes_where_the_sum_of_squares_is_least(lengths):
    """Replays the placement with the sum computed in full."""
    capacity = 50
    lengths = np.array(lengths)
    bins, offsets = P.sum_of_squares(lengths, capacity)
    left = {}

    def total(levels):
        n = np.bincount([g for g in levels if 0 < g < capacity], minlength=capacity + 1)
        return int((n.astype(np.int64) ** 2).sum())

    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        levels = list(left.values())
        options = [total([*levels, capacity - s])]
        for g in {g for g in levels if g >= s}:
            rest = levels.copy()
            rest[rest.index(g)] = g - s
            options.append(total(rest))
        b = int(bins[i])
        left[b] = left.get(b, capacity) - s
        assert left[b] >= 0 and offsets[i] == capacity - left[b] - s
        assert total(list(left.values())) == min(options)


def test_fill_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(6, 1.2, 20000).astype(int) + 1, 2048)
    bins, _ = P.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 2048)


def test_too_long_piece():
    with pytest.raises(ValueError):
        P.sum_of_squares(np.array([5]), 4)
