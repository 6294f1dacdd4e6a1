import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabaudit.llm import tokens as T

KINDS = [("byte_bpe_50k.json", True, 0), ("word_bpe_49k.json", False, 1)]
ODD = ["", " ", "a  b", "\n a", "a \n b", "foo ", " foo bar", "x  y z", "a\nb c\n\nd e", "it's don't 'S x'LL", "a\x1cb \x1c c",
       "<|endoftext|> hi <|startoftext|>", "\x01 \x01a", "\x00 \x00a", "a　b c", "ΑΣ ΣΑΣ", "é ́ e", "a\tb\r\nc", "\x85 a\x85b",
       "İstanbul ﬁ Ǆ", "foo,%% Foo.,’ it's, don't. a'S! é. É! x² x². 12,5. 're,", "\x02, \x02 \x02a,", "ÉCOLE!! ÇA!!", "a≠ b", "...a b..."]


@pytest.mark.parametrize("name,space,end", KINDS)
def test_ids_equal_the_library(name, space, end):
    t = T.WordCachedTokenizer(public_tokenizers.path(name), space, end)
    for _ in range(2):  # from the library, then from the cache
        got = t.encode(ODD)
        for text, ids, e in zip(ODD, got, t.tokenizer.encode_batch(ODD, add_special_tokens=False)):
            assert ids.tolist() == [*e.ids, end], text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n\t'.,!aAéÉsS0"), max_size=40))
def test_any_text(text):
    for name, space, end in KINDS:
        t = T.tokenizer(public_tokenizers.path(name), space, end)
        assert t.encode([text])[0].tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, end]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 8)
    t = T.WordCachedTokenizer(public_tokenizers.path(KINDS[0][0]), True, 0)
    texts = [f"w{i} x, y{i}. z" for i in range(50)]
    for text in texts + texts:
        assert t.encode([text])[0].tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert len(t.cache) < 40
