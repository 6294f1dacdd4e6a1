"""Token ids of whole texts by a public tokenizer file, at word-cache speed.

A tokenizer of the ``tokenizers`` library is slow on running text and quick on
few distinct words, so that a text is cut where its pre-tokenizer cuts in any
case, each distinct piece is encoded by the library, and ids are put together
from a bounded cache. Cuts are made only where they provably change nothing:

* byte-level BPE (pieces keep a leading space): before a space whose
  neighbours are not white space. A text with white space next to a space, or
  a space at its end, is encoded whole.
* word BPE (white space is dropped): at space, tab, CR and LF.

A piece that ends in ASCII punctuation after a letter or digit is encoded as
its core and its tail, which both pre-tokenizers part too (not at apostrophes,
which may start a contraction).
"""

from __future__ import annotations

import gc
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabaudit.llm.common import release_memory

#: Pieces of a task's cache (some 200 MB); a full cache starts anew.
CACHE_PIECES = 1_000_000
#: Fixed value: ASCII punctuation but the apostrophe.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: white space.
_WHITE = frozenset(chr(i) for i in range(0x3001) if chr(i).isspace())
#: Marks a tail of punctuation among the pieces.
_TAIL = "\x02"
#: Marks the first piece of a text, which has no space before it.
_HEAD = "\x00"


class WordCachedTokenizer:
    """``encode(texts)`` gives the ids of every text as a uint32 array.

    New pieces are encoded together, joined by a separator that the library
    always turns into one id of its own, because a call per word costs several
    times the encoding; pieces that hold the separator are encoded alone."""

    def __init__(self, path: str, keeps_space: bool, end_id: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # markup in a text is text
        self.keeps_space = keeps_space
        self.end = np.array([end_id], "<u4").tobytes()
        self.separator = "\n" if keeps_space else " \x01 "
        self.mark = self.separator.strip(" ")
        self.mark_id, = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.cache: dict[str, bytes | None] = {}  # None: a text with this piece is encoded whole

    def _pieces(self, text: str) -> list[str]:
        if self.keeps_space:
            pieces = text.split(" ")
            pieces[0] = _HEAD + pieces[0]
            return pieces
        return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.cache)
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {p: self.cache[p] for p in pieces.difference(new)}
        cache = self.cache
        # pieces with a tail, and (where the library lowers case) pieces that others spell in lower case
        parts = [(p, c) for p in new if (c := p.rstrip(_PUNCTUATION)) != p and c and c[-1].isalnum() and c != _HEAD]
        whole = new.difference([p for p, _ in parts])
        if not self.keeps_space:
            parts = [(p, c.lower() if c.isascii() else c) for p, c in parts]
            capital = [p for p in whole if p.isascii() and not p.islower()]
            parts += [(p, c) for p in capital if (c := p.lower()) != p]
            whole = whole.difference([p for p, _ in parts])
        tails = {_TAIL + p[len(c):] for p, c in parts if len(c) < len(p)}
        whole = whole.union([c for _, c in parts]).difference(cache)
        if self.keeps_space:
            odd = [p for p in whole if not p or p[0] in _WHITE or p[-1] in _WHITE or p[0] == _HEAD]
            whole = list(whole.difference(odd))
            texts = [" " + p for p in whole]
            for p in odd:
                first = p.startswith(_HEAD)
                word = p[1:] if first else p
                if word and (word[0] in _WHITE or word[-1] in _WHITE or word[0] == _HEAD) or not word and not first:
                    cache[p] = None  # the text must not be cut here
                else:
                    whole.append(p)
                    texts.append(word if first else " " + word)
        else:
            whole = list(whole)
            texts = whole.copy()
        tails = list(tails.difference(cache))
        whole += tails
        texts += [t[1:] for t in tails]
        alone = [i for i, t in enumerate(texts) if not t or self.mark in t]
        for i, ids in zip(alone, self._encode([texts[i] for i in alone])):
            cache[whole[i]] = ids.tobytes()
        if alone:
            out = set(alone)
            whole = [p for i, p in enumerate(whole) if i not in out]
            texts = [t for i, t in enumerate(texts) if i not in out]
        joined = [self.separator.join(texts[i:i + 200]) for i in range(0, len(texts), 200)]
        for k, ids in enumerate(self._encode(joined)):
            group = whole[200 * k:200 * k + 200]
            cuts = (np.nonzero(ids == self.mark_id)[0] * 4).tolist()
            raw = ids.tobytes()
            cache.update(zip(group, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True)], strict=True))
        for p, c in parts:
            ids = cache[c]
            cache[p] = ids if ids is None or len(c) == len(p) else ids + cache[_TAIL + p[len(c):]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id; texts are taken together, so
        callers pass a bounded amount of text. The garbage collector rests
        meanwhile: the many short lists here hold no cycles."""
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if running:
                gc.enable()

    def forget(self) -> None:
        """Drop the cache, so that a worker carries none into other stages."""
        self.cache = {}
        release_memory()

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._pieces(t) if _TAIL not in t else [] for t in texts]
        self._learn(set(chain.from_iterable(cut)))
        known, out = self.cache, []
        for text, pieces in zip(texts, cut):
            try:
                raw = b"".join(itemgetter(*pieces)(known)) if len(pieces) > 1 else known[pieces[0]] + b""
            except IndexError:  # it holds the mark of tails
                raw = self._encode([text])[0].tobytes()
            except TypeError:  # a piece at which the text must not be cut
                raw = self._encode([text])[0].tobytes()
            out.append(np.frombuffer(raw + self.end, "<u4"))
        return out


_LOADED: dict[tuple, WordCachedTokenizer] = {}


def tokenizer(path: str, keeps_space: bool, end_id: int) -> WordCachedTokenizer:
    """The worker's tokenizer, loaded once; a task forgets its cache when it ends."""
    key = (path, keeps_space, end_id)
    if key not in _LOADED:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        _LOADED[key] = WordCachedTokenizer(path, keeps_space, end_id)
    return _LOADED[key]


def text_slices(texts: pa.Array, limit: int = 4 << 20):
    """Row ranges [a, b) of a column with about ``limit`` bytes each."""
    a = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
