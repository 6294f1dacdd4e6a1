"""Toxicity scores from a learned lexicon, matched with spelling errors.

1. Lexicon: words and word beginnings (stems) whose share of toxic labelled
   texts far exceeds their share of clean ones; of a chain of beginnings the
   most specific one with nearly all of the support is kept. Entries are
   proposed by one half of the sample and weighed by the other half, which
   drops those that only chance brought up.
2. Matching: the lexicon is a trie; a Levenshtein automaton for the word is
   intersected with it. Both are run as one deterministic automaton over
   (trie node, edits) sets, built as words need it, so that nearly all words
   leave it after a few characters. Digits and signs that stand for letters are
   folded first; a masked letter counts as an edit, and so do two swapped ones.
   Words that clean texts hold at least as often are no misspellings.
3. Context: in a window around each match the scorer looks for quotation marks
   on both sides and for further matches; quoted matches are features of their
   own, so that a text that quotes an insult differs from one that hurls it.
4. A logistic model over a document's features gives the score.

The lexicon and the model are fitted on a sample bounded by ``max_toxic`` and
``max_clean`` labelled texts, weighted back to the whole table's counts; every
text is scored whole, in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.llm.common import materialize, read_table, release_memory
from tabaudit.llm.langid import remainder
from tabaudit.llm.tokens import text_slices

#: Bounds of the fitting sample.
MAX_TOXIC, MAX_CLEAN = 4000, 6000
#: A lexicon entry: least toxic texts, least log odds, and the greatest probability of its counts by chance.
MIN_TEXTS, MIN_LOG_ODDS, MAX_CHANCE = 4, 2.0, 1e-7
MAX_ENTRIES = 5000
STEM_SIZES = range(3, 9)
#: Whole words of this many letters or more may differ by one edit, those of one letter less by a masked or doubled one.
FUZZY_LETTERS = 5
WINDOW_WORDS = 8
THRESHOLD = 0.3

#: Signs that stand for letters inside words.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Quotation marks.
QUOTES = "\"'“”„«»‘’‹›`"
_TOKEN = re.compile(r"[@$!|]?\w+(?:[@$!|*]+\w+)*")
_MIXED = re.compile(r"[0-9@$!|*]")


class LexiconAutomaton:
    """Trie of words (whole) and stems (prefixes), intersected with the
    Levenshtein automaton of at most one edit."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.fuzzy: list[bool] = [False]  # a word at or below may be misspelled
        self.fuzzy_ends: set[int] = set()
        for group, weights in ((words, self.word), (stems, self.stem)):
            for text, weight in group.items():
                node = 0
                path = [0]
                for c in text:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.word.append(0.0)
                        self.stem.append(0.0)
                        self.fuzzy.append(False)
                    node = self.child[node][c]
                    path.append(node)
                weights[node] = weight
                if group is words and len(text) >= FUZZY_LETTERS:
                    self.fuzzy_ends.add(node)
                    for p in path:
                        self.fuzzy[p] = True
        # deterministic states: sets of (trie node, edits so far)
        self.names: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.result: list[tuple[float, int]] = []
        self.start = self._state({(0, 0)})

    def _close(self, pairs: set) -> frozenset:
        """Add what leaving out lexicon letters reaches; drop what a lower
        count of edits at the same node covers."""
        for node, edits in list(pairs):
            if edits == 0 and node and self.fuzzy[node]:
                pairs.update((n, 1) for n in self.child[node].values() if self.fuzzy[n])
        return frozenset((n, e) for n, e in pairs if e == 0 or (n, 0) not in pairs)

    def _state(self, pairs: set) -> int:
        key = self._close(pairs)
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            exact = max([self.word[n] for n, e in key if e == 0], default=0.0)
            near = max([self.word[n] for n, e in key if e == 1 and n in self.fuzzy_ends], default=0.0)
            stem = max([self.stem[n] for n, e in key if e == 0], default=0.0)
            self.result.append((exact, 0) if exact else (stem, 1) if stem else (near, 2))
        return self.names[key]

    def _move(self, state: int, c: str) -> int:
        pairs = set()
        for node, edits in self.states[state]:
            nxt = self.child[node].get(c)
            if nxt is not None and (edits == 0 or self.fuzzy[nxt]):
                pairs.add((nxt, edits))
            # the first letter is taken as written
            if edits == 0 and node and self.fuzzy[node]:
                pairs.add((node, 1))  # one letter too many
                pairs.update((n, 1) for n in self.child[node].values() if self.fuzzy[n])  # another letter
        to = self._state(pairs) if pairs else -1
        self.step[state][c] = to
        return to

    def match(self, word: str) -> tuple[float, int]:
        """(weight, kind): kind 0 a word, 1 a stem, 2 a misspelled word;
        weight 0 if nothing matches."""
        state, stem = self.start, 0.0
        for c in word:
            to = self.step[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return stem, 1
            state = to
            weight, kind = self.result[state]
            if kind == 1 and weight > stem:
                stem = weight
        weight, kind = self.result[state]
        if kind == 2 and stem:
            return stem, 1
        return (weight, kind) if weight else (stem, 1)


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    clean: set[str] = field(default_factory=set)  # near misses of lexicon words that are words of clean texts
    coef: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = -4.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread @ self.coef + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


#: Words, stems, misspelled words, quoted matches, greatest weight, matches a word, close matches.
N_FEATURES = 7
#: Distinct words without a match that a task remembers.
MEMO_WORDS = 500_000


def variants(words: dict[str, float]) -> dict[str, float]:
    """Misspellings that are not one edit of Levenshtein's: two neighbours
    swapped; and of words a letter too short for edits a masked or a doubled
    letter. The first letter is taken as written."""
    out: dict[str, float] = {}
    for w, weight in words.items():
        places = range(1, len(w))
        if len(w) >= FUZZY_LETTERS:
            made = [w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in places if i + 1 < len(w)]
        elif len(w) == FUZZY_LETTERS - 1:
            made = [w[:i] + "*" + w[i + 1:] for i in places] + [w[:i] + w[i] + w[i:] for i in places]
        else:
            made = []
        for v in made:
            out[v] = max(weight, out.get(v, 0.0))
    return out


class Scanner:
    """Features of texts under a lexicon."""

    def __init__(self, model: ToxicityModel):
        self.automaton = LexiconAutomaton(model.words, model.stems)
        self.variants = variants(model.words)
        self.clean = model.clean
        self.plain: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def _learn(self, tokens: set[str]) -> None:
        new = tokens - self.plain
        if len(self.plain) > MEMO_WORDS:
            self.plain = set()
        for t in new:
            if t in self.hits:
                continue
            weight, kind = self._match(t)
            if weight and not (kind == 2 and t in self.clean):
                self.hits[t] = (weight, kind)
            else:
                self.plain.add(t)

    def _match(self, t: str) -> tuple[float, int]:
        word = t
        if _MIXED.search(t) and not t.isdigit():
            word = t.translate(FOLD)
        weight, kind = self.automaton.match(word)
        if not weight:
            weight, kind = self.variants.get(word, 0.0), 2
        if weight:
            return weight, kind if word == t else 2
        # a sign before the word may stand for no letter
        return self._match(t[1:]) if t[0] in "@$!|" else (0.0, 1)

    def features(self, text: str) -> tuple[np.ndarray, list[tuple[str, int, float, int, bool]]]:
        """(features, matches (token, place, weight, kind, quoted))."""
        low = text.lower()
        tokens = _TOKEN.findall(low)
        distinct = set(tokens)
        self._learn(distinct)
        x = np.zeros(N_FEATURES)
        if distinct.isdisjoint(self.hits):
            return x, []
        spans = [m.span() for m in _TOKEN.finditer(low)]
        found = [i for i, t in enumerate(tokens) if t in self.hits]
        matches = []
        for k, i in enumerate(found):
            weight, kind = self.hits[tokens[i]]
            before = low[spans[max(0, i - WINDOW_WORDS)][0]:spans[i][0]]
            after = low[spans[i][1]:spans[min(len(spans) - 1, i + WINDOW_WORDS)][1] + 2]
            quoted = _open_quote(before) and _close_quote(after)
            close = (k > 0 and i - found[k - 1] <= WINDOW_WORDS) or (k + 1 < len(found) and found[k + 1] - i <= WINDOW_WORDS)
            matches.append((tokens[i], i, weight, kind, quoted))
            if quoted:
                x[3] += weight
            else:
                x[kind] += weight
                x[4] = max(x[4], weight)
                x[6] += close
        x[:4] = np.log1p(x[:4])
        x[5] = np.log1p(100.0 * sum(1 for m in matches if not m[4]) / len(tokens))
        x[6] = np.log1p(x[6])
        return x, matches


def _open_quote(before: str) -> bool:
    """An odd number of quotation marks at word edges stands before."""
    return sum(1 for i, c in enumerate(before) if c in QUOTES and (i == 0 or not before[i - 1].isalnum())) % 2 == 1


def _close_quote(after: str) -> bool:
    return any(c in QUOTES and not (i + 1 < len(after) and after[i + 1].isalnum()) for i, c in enumerate(after))


def learn_lexicon(sample: DataFrame, min_texts: int = MIN_TEXTS, min_log_odds: float = MIN_LOG_ODDS,
                  max_chance: float = MAX_CHANCE) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with log odds, from rows (text, toxic, half)."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    entries = F.array_distinct(F.flatten(F.transform(tokens, lambda w: F.concat(
        F.array(F.concat(w, F.lit("$"))),
        F.transform(F.sequence(F.lit(STEM_SIZES[0]), F.greatest(F.lit(STEM_SIZES[0]), F.least(F.length(w), F.lit(STEM_SIZES[-1])))),
                    lambda n: F.substring(w, 1, n))))))
    n = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = [n.get((1, h), 0) for h in (0, 1)]
    clean = [n.get((0, h), 0) for h in (0, 1)]
    if not all(toxic) or not all(clean):
        return {}, {}
    # copies of a text count once
    texts = sample.groupBy(F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.max("half").alias("half"))
    sums = [F.sum(F.when((F.col("toxic") == c) & (F.col("half") == h), 1).otherwise(0)).alias(f"{'ct'[c]}{h}")
            for c in (0, 1) for h in (0, 1)]
    counted = texts.select("toxic", "half", F.explode(entries).alias("entry")).groupBy("entry").agg(*sums)

    def odds(h: int):
        return (F.log((F.col(f"t{h}") + 0.5) / (toxic[h] + 1.0)) - F.log((F.col(f"c{h}") + 0.5) / (clean[h] + 1.0))).alias(f"w{h}")

    # by a bound of Chernoff's kind: all of n counts toxic at share q by chance has probability below exp(-n * KL)
    share = sum(toxic) / (sum(toxic) + sum(clean))
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    q = t / (t + c)
    kl = q * F.log(q / share) + F.when(c > 0, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    rows = (counted.where((F.col("t0") >= min_texts // 2) & (F.col("t1") >= min_texts // 2))
            .select("entry", t.alias("t"), odds(0), odds(1), ((t + c) * kl).alias("evidence"), q.alias("q"))
            .where((F.col("w0") >= min_log_odds) & (F.col("w1") >= min_log_odds) & (F.col("q") > share)
                   & (F.col("evidence") >= -float(np.log(max_chance))))
            .orderBy(F.desc("evidence"), "entry").limit(MAX_ENTRIES).collect())
    support = {r["entry"]: (r["t"], (r["w0"] + r["w1"]) / 2) for r in rows}
    words, stems = {}, {}
    for e, (count, w) in support.items():
        longer = [x for x in support if len(x) == len(e) + 1 and x.startswith(e)] if not e.endswith("$") else []
        if any(support[x][0] >= 0.9 * count for x in longer):
            continue  # a more specific entry says the same
        (words if e.endswith("$") else stems)[e.rstrip("$")] = w
    # a stem that begins with a kept stem adds nothing unless it is far surer
    kept = {s: w for s, w in stems.items() if not any(s[:k] in stems and stems[s[:k]] >= w - 0.5 for k in range(3, len(s)))}
    return words, kept


def draw_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
                max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample (text, toxic, half) of the documents to learn from, and
    the rows that one sampled row of each class stands for. Those are the
    labelled documents whose crc32 remainder by 4 is not 2; one with several
    labels has the greatest. Rows are drawn by a hash of id and text before
    any text moves; rows with equal id and text count once."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(toxic).cast("int")).alias("toxic"))
    own = docs.where((remainder(F.col(doc_id), 4) != 2) & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    named = materialize(own.select("_id", "_hash").distinct().join(one, "_id"), "toxic-labelled")
    n = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {1: min(1.0, max_toxic / max(1, n.get(1, 0))), 0: min(1.0, max_clean / max(1, n.get(0, 0)))}
    draw = F.pmod(F.xxhash64("_id", "_hash"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    picked = named.where(draw < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    # broadcast: the drawn ids, some max_toxic + max_clean of 16 bytes
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    sample = own.join(F.broadcast(picked), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    return materialize(sample.select("text", "toxic", half), "toxic-sample"), {k: 1.0 / r for k, r in rate.items()}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    """Fit on the labelled documents. With no toxic one every score is that of
    a text without matches."""
    sample, stands_for = draw_sample(docs, labels, doc_id, text, toxic, max_toxic, max_clean)
    words, stems = learn_lexicon(sample)
    model = ToxicityModel(words, stems)
    spark = sample.sparkSession
    if words:
        model.clean = _clean_words(sample, model)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in batches:
            x = [scanner.features(t or "")[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in x], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())],
                                             names=["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").collect()  # at most the sample's bound
    if rows:
        x = np.array([r["x"] for r in rows])
        y = np.array([r["toxic"] for r in rows], float)
        weight = np.array([stands_for[int(v)] for v in y])
        _fit_logistic(model, x, y, weight)
    return model


def _one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one edit at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def _clean_words(sample: DataFrame, model: ToxicityModel) -> set[str]:
    """Tokens of the sample that match as misspellings and that clean texts
    hold, outside quotations, at least as often as toxic ones."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in batches:
            found = [(t, y) for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for t in {t for t, _, _, kind, quoted in scanner.features(text or "")[1] if kind == 2 and not quoted}]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())],
                                             names=["token", "toxic"])

    toxic = F.sum("toxic").alias("t")
    n = sample.agg(toxic, F.sum(1 - F.col("toxic")).alias("c")).first()
    seen = sample.select("text", "toxic").mapInArrow(run, "token string, toxic int").groupBy("token").agg(toxic, F.sum(1 - F.col("toxic")).alias("c"))
    # at most the near misses of a bounded sample
    rows = seen.where((F.col("c") > 0) & (F.col("c") * F.lit(n["t"]) >= F.col("t") * F.lit(n["c"]))).select("token").collect()
    return {r["token"] for r in rows}


def _fit_logistic(model: ToxicityModel, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
    """Weighted ridge logistic regression by Newton steps; features that are
    evidence of toxicity (all but quoted matches) get no negative weight."""
    model.mean, model.spread = np.zeros(N_FEATURES), np.maximum(x.std(axis=0), 0.25)
    free = np.ones(N_FEATURES, bool)
    weight = weight / weight.mean()
    for _ in range(N_FEATURES):
        a = np.hstack([x[:, free] / model.spread[free], np.ones((len(x), 1))])
        b = np.zeros(a.shape[1])
        penalty = np.append(np.full(free.sum(), ridge), 0.01)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(a @ b, -30, 30)))
            g = a.T @ (weight * (y - p)) - penalty * b
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(h, g)
            b += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        coef = np.zeros(N_FEATURES)
        coef[free] = b[:-1]
        bad = free & (coef < 0) & (np.arange(N_FEATURES) != 3)
        if not bad.any():
            break
        free &= ~bad
    # misspellings are rare in a sample: they count at least half as much as the words they stand for
    coef[2] = max(coef[2], 0.5 * coef[0] * model.spread[2] / model.spread[0])
    model.coef, model.bias = coef, float(b[-1])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", score_col: str = "score",
          hits_col: str = "n_matches") -> DataFrame:
    """``docs`` with the score (0 to 1) and the number of matches. NULL and
    empty texts have no match and get the score of such texts. Columns of
    ``docs`` named like the two outputs are replaced; all others are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(score_col, hits_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(hits_col, T.IntegerType())])
    place = kept.columns.index(text)

    def run(batches):
        m = shared.value
        scanner = Scanner(m)
        for batch in batches:
            for a, b in text_slices(batch.column(place)):
                part = batch.slice(a, b - a)
                found = [scanner.features(t or "") for t in part.column(place).to_pylist()]
                s = m.scores(np.array([x for x, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s), pa.array([len(h) for _, h in found], pa.int32())],
                    names=[*part.schema.names, score_col, hits_col])
        del scanner
        release_memory()

    return kept.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")
