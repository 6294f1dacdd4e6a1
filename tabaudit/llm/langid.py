"""Language identification by sparse multinomial logistic regression.

Features are character 1- to 3-grams of the lower-cased letters of a text (any
run of other characters is one space), hashed into DIMENSION cells and weighted
by TF-IDF: relative frequency in the text times log inverse document frequency
over all learning texts. Weights are trained with follow-the-regularised-leader
(McMahan et al., 2013) with an elastic-net penalty, on shards of a bounded,
per-language sample; the shards' weights are averaged. One temperature, fitted
on sampled texts that no shard saw, calibrates the probabilities.

Document frequencies cover every learning text (one pass with map-side sums of
DIMENSION cells); the fitting sample is bounded by ``per_language``; every text
is predicted whole, in one pass, with the weights broadcast (DIMENSION x
languages floats, a size fixed by parameters).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.llm.common import CHUNK_BYTES, materialize, read_table, release_memory, row_chunks, text_buffers

DIMENSION = 1 << 16
ORDERS = (1, 2, 3)
#: Bounds of the fitting sample: texts a language, and shards that learn from them.
PER_LANGUAGE = 800
SHARDS = 4
UNDETERMINED = "und"
#: Rows of (language, rate) up to which they are broadcast.
BROADCAST_LANGUAGES = 100_000
#: FTRL: learning rate, its smoothing, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.0005, 2
#: Features are scaled by this factor, as relative frequencies are small.
SCALE = 10.0

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or space for all that is no letter."""
    if not _LETTERS:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(t)
    return _LETTERS[0]


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each order: (cells, documents) of all n-grams of a chunk of UTF-8
    texts; n-grams never cross texts."""
    n_docs = len(offsets) - 1
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # characters before every byte offset: those bytes that do not continue a character
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offsets]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(at))
    m = letter_table()[np.minimum(chars, 0x10FFFF)]
    if len(m) != len(doc):  # cannot happen with valid UTF-8
        raise ValueError("a text is not UTF-8")
    keep = np.ones(len(m), bool)
    keep[1:] = (m[1:] != 32) | (m[:-1] != 32) | (doc[1:] != doc[:-1])
    m, doc = m[keep], doc[keep]
    shift = np.uint32(32 - (DIMENSION.bit_length() - 1))
    h = m
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            h = (h[:-1] * np.uint32(0x01000193)) ^ m[order - 1:]
        if order in ORDERS and len(h):
            d = doc[:len(h)]
            cells = ((h + np.uint32(order * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> shift
            inside = d == doc[order - 1:]
            # a text without letters has no n-grams; a lone space is none either
            if order == 1:
                inside = m != 32
            yield cells[inside], d[inside]


def _segments(data: np.ndarray, limit: int = CHUNK_BYTES):
    """A text's bytes in parts of about ``limit``, cut between characters."""
    a = 0
    while a < len(data):
        b = min(len(data), a + limit)
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        yield data[a:b]
        a = b


def long_grams(data: np.ndarray, limit: int = CHUNK_BYTES):
    """Cells of all n-grams of one text of any length, part by part: those of
    ``grams``, with the last letters of a part carried into the next."""
    shift = np.uint32(32 - (DIMENSION.bit_length() - 1))
    carried = np.zeros(0, np.uint32)
    for part in _segments(data, limit):
        chars = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        m = np.concatenate((carried, letter_table()[np.minimum(chars, 0x10FFFF)]))
        keep = np.ones(len(m), bool)
        keep[1:] = (m[1:] != 32) | (m[:-1] != 32)
        m, old = m[keep], len(carried)
        h = m
        for order in range(1, max(ORDERS) + 1):
            if order > 1:
                h = (h[:-1] * np.uint32(0x01000193)) ^ m[order - 1:]
            if order in ORDERS and len(h):
                new = np.arange(len(h)) + order > old  # n-grams that end in this part
                if order == 1:
                    new &= m != 32
                yield ((h[new] + np.uint32(order * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> shift
        carried = m[-(max(ORDERS) - 1):]


def _cells(data: np.ndarray, offsets: np.ndarray):
    """The cells of all n-grams of every text."""
    n = len(offsets) - 1
    parts = [(c, np.searchsorted(d, np.arange(n + 1, dtype=d.dtype)).tolist()) for c, d in grams(data, offsets)]
    for i in range(n):
        yield np.concatenate([c[at[i]:at[i + 1]] for c, at in parts]) if parts else np.zeros(0, np.uint32)


def _vectors(data: np.ndarray, offsets: np.ndarray):
    """Sparse (cells, relative frequencies) of every text."""
    for cells in _cells(data, offsets):
        counts = np.bincount(cells, minlength=DIMENSION)
        used = np.nonzero(counts)[0]
        yield used, counts[used] / max(1, len(cells))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # DIMENSION x languages, IDF and scale multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, n-grams) of every text of a chunk."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.languages)))
        count = np.zeros(n, np.int64)
        if n == 1 and len(data) > 2 * CHUNK_BYTES:
            for cells in long_grams(data):
                total[0] += self.weights[cells].sum(axis=0, dtype=np.float64)
                count[0] += len(cells)
            return total / max(count[0], 1) + self.bias, count
        for cells, doc in grams(data, offsets):
            if not len(cells):
                continue
            first = np.nonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[0]
            total[doc[first]] += np.add.reduceat(self.weights[cells], first, axis=0, dtype=np.float64)
            count[doc[first]] += np.diff(np.append(first, len(doc)))
        return total / np.maximum(count, 1)[:, None] + self.bias, count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by per-coordinate FTRL-proximal on (cells, values,
    class) rows; weights within the L1 penalty stay exactly 0."""
    z = np.zeros((DIMENSION + 1, n_classes))
    n = np.zeros((DIMENSION + 1, n_classes))

    def weights(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for epoch in range(epochs):
        for j in np.random.default_rng(epoch).permutation(len(rows)):
            cells, x, y = rows[j]
            i = np.append(cells, DIMENSION)
            v = np.append(x, 1.0)
            w = weights(i)
            p = softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(DIMENSION + 1))
    return w[:DIMENSION], w[DIMENSION]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that have each cell, texts) over a whole table."""
    def count(batches):
        seen, here, n = np.zeros(DIMENSION, np.int64), np.zeros(DIMENSION, bool), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in row_chunks(offsets):
                o = offsets[a:b + 1]
                part = data[o[0]:o[-1]]
                for cells in (_cells(part, o - o[0]) if len(part) <= 2 * CHUNK_BYTES or b - a > 1 else [np.concatenate([np.unique(c) for c in long_grams(part)])]):
                    here[cells] = True
                    seen += here
                    here[cells] = False
                n += b - a
        release_memory()
        used = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(seen[used], n), pa.int64())],
                                         names=["cell", "n"])

    rows = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIMENSION, np.int64), 0
    for r in rows:  # at most DIMENSION + 1
        if r["cell"] < 0:
            total = r["n"]
        else:
            df[r["cell"]] = r["n"]
    return df, total


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE, shards: int = SHARDS) -> LanguageModel:
    """Fit on rows (key, text, lang), lang not NULL. The sample takes about
    ``per_language`` texts of each language, chosen by a hash of key and text."""
    spark = learn.sparkSession
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rate = counts.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("rate"))
    rate = materialize(rate, "lang-rates")
    side = F.broadcast(rate) if rate.count() <= BROADCAST_LANGUAGES else rate
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = learn.join(side, "lang").where(draw < F.col("rate")).select(
        "text", "lang", F.pmod(F.xxhash64("key", "text", F.lit("shard")), F.lit(shards + 1)).cast("int").alias("shard"))
    sample = materialize(sample, "lang-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((DIMENSION, 0), np.float32), np.zeros(0))
    df, total = document_frequencies(learn)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    scale = idf * np.float32(SCALE)
    place = {c: i for i, c in enumerate(languages)}

    def learn_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "text"])
        data, offsets = text_buffers(pa.array(rows["text"], pa.large_string()))
        made = []
        y = [place[c] for c in rows["lang"]]
        for a, b in row_chunks(offsets):
            o = offsets[a:b + 1]
            for k, (cells, tf) in enumerate(_vectors(data[o[0]:o[-1]], o - o[0])):
                if len(cells):
                    made.append((cells, tf * scale[cells], y[a + k]))
        w, bias = ftrl(made, len(languages))
        cell, cls = np.nonzero(w)
        return pd.DataFrame({"cell": np.append(cell, np.full(len(bias), -1)), "cls": np.append(cls, np.arange(len(bias))),
                             "w": np.append(w[cell, cls], bias)})

    # the last part is kept for the temperature (with few texts, all take part in both)
    parts = sample.where(F.col("shard") < shards)
    trained = parts.groupBy("shard").applyInPandas(learn_shard, "cell int, cls int, w double")
    rows = trained.groupBy("cell", "cls").agg(F.sum("w").alias("w")).toPandas()
    n_shards = max(1, parts.select("shard").distinct().count())
    weights, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    for cell, cls, w in zip(rows["cell"], rows["cls"], rows["w"]):
        if cell < 0:
            bias[cls] = w / n_shards
        else:
            weights[cell, cls] = w / n_shards
    model = LanguageModel(languages, (weights * scale[:, None]).astype(np.float32), bias)
    model.temperature = fit_temperature(spark, model, sample.where(F.col("shard") == shards))
    return model


def _each_chunk(batches, model: LanguageModel, out):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in row_chunks(offsets):
            o = offsets[a:b + 1]
            z, n = model.logits(data[o[0]:o[-1]], o - o[0])
            yield out(batch.slice(a, b - a), z, n)


def fit_temperature(spark: SparkSession, model: LanguageModel, held: DataFrame) -> float:
    """The temperature of a grid from 0.02 to 5 with the least total log loss."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(5.0), 60))
    shared = spark.sparkContext.broadcast(model)

    def losses(batches):
        total = np.zeros(len(grid))

        def add(batch, z, n):
            y = np.array([model_.languages.index(c) for c in batch.column("lang").to_pylist()], np.int64)
            for i, t in enumerate(grid):
                p = softmax(z / t)[np.arange(len(y)), y]
                total[i] -= np.log(np.maximum(p[n > 0], 1e-12)).sum()

        model_ = shared.value
        for _ in _each_chunk(batches, model_, add):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], names=["i", "loss"])

    rows = held.select("text", "lang").mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    best = min(rows, key=lambda r: (r["loss"], r["i"]), default=None)
    return float(grid[best["i"]]) if best is not None and best["loss"] > 0 else 1.0


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability. A NULL text
    or one without letters, and any text under a model without languages, is
    ``und`` with score 0. Columns of ``docs`` named like the two outputs are
    replaced; all others are kept."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop(lang_col, score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    place = kept.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            for a, b in row_chunks(offsets):
                o = offsets[a:b + 1]
                part = batch.slice(a, b - a)
                if m.languages:
                    z, n = m.logits(data[o[0]:o[-1]], o - o[0])
                    p = softmax(z / m.temperature)
                    best = p.argmax(axis=1)
                    name = [m.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), n.tolist())]
                    score = np.where(n > 0, p[np.arange(len(best)), best], 0.0)
                else:
                    name, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(name, pa.string()), pa.array(score)],
                                                 names=[*part.schema.names, lang_col, score_col])
        release_memory()

    return kept.mapInArrow(run, schema)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def learning_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return docs.where((remainder(F.col(doc_id), 5) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(learning_rows(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
