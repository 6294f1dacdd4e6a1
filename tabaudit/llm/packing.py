"""Packing tokenized documents into sequences by the sum-of-squares rule.

N(g) is the number of open sequences with g tokens left. A piece of s tokens
goes where the sum of N(g)**2 over all gaps becomes smallest: into a sequence
with gap g the sum changes by 2 * (N(g - s) - N(g)) + 2, into one that it
closes (g = s) by 1 - 2 * N(s), into a new one by 2 * N(capacity - s) + 1.
Equal changes go to the smallest gap (Csirik, Johnson, Kenyon, Orlin, Shor and
Weber, 2006). Pieces are placed by decreasing length, so that short ones close
the gaps that long ones leave.

Texts are tokenized where they are read; only (id, length) rows are shuffled,
into buckets of about ``bucket_rows`` pieces that are packed independently, so
that the buckets' number follows the input and none grows with it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, read_table
from tabaudit.llm.tokens import text_slices, tokenizer

CAPACITY = 2048
#: Pieces packed together. A bucket leaves a few sequences partly filled.
BUCKET_ROWS = 16_384
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, in input order; bins count from 0."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    far = np.int64(1) << 60
    for i, s in zip(order.tolist(), lengths[order].tolist()):
        if not 0 < s <= capacity:
            raise ValueError(f"a piece has {s} tokens; sequences hold 1 to {capacity}")
        held = n[s:capacity]  # gaps s .. capacity-1
        change = 2 * (n[:capacity - s] - held) + 2
        best, gain = capacity, (2 * int(n[capacity - s]) + 1 if s < capacity else 0)
        if len(held):
            change[0] = 1 - 2 * held[0]
            change = np.where(held > 0, change, far)
            k = int(change.argmin())
            if change[k] <= gain:
                best = s + k
        if best == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[best].pop()
            n[best] -= 1
        bins[i], offsets[i] = b, capacity - best
        left = best - s
        if left:
            open_bins[left].append(b)
            n[left] += 1
    return bins, offsets


def piece_cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first piece
    takes the remainder."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, first if first and a == 0 else capacity) for a in starts]


def tokenize_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                    capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document. A NULL or empty text is its end
    id alone; repeated rows are tokenized as separate documents."""
    def encode(batches):
        t = tokenizer(path, True, end_id)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in text_slices(texts):
                rows: list[tuple] = []
                part = [x or "" for x in texts.slice(a, b - a).to_pylist()]
                for d, tok in zip(ids.slice(a, b - a).to_pylist(), t.encode(part)):
                    for k, (s, n) in enumerate(piece_cuts(len(tok), capacity)):
                        rows.append((d, k, s, n, zlib.crc32(tok[s:s + n].tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        t.forget()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (a written table with a ``length`` column) with sequence_id
    and offset. Buckets are drawn by a hash of the row's place in the table,
    so that copies of one row spread over all of them."""
    total = pieces.count()
    n = max(1, -(-total // bucket_rows))
    cols = pieces.columns

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *[c for c in cols if c != "length"]], ascending=False, kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
        return rows[cols].assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in cols)
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    return bucketed.groupBy("_bucket").applyInPandas(one, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Other columns of ``docs`` are not read; an empty table gives an
    empty result."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    pieces = materialize(tokenize_pieces(docs, path, doc_id, text, capacity, end_id), "pack-pieces")
    return pack(pieces, capacity, bucket_rows)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
