"""Token ids as binary files of Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of data: the selector says how
many ids the word packs and in how many bits each (SELECTORS). Selector 15 is
an escape: the data is the place of a value of 60 bits or more in the block's
list of escaped values, so that decoding needs no look at earlier words.

File layout (little-endian):

    magic "S8BT0001"
    blocks: packed words, then escaped values (uint64 each)
    footer: per block   word offset, words, escapes, ids     (4 x uint64)
            per document  id (int64), has_id (uint64), ids, first block,
                          place of its first id there          (5 x 64 bit)
    trailer: blocks, documents, footer offset (3 x uint64), magic

A block holds about BLOCK_IDS ids and can be decoded alone, all its words at
once; documents run across blocks.

Writing sorts documents into key ranges (equal input gives equal files), each
range is written by one task that rolls files by size, under a name of the
attempt first and then, by rename, under its final name. The list of files is a
written table; readers see only what is listed there.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, range_numbers, read_table
from tabaudit.llm.files import open_store, shared_folder
from tabaudit.llm.tokens import text_slices, tokenizer

MAGIC = b"S8BT0001"
#: Fixed values: (ids in a word, bits of each) by selector 0..14.
SELECTORS = [(240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
             (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24
#: Bytes of text that a key range is to have.
RANGE_BYTES = 32 << 20
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


# ------------------------------------------------------------------- codec
def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of a block of uint64 ids. Each word takes as
    many of the next ids as any selector can hold."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    need = np.searchsorted(_LIMITS, ids, side="right").astype(np.uint8)  # bits that each id needs
    most = need  # of the next ``width`` ids
    width, pick = 1, np.where(need <= 60, np.uint8(14), np.uint8(ESCAPE))
    for selector in range(len(SELECTORS) - 2, -1, -1):  # later ones hold more ids and win
        count, bits = SELECTORS[selector]
        while width < count:
            step = min(width, count - width)
            if len(most) <= step:
                return _pack(ids, pick)
            most = np.maximum(most[:-step], most[step:])
            width += step
        ok = most <= bits
        if ok.any():
            np.copyto(pick[:len(ok)], np.uint8(selector), where=ok)
    return _pack(ids, pick)


#: 2**b, the least value that needs b + 1 bits.
_LIMITS = np.array([1 << b for b in range(64)], np.uint64)


def _pack(ids: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow the picked selectors from the first id on and fill the words."""
    n = len(ids)
    counts = np.array([c for c, _ in SELECTORS] + [1])
    step = counts[pick].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    kind = pick[at]
    words = kind.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(SELECTORS):
        rows = np.nonzero(kind == selector)[0]
        if bits and len(rows):
            first = at[rows]
            for j in range(count):
                words[rows] |= ids[first + j] << np.uint64(bits * j)
    escaped = at[kind == ESCAPE]
    words[kind == ESCAPE] |= np.arange(len(escaped), dtype=np.uint64)
    return words, ids[escaped]


def decode_block(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    kind = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS] + [1])[kind]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - counts
    for selector, (count, bits) in enumerate(SELECTORS):
        rows = np.nonzero(kind == selector)[0]
        if bits and len(rows):
            mask = np.uint64((1 << bits) - 1)
            w, first = words[rows], begin[rows]
            for j in range(count):
                out[first + j] = (w >> np.uint64(bits * j)) & mask
    rows = np.nonzero(kind == ESCAPE)[0]
    if len(rows):
        out[begin[rows]] = escaped[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


class TokenFileWriter:
    """Appends documents to one open file."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.documents: list[tuple[int, int, int, int, int]] = []
        self.total = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        place = len(self.blocks) * BLOCK_IDS + self.n_waiting
        self.documents.append((doc_id or 0, int(doc_id is not None), len(ids), place // BLOCK_IDS, place % BLOCK_IDS))
        self.total += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            rest = np.concatenate(self.waiting)
            while len(rest) >= BLOCK_IDS:
                self._block(rest[:BLOCK_IDS])
                rest = rest[BLOCK_IDS:]
            self.waiting, self.n_waiting = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        words, escaped = encode_block(ids)
        self.blocks.append((self.at, len(words), len(escaped), len(ids)))
        self._put(words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes())

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        footer = self.at
        self._put(np.array(self.blocks, "<u8").reshape(-1, 4).tobytes())
        self._put(np.array(self.documents, "<i8").reshape(-1, 5).tobytes())
        self._put(struct.pack("<3Q", len(self.blocks), len(self.documents), footer) + MAGIC)
        self.sink.close()


def read_footer(source, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, documents) of a file that can seek and read."""
    source.seek(size - 32)
    tail = source.read(32)
    if tail[24:] != MAGIC:
        raise ValueError("not a whole token file")
    n_blocks, n_documents, footer = struct.unpack("<3Q", tail[:24])
    source.seek(footer)
    raw = source.read(n_blocks * 32 + n_documents * 40)
    return (np.frombuffer(raw[:n_blocks * 32], "<u8").reshape(-1, 4).astype(np.int64),
            np.frombuffer(raw[n_blocks * 32:], "<i8").reshape(-1, 5))


def read_blocks(source, blocks: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of blocks first..last."""
    out = []
    for at, n_words, n_escaped, _ in blocks[first:last + 1].tolist():
        source.seek(at)
        raw = np.frombuffer(source.read(8 * (n_words + n_escaped)), "<u8")
        out.append(decode_block(raw[:n_words], raw[n_words:]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ------------------------------------------------------------ writer, reader
FILES = "range_no int, roll int, path string, documents long, ids long, bytes long"


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text (NULL: empty) and write the ids in ascending doc_id
    order (NULL first; equal ids by text). Returns the written list of files:
    range_no, roll, path, documents, ids, bytes and ``start``, the ids in all
    files before. Other columns are not read; an empty table gives no file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // range_bytes))
    ranged = range_numbers(rows, "doc_id", n, "range_no").repartitionById(n, F.col("range_no")) \
        .sortWithinPartitions("range_no", F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        t, store = tokenizer(path, False, end_id), open_store(folder)
        done: list[tuple] = []
        out = name = None
        number, roll, attempt = -1, 0, uuid.uuid4().hex

        def finish():
            out.close()
            final = f"range-{number:06d}-{roll:04d}.s8b"
            store.commit(f"{name}", final)
            done.append((number, roll, final, len(out.documents), out.total, out.at))

        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                for r, d, ids in zip(part.column(2).to_pylist(), part.column(0).to_pylist(),
                                     t.encode(part.column(1).to_pylist())):
                    if out is not None and (r != number or out.total >= file_ids):
                        finish()
                        roll = roll + 1 if r == number else 0
                        out = None
                    if out is None:
                        roll = roll if r == number else 0
                        number = r
                        name = f"_tmp-{attempt}-{number:06d}-{roll:04d}"
                        out = TokenFileWriter(store.create(name))
                    out.add(d, ids)
        if out is not None:
            finish()
        t.forget()
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)],
                                             names=["range_no", "roll", "path", "documents", "ids", "bytes"])

    files = materialize(ranged.select("doc_id", "text", "range_no").mapInArrow(write, FILES), "token-files")
    # one row a file (some 16 million ids): a running sum over the list of files
    before = Window.orderBy("range_no", "roll").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(files: DataFrame, folder: str, blocks_at_once: int = 32) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids of all documents
    before it), n_tokens and ids_crc32, from the files' bytes alone."""
    def read(batches):
        store = open_store(folder)
        for batch in batches:
            for name, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open(name) as source:
                    blocks, documents = read_footer(source, size)
                    rows: list[tuple] = []
                    held, low, high = np.zeros(0, "<u4"), 0, 0  # blocks low..high-1 are decoded
                    for d, has, n, first, place in documents.tolist():
                        last = first + max(0, place + n - 1) // BLOCK_IDS
                        if last >= high or first < low:
                            low, high = first, min(len(blocks), max(last + 1, first + blocks_at_once))
                            held = read_blocks(source, blocks, low, high - 1).astype("<u4")
                        at = (first - low) * BLOCK_IDS + place
                        rows.append((d if has else None, start, n, zlib.crc32(held[at:at + n].tobytes())))
                        start += n
                    for i in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*rows[i:i + 10_000])],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a file a task: the list is dealt out by its running number
    dealt = files.select("path", "bytes", "start")
    return dealt.repartition(max(1, files.count()), "path").mapInArrow(read, DOCUMENTS)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    files = write_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_tokens(files, folder)
