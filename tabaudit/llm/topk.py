"""Exact nearest neighbours of binary codes by multi-index hashing.

A code of 64 bits is cut into segments of about log2 of the number of codes in
a block, so that a bucket holds about one code. If two codes differ in at most
``r`` bits, then with radius a = r // segments and rest = r % segments either
one of the first rest + 1 segments differs in at most a bits or one of the
others in at most a - 1 (Norouzi, Punjani and Fleet, 2012). So a search probes,
segment by segment, the buckets at segment distance 0, then 1, and so on; after
each segment every code within the distance covered so far has been seen, and a
query is done as soon as its kth verified distance is covered.

Codes are searched, not rows: equal codes are one entry that keeps its k
smallest ids, which is all that k results can need, so neither copies of a
vector nor copies of a query multiply work. Entries and queries are dealt into
blocks; each task indexes one block of entries and answers one block of
queries exactly, and the k best of each block are merged. A query brings the
distance that its own block proved for the kth result, so that the other
blocks stop at that radius.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, read_table

BITS = 64
#: Bounds of a segment's bits.
LEAST_WIDTH, MOST_WIDTH = 4, 16
K = 10
QUERY_EVERY = 20
#: Codes of a block that a task indexes, and of a block of queries.
ENTRY_BLOCK = 1 << 16
QUERY_BLOCK = 1 << 12


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The signs of the first ``bits`` dimensions as a bigint, the first one
    in the highest bit; positive is 1, and NULL, NaN, zero, negative or missing
    ones 0. A NULL vector has no code."""
    def bit(i: int) -> Column:
        x = F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0))
        return F.when((x > 0) & ~F.isnan(x), F.shiftleft(F.lit(1).cast("bigint"), bits - 1 - i)).otherwise(F.lit(0).cast("bigint"))

    out = bit(0)
    for i in range(1, bits):
        out = out.bitwiseOR(bit(i))
    return F.when(vector.isNotNull(), out)


@lru_cache(maxsize=256)
def flips(bits: int, distance: int) -> np.ndarray:
    """All masks of ``bits`` bits with ``distance`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), distance)], np.int64)


def segment_count(n: int, bits: int = BITS) -> int:
    """Segments of a block of n codes."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, round(np.log2(max(2, n)))))
    return -(-bits // width)


class MultiIndex:
    """A multi-index over one block of distinct codes (uint64)."""

    def __init__(self, codes: np.ndarray, segments: int | None = None, bits: int = BITS):
        self.codes = codes
        m = segments or segment_count(len(codes), bits)
        ends = [bits * (s + 1) // m for s in range(m)]
        self.cuts = [(a, b - a) for a, b in zip([0, *ends], ends)]  # first bit and width of every segment
        self.looked_up = 0  # codes taken from buckets by all searches
        self.tables = []
        for s, (_, width) in enumerate(self.cuts):
            value = self.segment(codes, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << width) + 1))))

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        at, width = self.cuts[s]
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, query: np.uint64, k: int, weights: np.ndarray, stop_at: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) that hold the k nearest ids, ties at the kth
        distance included. ``weights``: ids that a code stands for;
        ``stop_at``: a distance known to hold k ids elsewhere."""
        seen = np.zeros(0, np.int64)
        far = np.zeros(0, np.int64)
        fresh = np.ones(len(self.codes), bool)
        own = [int(self.segment(np.array([query], np.uint64), s)[0]) for s in range(len(self.cuts))]
        kth = stop_at
        for radius in range(max(width for _, width in self.cuts) + 1):
            for s, (_, width) in enumerate(self.cuts):
                if radius <= width:
                    order, first = self.tables[s]
                    value = own[s] ^ flips(width, radius)
                    a, n = first[value], first[value + 1] - first[value]
                    held = np.nonzero(n)[0]
                    a, n = a[held], n[held]
                    got = order[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] \
                        if len(n) else np.zeros(0, np.int64)
                    self.looked_up += len(got)
                    got = got[fresh[got]]
                    if len(got):
                        fresh[got] = False
                        d = np.bitwise_count(self.codes[got] ^ query).astype(np.int64)
                        near = d <= kth
                        seen, far = np.concatenate((seen, got[near])), np.concatenate((far, d[near]))
                        rank = np.argsort(far, kind="stable")
                        enough = np.searchsorted(np.cumsum(weights[seen[rank]]), k)
                        if enough < len(rank):
                            kth = min(kth, int(far[rank[enough]]))
                            keep = far <= kth
                            seen, far = seen[keep], far[keep]
                # all codes within this distance have been seen by now
                if kth <= radius * len(self.cuts) + s:
                    return seen, far
        return seen, far


PAIRS = "query_code long, code long, distance int"


def search_codes(entries: DataFrame, queries: DataFrame, k: int = K, segments: int | None = None,
                 entry_block: int = ENTRY_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_code, code, distance) that hold every query code's k nearest
    ids. ``entries``: (code, n) with distinct codes and the ids each stands
    for; ``queries``: (code), distinct."""
    spark = entries.sparkSession
    n_entries, n_queries = entries.count(), queries.count()
    eb, qb = max(1, -(-n_entries // entry_block)), max(1, -(-n_queries // query_block))
    block = F.pmod(F.xxhash64("code"), F.lit(eb)).cast("int")
    e = entries.withColumn("eb", block)
    q = queries.withColumn("qb", F.pmod(F.xxhash64("code", F.lit("q")), F.lit(qb)).cast("int"))

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"query_code": [], "code": [], "distance": []}
        if len(left) and len(right):
            codes = left["code"].to_numpy(np.int64).view(np.uint64)
            weights = left["n"].to_numpy(np.int64)
            index = MultiIndex(codes, segments)
            for query, stop in zip(right["code"].to_numpy(np.int64).view(np.uint64), right["stop"].tolist()):
                at, d = index.search(query, k, weights, stop)
                found["query_code"].append(np.full(len(at), query, np.uint64).view(np.int64))
                found["code"].append(codes[at].view(np.int64))
                found["distance"].append(d.astype(np.int32))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int32 if c == "distance" else np.int64)
                             for c, v in found.items()})

    def answer(wanted: DataFrame) -> DataFrame:
        """wanted: (code, qb, eb, stop), a row for each block to ask."""
        spread = wanted.select(F.col("qb").alias("to_qb"), F.col("eb").alias("to_eb")).distinct()
        sent = e.join(spread, e["eb"] == spread["to_eb"]).select("code", "n", F.col("to_qb").alias("qb"), F.col("to_eb").alias("eb"))
        return sent.groupBy("qb", "eb").cogroup(wanted.groupBy("qb", "eb")).applyInPandas(one, PAIRS)

    # each query asks one block first; the kth distance there bounds its search of the others
    home = q.withColumn("eb", block).withColumn("stop", F.lit(BITS))
    first = materialize(answer(home), "topk-first")
    if eb == 1:
        return first
    kth = (first.join(entries, "code").groupBy(F.col("query_code").alias("code"))
           .agg(F.array_sort(F.collect_list(F.struct("distance", "n"))).alias("d"))
           .select("code", F.aggregate("d", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(BITS).alias("stop")),
                                       lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(
                                           (a["n"] < k) & (a["n"] + x["n"] >= k), x["distance"]).otherwise(a["stop"]).alias("stop")))["stop"].alias("stop")))
    rest = (q.join(kth, "code", "left").withColumn("stop", F.coalesce("stop", F.lit(BITS)))
            .withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(eb - 1)))).where(F.col("eb") != block))
    return first.unionByName(answer(rest))


def top_k(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", k: int = K,
          query_every: int = QUERY_EVERY, segments: int | None = None, entry_block: int = ENTRY_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows, by (Hamming distance of sign codes, id), of every
    row whose id is divisible by ``query_every``, the row itself excepted:
    query_id, rank (from 1), neighbor_id, distance. Rows with a NULL id or
    vector are neither queries nor results; rows that repeat an id count once
    per distinct code; fewer than k rows give fewer results; other columns are
    not read."""
    coded = rows.select(F.col(row_id).cast("long").alias("id"), sign_code(F.col(vector)).alias("code")) \
        .where(F.col("id").isNotNull() & F.col("code").isNotNull())
    coded = materialize(coded, "topk-codes").distinct()
    # k + 1 ids a code, as a query leaves itself out; salted, so that a code held by a third of the rows is
    # cut down in many tasks first
    least = k + 1
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    within = Window.partitionBy("code", "salt").orderBy("id")
    held = (salted.withColumn("r", F.row_number().over(within)).where(F.col("r") <= least)
            .groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, least).alias("ids")))
    held = materialize(held, "topk-entries")
    queries = materialize(coded.where(F.col("id") % query_every == 0), "topk-queries")
    pairs = search_codes(held.select("code", F.size("ids").cast("long").alias("n")), queries.select("code").distinct(),
                         k + 1, segments, entry_block, query_block)
    # a query code's own k + 1 best, then each query's k best without itself
    named = pairs.join(held, "code").select("query_code", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("query_code").orderBy("distance", "neighbor_id")
    best = (named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= least)
            .groupBy("query_code").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("best")))
    answered = queries.join(best, queries["code"] == best["query_code"]).select(
        F.col("id").alias("query_id"),
        F.slice(F.filter("best", lambda x: x["neighbor_id"] != F.col("id")), 1, k).alias("best"))
    return answered.select("query_id", F.posexplode("best").alias("r", "x")).select(
        "query_id", (F.col("r") + 1).alias("rank"), "x.neighbor_id", "x.distance")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


#: Every query against every row.
ORACLE = """
WITH c AS (SELECT DISTINCT vec_id AS id, array_to_string([CASE WHEN embedding[i + 1] > 0
             AND NOT isnan(embedding[i + 1]) THEN '1' ELSE '0' END FOR i IN range(64)], '')::BIT AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.id AS query_id, r.id AS neighbor_id, bit_count(xor(q.code, r.code)) AS distance
      FROM c q JOIN c r ON q.id <> r.id WHERE q.id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance::INTEGER AS distance FROM o WHERE rank <= 10"""
