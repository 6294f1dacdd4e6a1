"""Exact similarity join of word 5-gram sets by a token-group matrix.

Documents are linked when 100 * |A and B| >= 80 * |A or B| for their sets of
word shingles. The join finds the components of that graph without listing all
pairs of a group of near copies:

1. Sets. Each text becomes its set of 64-bit shingle hashes; texts with equal
   sets are one node from then on, known by a digest of the set.
2. Order. Tokens have one global order: those held by more than a few sets come
   last, rarer ones first (counted over all sets), all others by their hash. Two linked sets share a
   token among the first |A| - ceil(0.8 |A|) + 1 of each, its prefix.
3. Groups. The smallest set of those that hold a prefix token is their leader;
   a set that shares enough of its prefix with the leader that most of its
   tokens have joins that leader's group, linked or not, so that a thousand near
   copies are one group. Groups are dealt into chunks of bounded size.
4. Matrix. (token, chunk) rows of the prefix tokens say which chunks a set
   shares tokens with: it asks those chunks (its own one included) with which it
   shares enough of them. Sent there, its overlap with the chunk's token union
   bounds its similarity to every member; a chunk that qualifies is opened, and
   the overlaps with all its members come from the chunk's inverted index.
   Links that join sets which are joined already are not emitted, so that a
   chunk sends back a forest and not all pairs. Members of a chunk are compared
   first, and those of a group of several chunks with the group's commonest
   leader: sets that this joins need no comparing over the group's chunks, as
   their component is known, and only the others ask there.
5. Components of all links, by label propagation with pointer jumping.

Step 4 verifies on whole sets, so the result is exact up to equal 64-bit hashes.
A chunk's queries are compared in blocks of bounded size, each with a copy of
the chunk, and each intermediate is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import (SPACE_WORDS, bound_memory, gram_hashes, lower_ascii, materialize, mix64, read_table, release_memory, row_chunks,
                                 span_hashes, text_buffers, word_spans)

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 80
#: A token is frequent if more sets than this hold it; frequent tokens come last in the order.
FREQUENT = 8
#: Frequent tokens that are told to the tasks (12 bytes each): the most frequent ones. Others stay in hash order,
#: which changes the work and not the result.
MAX_FREQUENT = 1_000_000
#: Share of its prefix tokens, in percent, that a set shares with the leader whose group it joins.
LIKELY = 30
#: Rounds in which groups join larger groups that share their tokens.
GATHER_ROUNDS = 2
#: Sets and tokens of a chunk of a group, and of a block of queries that one task compares with it.
CHUNK_SETS, CHUNK_TOKENS = 4096, 2_000_000
#: Tokens that one task counts or groups.
RANGE_TOKENS = 2_000_000
#: Rows (16 bytes each) up to which the ids of compared documents are broadcast.
BROADCAST_ROWS = 1_000_000


# ---------------------------------------------------------------- sets of texts
def shingle_sets(col: pa.Array, k: int = SHINGLE):
    """The sorted distinct shingle hashes (uint64) of every text of a column:
    all runs of k words, or the whole text if it has fewer but some words."""
    data, offsets = text_buffers(col)
    for a, b in row_chunks(offsets):
        o = offsets[a:b + 1]
        part = lower_ascii(data[o[0]:o[-1]])
        starts, ends, doc = word_spans(part, o - o[0], SPACE_WORDS)
        words = span_hashes(part, starts, ends)
        grams = gram_hashes(words, k)
        first = np.searchsorted(doc, np.arange(b - a + 1))
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            n = hi - lo
            if n >= k:
                yield np.unique(grams[lo:hi - k + 1])
            elif n:
                yield gram_hashes(words[lo:hi], n)
            else:
                yield np.zeros(0, np.uint64)


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n of which a linked set must hold one."""
    return n - -(-percent * n // 100) + 1


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted distinct arrays reach the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_table(docs: DataFrame, doc_id: str, text: str, k: int = SHINGLE, key=None) -> DataFrame:
    """(doc_id, n_shingles, sig): sig is NULL for an empty set. With ``key``, a
    string expression of ``docs``, it comes along as a column of that name."""
    def run(batches):
        for batch in batches:
            sizes, sigs = [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                sigs.append(digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), *batch.columns[2:]],
                                             names=["doc_id", "n_shingles", "sig", *batch.schema.names[2:]])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([] if key is None else [key.alias("key")]))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, sig binary" + (", key string" if key is not None else ""))


def _fresh_sets(batches, k: int):
    """(digest, tokens) of the non-empty sets of rows (text), each set once a
    task, so that copies of a text are sent once."""
    bound_memory()
    seen: set[bytes] = set()
    for batch in batches:
        for s in shingle_sets(batch.column(0), k):
            if len(s):
                sig = digest(s)
                if sig not in seen:
                    seen.add(sig)
                    yield sig, s
    seen.clear()
    release_memory()


# --------------------------------------------------------------- frequent tokens
def range_bits(n_tokens: int) -> int:
    """Leading bits of a token that number its range."""
    return max(0, int(np.ceil(np.log2(max(1, n_tokens / RANGE_TOKENS)))))


def token_keys(tokens: np.ndarray, bits: int) -> np.ndarray:
    """A token's range and the next 32 bits: what is counted and sent. Tokens
    that agree in it are taken for one where only candidates or the order are
    concerned, never where sets are compared."""
    return tokens >> np.uint64(32 - bits)


def _ranges(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys."""
    if not len(keys):
        return []
    r = (keys >> np.uint64(32)).astype(np.int64)
    first = np.nonzero(np.concatenate(([True], r[1:] != r[:-1])))[0]
    return list(zip(r[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


_LOW = np.uint64(0xFFFFFFFF)


def frequent_keys(texts: DataFrame, n_tokens: int, bits: int, frequent: int = FREQUENT, limit: int = MAX_FREQUENT,
                  k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sets) of the keys that more than ``frequent`` sets hold, sorted
    by key; at most ``limit``, the most frequent ones. All sets are counted: a task sends every range of
    the hash one sorted array. Tokens of the upper half of the hash space are
    hardly ever in a prefix and left out."""
    top = np.uint64(1) << np.uint64(63)

    def flush(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        rows = [(r, (keys[a:b] & _LOW).astype("<u4").tobytes(), np.minimum(n[a:b], 255).astype(np.uint8).tobytes())
                for r, a, b in _ranges(keys)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()),
                                           pa.array([x[2] for x in rows], pa.binary())], names=["r", "t", "n"])

    def send(batches):
        held, size = [], 0
        for _, s in _fresh_sets(batches, k):
            s = s[:np.searchsorted(s, top)]
            held.append(token_keys(s, bits))
            size += len(s)
            if size >= 2_000_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bound_memory()
        t = np.concatenate([np.frombuffer(x, "<u4") for x in rows["t"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["n"]]).astype(np.int64)
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.nonzero(np.concatenate(([True], t[1:] != t[:-1])))[0]
        total = np.add.reduceat(n, first)
        many = total > frequent
        return pd.DataFrame({"token": (int(key[0]) << 32) + t[first][many].astype(np.int64), "n": total[many]})

    counted = texts.mapInArrow(send, "r long, t binary, n binary").groupBy("r").applyInPandas(count, "token long, n long")
    rows = counted.orderBy(F.desc("n"), "token").limit(limit).toPandas()
    keys, n = rows["token"].to_numpy(np.int64).astype(np.uint64), rows["n"].to_numpy(np.int64).astype(np.int32)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(tokens: np.ndarray, often: tuple[np.ndarray, np.ndarray], bits: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a sorted set in the global order."""
    held, count = often
    if len(held):
        keys = token_keys(tokens, bits)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        last = held[at] == keys
        later = np.lexsort((tokens[last], count[at[last]]))
        tokens = np.concatenate((tokens[~last], tokens[last][later]))
    return tokens[:prefix_length(len(tokens), percent)]


# -------------------------------------------------------------------- prefix runs
def prefix_runs(texts: DataFrame, often: tuple[np.ndarray, np.ndarray], bits: int, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(run, w, nid, n, leader, leader_n): the sets that share a prefix token,
    with the smallest of them as leader. Runs of one set are left out, and of
    runs with the same sets in one range one is kept, with their number w.
    ``nid`` is half of a set's digest; sets that agree in it share its rows."""
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def flush(keys, nids, sizes):
        keys, nids, sizes = np.concatenate(keys), np.concatenate(nids), np.concatenate(sizes)
        order = np.argsort(keys, kind="stable")
        keys, nids, sizes = keys[order], nids[order], sizes[order]
        rows = [(r, (keys[a:b] & _LOW).astype("<u4").tobytes(), nids[a:b].tobytes(), sizes[a:b].tobytes()) for r, a, b in _ranges(keys)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), *[
            pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2, 3)]], names=["r", "t", "nid", "n"])

    def send(batches):
        keys, nids, sizes, size = [], [], [], 0
        for sig, s in _fresh_sets(batches, k):
            p = token_keys(prefix(s, shared.value, bits, percent), bits)
            keys.append(p)
            nids.append(np.full(len(p), np.frombuffer(sig, "<i8", 1)[0]))
            sizes.append(np.full(len(p), len(s), "<u4"))
            size += len(p)
            if size >= 1_000_000:
                yield flush(keys, nids, sizes)
                keys, nids, sizes, size = [], [], [], 0
        if size:
            yield flush(keys, nids, sizes)

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bound_memory()
        t = np.concatenate([np.frombuffer(x, "<u4") for x in rows["t"]])
        nid = np.concatenate([np.frombuffer(x, "<i8") for x in rows["nid"]])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in rows["n"]])
        order = np.lexsort((nid, n, t))
        t, nid, n = t[order], nid[order], n[order]
        fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (nid[1:] != nid[:-1])))  # copies of a set from other tasks
        t, nid, n = t[fresh], nid[fresh], n[fresh]
        first = np.nonzero(np.concatenate(([True], t[1:] != t[:-1])))[0]
        length = np.diff(np.append(first, len(t)))
        # an order-free hash of the run's sets names it
        name = np.add.reduceat(mix64(nid.view(np.uint64)), first).view(np.int64)
        order = np.lexsort((name, length))
        once = np.zeros(len(first), bool)
        once[order] = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (length[order][1:] != length[order][:-1])))
        keep = np.repeat(once & (length > 1), length)
        at = np.repeat(first, length)[keep]
        # tokens of the range that have these very sets: the weight of the one kept
        rank = np.cumsum(once[order]) - 1
        weight = np.empty(len(first), np.int64)
        weight[order] = np.bincount(rank)[rank]
        return pd.DataFrame({"run": np.repeat(name, length)[keep], "w": np.repeat(weight, length)[keep], "nid": nid[keep],
                             "n": n[keep].astype(np.int32), "leader": nid[at], "leader_n": n[at].astype(np.int32)})

    return texts.mapInArrow(send, "r long, t binary, nid binary, n binary").groupBy("r").applyInPandas(
        group, "run long, w long, nid long, n int, leader long, leader_n int")


# ---------------------------------------------------------- comparing with chunks
LINKS = "a binary, b binary"


class Chunk:
    """Members of a group with their inverted index."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.member = member[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(tokens))

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Places of the members that reach the threshold with a set."""
        none = np.zeros(0, np.int64)
        if not len(self.union):
            return none
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        at = at[self.union[at] == s]
        # a linked member holds percent of the set's tokens, and so does the union
        if 100 * len(at) < self.percent * len(s):
            return none
        a, n = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(self.member[places], minlength=len(self.sizes))
        return np.nonzero(100 * both >= self.percent * (self.sizes + len(s) - both))[0]


def compare(asks: DataFrame, members: DataFrame, tokens: DataFrame, percent: int = PERCENT,
            block_sets: int = CHUNK_SETS, block_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Links (a, b) that connect whatever is similar between the queries of a
    chunk and its members, and among its members. ``asks``: (gid, sig, n,
    own), own where the query is a member itself; ``members``: (gid, sig, n);
    ``tokens``: (sig, tokens, part), of which a set's first part counts. Queries are dealt into blocks of bounded size,
    each with a copy of the members, whose number callers bound."""
    outside = asks.where(~F.col("own"))
    load = (asks.groupBy("gid").agg(
        F.sum(F.when(F.col("own"), 0).otherwise(1)).alias("q"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("t"),
        F.max("own").alias("inner"))
        .select("gid", "inner", F.greatest(F.lit(1), F.ceil(F.col("q") / block_sets), F.ceil(F.col("t") / block_tokens)).cast("int").alias("blocks")))
    load = materialize(load, "join-load")
    left = outside.join(load, "gid").select("gid", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"),
                                            "sig", F.lit(0).alias("side"))
    # members are compared with each other in block 0, if some of them may be linked
    right = members.join(load, "gid").select("gid", "sig", "inner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(
        "gid", "block", "sig", F.when(F.col("inner") & (F.col("block") == 0), 2).otherwise(1).alias("side"))
    first = tokens.groupBy("sig").agg(F.min("part").alias("part"))
    rows = left.unionByName(right).join(first, "sig").join(tokens, ["sig", "part"]).drop("part")

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        bound_memory()
        block = block.sort_values(["side", "sig"], ascending=[False, True])
        side = block["side"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in block["tokens"]]
        sigs = block["sig"].tolist()
        m = int((side > 0).sum())
        chunk = Chunk(sets[:m], percent)
        label = list(range(len(sets)))

        def find(i: int) -> int:
            while label[i] != i:
                label[i] = i = label[label[i]]
            return i

        found = []
        for q in np.nonzero(side != 1)[0].tolist():
            for i in chunk.linked(sets[q]).tolist():
                x, y = find(q), find(i)
                if x != y:
                    label[x] = y
                    if sigs[q] != sigs[i]:
                        found.append((sigs[q], sigs[i]))
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("gid", "block").applyInPandas(run, LINKS)


# --------------------------------------------------------------------- components
def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(sig, label): the least node of each node's component, for all nodes of
    links (a, b). Labels go along links and then along labels, so that long
    chains halve; each round is written."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "sig"), "join-labels")
    for _ in range(rounds):
        near = (both.join(labels, both["b"] == labels["sig"]).groupBy("a").agg(F.min("label").alias("near")))
        step = labels.join(near, labels["sig"] == near["a"]).select("sig", "label", F.least("label", "near").alias("next"))
        step = materialize(step, "join-step")
        jump = step.select(F.col("sig").alias("n_sig"), F.col("next").alias("n_next"))
        moved = step.join(jump, step["next"] == jump["n_sig"]).select("sig", "label", F.least("next", "n_next").alias("next"))
        moved = materialize(moved, "join-moved")
        changed = moved.where(F.col("next") != F.col("label")).count()
        labels = moved.select("sig", F.col("next").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


# --------------------------------------------------------------------------- join
def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                          percent: int = PERCENT, frequent: int = FREQUENT, chunk_sets: int = CHUNK_SETS,
                          chunk_tokens: int = CHUNK_TOKENS, likely: int = LIKELY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest
    doc_id reachable by links. NULL and empty texts and texts without words
    have no shingles and are their own component; rows with equal sets share
    one; a NULL doc_id counts only where its component has no other id. Other
    columns are not read; an empty table gives an empty result."""
    sets = materialize(set_table(docs, doc_id, text, k), "join-sets")
    classes = similarity_classes(docs, sets, doc_id, text, k, percent, frequent, chunk_sets, chunk_tokens, likely)
    out = sets.join(classes, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similarity_classes(docs: DataFrame, sets: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                       percent: int = PERCENT, frequent: int = FREQUENT, chunk_sets: int = CHUNK_SETS,
                       chunk_tokens: int = CHUNK_TOKENS, likely: int = LIKELY) -> DataFrame:
    """(sig, class, component_id) of every set in ``sets``, the set_table of
    ``docs``: class is the least digest reachable by links, which tells
    components apart where ids are NULL or repeated."""
    nodes = sets.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    n_tokens = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    texts = docs.select(F.col(text).alias("text"))
    bits = range_bits(n_tokens)
    often = frequent_keys(texts, n_tokens, bits, frequent, k=k)
    runs = materialize(prefix_runs(texts, often, bits, percent, k), "join-runs")

    # from here on only sets that share a prefix token with another one
    involved = runs.select("nid").distinct()
    known = nodes.withColumn("nid", nid_of(F.col("sig"))).join(involved, "nid", "left_semi")
    known = materialize(known.select("nid", "sig", "doc_id", "n"), "join-known")

    # groups: sets and the leader that most of their prefix tokens have; others are groups of one
    leading = (runs.where(F.col("nid") != F.col("leader")).groupBy("nid", "leader")
               .agg(F.sum("w").alias("c"), F.max("n").alias("n")))
    best = (leading.where(F.col("c") * 100 >= likely * (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1))
            .groupBy("nid").agg(F.max(F.struct("c", "leader"))["leader"].alias("leader")))
    names = known.select("nid", "sig")
    star = (best.join(names, "nid").join(names.select(F.col("nid").alias("leader"), F.col("sig").alias("b")), "leader")
            .select(F.col("sig").alias("a"), "b").where("a != b"))
    group = known.select("nid", "sig", "n").join(components(star), "sig", "left").select(
        "nid", "sig", "n", F.coalesce("label", "sig").alias("group"))
    weights = materialize(runs.groupBy("run", "nid").agg(F.sum("w").alias("w")), "join-weights")
    for _ in range(GATHER_ROUNDS):
        group = gather_groups(weights, materialize(group, "join-gathered"), percent, likely)
    sizes = group.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk_sets), F.ceil(F.sum("n") / chunk_tokens)).alias("chunks"))
    sizes = materialize(sizes, "join-sizes")
    group = materialize(group.join(sizes, "group").select("nid", "sig", "n", "group", "chunks", F.concat(
        "group", F.lit("/").cast("binary"), F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("string").cast("binary")).alias("gid")), "join-groups")
    chunk = group.groupBy(F.col("gid").alias("g")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    chunk = materialize(chunk, "join-chunks")
    several = group.where(F.col("chunks") > 1).select("nid", "sig", "n", "group", "gid")
    inside = group.join(chunk.where(F.col("m") > 1).select(F.col("g").alias("gid")), "gid", "left_semi").select("gid", "sig", "n")

    # the matrix: a row for a token (a run) and a chunk; a set asks the chunks that it shares tokens with (numbers stand for
    # the names of groups and chunks)
    owned = chunk.select(F.col("g").alias("gid"), F.col("m").cast("int").alias("own_m"))
    asking = group.join(owned, "gid").select("nid", F.xxhash64("group").alias("in"), F.xxhash64("gid").alias("at"), "own_m")
    placed = materialize(weights.join(asking, "nid"), "join-placed")
    matrix = placed.select(F.col("run").alias("to_run"), F.col("at").alias("to"), F.col("in").alias("to_in"), F.col("own_m").alias("m")).distinct()

    def bounded(rows: DataFrame, which, name: str) -> DataFrame:
        """The asks of placed rows whose shared prefix tokens may suffice for some member of a chunk."""
        shared = rows.join(matrix, (F.col("run") == F.col("to_run")) & which).groupBy("nid", "to").agg(F.sum("w").alias("c"))
        shared = shared.join(group.select("nid", "sig", "n"), "nid").join(chunk.select("*", F.xxhash64("g").alias("to")), "to")
        low = F.greatest(F.col("low"), F.ceil(percent * F.col("n") / 100))
        high = F.least(F.col("high"), F.floor(100 * F.col("n") / percent))
        enough = F.col("c") >= F.least(shared_needed(F.col("n"), low, percent), shared_needed(F.col("n"), high, percent))
        return materialize(shared.where((low <= high) & enough).select(F.col("g").alias("gid"), "sig", "n", F.lit(False).alias("own")), name)

    # of two groups' chunks the smaller one asks the larger one
    larger = (F.col("own_m") < F.col("m")) | ((F.col("own_m") == F.col("m")) & (F.col("at") > F.col("to")))
    abroad = bounded(placed, (F.col("in") != F.col("to_in")) & larger, "join-asks-abroad")
    asked = group.join(abroad.select("gid").distinct(), "gid", "left_semi")
    named = inside.select("sig").unionByName(several.select("sig")).unionByName(abroad.select("sig")).unionByName(asked.select("sig")).distinct()
    tokens = materialize(_tokens_of(docs, doc_id, text, known.join(named, "sig", "left_semi"), k), "join-tokens")

    # links within the chunks, and of the members of a group of several chunks with the one that most have as leader
    heads = several.join(best, "nid").groupBy("group", "leader").agg(F.count(F.lit(1)).alias("c"))
    heads = heads.groupBy("group").agg(F.max(F.struct("c", "leader"))["leader"].alias("nid")).join(names, "nid")
    heads = heads.join(named, "sig", "left_semi")
    at_head = F.concat("group", F.lit("/head").cast("binary")).alias("gid")
    near = materialize(compare(
        inside.withColumn("own", F.lit(True)).unionByName(several.select(at_head, "sig", "n", F.lit(False).alias("own"))),
        inside.select("gid", "sig", "n").unionByName(heads.select(at_head, "sig", F.lit(0).alias("n"))), tokens, percent, chunk_sets, chunk_tokens),
        "join-near")
    # the sets of a group that these links join already need no comparing over its chunks: only the others ask there
    labels = components(near)
    main = several.join(labels, "sig").groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
    main = main.groupBy("group").agg(F.max(F.struct("c", "label"))["label"].alias("label"))
    joined = several.select("nid", "sig", "group").join(labels, "sig").join(main, ["group", "label"], "left_semi").select("nid")
    outside = materialize(several.select("nid").join(joined, "nid", "left_anti"), "join-outside")
    home = bounded(placed.join(outside, "nid", "left_semi"), (F.col("in") == F.col("to_in")) & (F.col("at") != F.col("to")), "join-asks-home")
    asks = abroad.unionByName(home)
    members = materialize(group.select("gid", "sig", "n").join(asks.select("gid").distinct(), "gid", "left_semi"), "join-members")
    links = near.unionByName(materialize(compare(asks, members, tokens, percent, chunk_sets, chunk_tokens), "join-links"))

    label = components(links)
    named = known.select("sig", "doc_id").join(label, "sig")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "label").select("sig", "label", "component_id")
    alone = nodes.join(linked, "sig", "left").select("sig", F.coalesce("label", "sig").alias("class"),
                                                     F.coalesce("component_id", "doc_id").alias("component_id"))
    return materialize(alone, "join-classes")


def gather_groups(weights: DataFrame, group: DataFrame, percent: int, likely: int) -> DataFrame:
    """Let each group join the larger group with which it shares most prefix
    tokens, if they are enough: near copies whose rare tokens have different
    leaders come together. A token stands for the largest group that holds it,
    so that the rows are those of ``weights`` (run, nid, w)."""
    sizes = group.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum(
        F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).alias("prefix"))
    sizes = materialize(sizes, "join-group-sizes")
    held = materialize(weights.join(group.select("nid", "group"), "nid").join(sizes, "group").groupBy("run", "group").agg(
        F.sum("w").alias("w"), F.max("members").alias("members"), F.max("prefix").alias("prefix")), "join-held")
    largest = held.groupBy("run").agg(F.max(F.struct("members", "group")).alias("top"))
    meets = held.join(largest, "run").where(
        (F.col("members") < F.col("top.members")) | ((F.col("members") == F.col("top.members")) & (F.col("group") < F.col("top.group"))))
    best = (meets.groupBy("group", F.col("top.group").alias("to")).agg(F.sum("w").alias("c"), F.max("prefix").alias("prefix"))
            .where(F.col("c") * 100 >= likely * F.col("prefix")).groupBy("group").agg(F.max(F.struct("c", "to"))["to"].alias("to")))
    label = components(best.select(F.col("group").alias("a"), F.col("to").alias("b"))).withColumnRenamed("sig", "group")
    return group.join(label, "group", "left").select("nid", "sig", "n", F.coalesce("label", "group").alias("group"))


def shared_needed(a, b, percent: int = PERCENT):
    """Prefix tokens that linked sets of a and b tokens share at least. Of the
    two prefixes one ends first in the global order; common tokens up to there
    are in both, and the others are among the rest of that set, whose prefix
    leaves ceil(percent * size) - 1 tokens. One less, for rounding."""
    overlap = F.ceil(percent * (a + b) / (100 + percent))
    return F.greatest(F.lit(1), overlap - (F.ceil(percent * F.greatest(a, b) / 100) - 1) - 1)


def nid_of(sig):
    """The first eight bytes of a digest as a bigint, little-endian."""
    parts = [F.shiftleft(F.conv(F.hex(F.substring(sig, i + 1, 1)), 16, 10).cast("bigint"), 8 * i) for i in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _tokens_of(docs: DataFrame, doc_id: str, text: str, known: DataFrame, k: int) -> DataFrame:
    """(sig, tokens, part) of the known sets, from the texts of the documents
    that stand for them; rows that repeat an id and its text give a set once a
    task, and ``part`` tells these apart."""
    ids = known.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "nid").distinct()
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_null", F.col("doc_id").isNull())

    def run(batches):
        bound_memory()
        seen: set[bytes] = set()
        part = TaskContext.get().partitionId()
        held: list[tuple[bytes, bytes]] = []
        size = 0
        for batch in batches:
            for wanted, s in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0), k)):
                sig = digest(s) if len(s) else b""
                # a document with the id of another one has a set of its own
                if len(s) and int.from_bytes(sig[:8], "little", signed=True) == wanted and sig not in seen:
                    seen.add(sig)
                    held.append((sig, s.tobytes()))
                    size += 8 * len(s)
                    if size >= 4 << 20:
                        yield _rows(held, part)
                        held, size = [], 0
        if held:
            yield _rows(held, part)
        release_memory()

    def _rows(held, part):
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.binary()), pa.array([t for _, t in held], pa.binary()),
                                           pa.array([part] * len(held), pa.int32())], names=["sig", "tokens", "part"])

    return own.join(side, ["_id", "_null"]).select("text", "nid").mapInArrow(run, "sig binary, tokens binary, part int")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
