"""Benchmark decontamination by winnowing.

A text is a sequence of words. Of every ``w`` consecutive k-gram hashes the
smallest one is kept as a fingerprint (Schleimer, Wilkerson and Aiken, 2003),
so two texts that share ``k + w - 1`` consecutive words share a fingerprint.
With k + w - 1 = window length, joining the fingerprints of training and test
texts finds every training document that can hold a test window. Hits are then
extended: the candidates' word positions are compared with whole test windows,
and every word inside a match counts as hit.

A fingerprint is a 64-bit hash; equal hashes of unequal grams only cost an
extension that finds nothing. Items shorter than the window are one window of their own length; for those
lengths k is the length itself and w is 1.

Everything is DataFrame functions: the arrays of a document never leave its
row, and what is shuffled are candidate rows. The benchmark's fingerprints and
windows are broadcast only when their counted rows are within
``broadcast_rows``; beyond that the same joins run as shuffle joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, read_table

#: Fixed value: what separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: k of the fingerprints of full windows; w is WINDOW - K + 1.
K = 5
#: Benchmark rows (16 bytes each) up to which a join may broadcast them.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Array of the words of a text; NULL text has none. (Splitting is ten
    times as fast as regexp_extract_all.)"""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _starts(n: Column, length: int, first: int = 1) -> Column:
    """Starts of the runs of ``length`` in n things (empty if none)."""
    return F.when(n >= length, F.sequence(F.lit(first), n - length + first)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, k: int, w: int) -> Column:
    """Distinct winnowed k-gram hashes of an array of words. Elements are taken
    by position: slice() inside a lambda would copy the whole array each time."""
    def grams(h: Column) -> Column:
        return h if k == 1 else F.transform(
            _starts(F.size(h), k, 0), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def least(g: Column) -> Column:
        return g if w == 1 else F.transform(
            _starts(F.size(g), w, 0), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))

    # transform over a one-element array binds a name, so that each step is computed once a row
    hashes = F.array(F.transform(words, lambda x: F.xxhash64(x)))
    return F.array_distinct(F.transform(F.transform(hashes, grams), least)[0])


def window_texts(words: Column, length: int) -> Column:
    """Every run of ``length`` words as one text, in order."""
    return F.transform(_starts(F.size(words), length, 0),
                       lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(length)]))


def _maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def find_windows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K,
                 broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(base, found). base: one row per row of ``docs`` with ``text_key``,
    ``doc_id`` and ``n_words``. found: one row per matching window of a
    distinct text, (text_key, pos, len, window), where pos is the 1-based
    position of its first word. Repeated rows stay separate rows of base; NULL
    and empty texts have no words and match nothing; an empty benchmark or an
    item without words matches nothing; other columns are not read."""
    spark = docs.sparkSession
    item_words = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("ws"))
    item_words = item_words.where(F.size("ws") > 0).withColumn("len", F.least(F.size("ws"), F.lit(window)))
    item_words = materialize(item_words, "decon-items")
    lengths = sorted(r["len"] for r in item_words.select("len").distinct().collect())

    def by_length(f):
        """f for items of each length that occurs, at most ``window`` of them."""
        return reduce(lambda a, b: a.unionByName(b), [f(n) for n in lengths]) if lengths else None

    # a row is known by the md5 of its text: the result depends on the text alone, and copies are searched once
    base = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(doc_id).alias("doc_id"),
                       words_of(F.col(text)).alias("ws"))
    if not lengths:
        empty = spark.range(0).select(F.lit("").alias("text_key"), F.lit(0).alias("pos"), F.lit(0).alias("len"),
                                      F.lit("").alias("window"))
        return base.select("text_key", "doc_id", F.size("ws").cast("long").alias("n_words")), empty

    def prints(n: int) -> Column:
        return fingerprints(F.col("ws"), k, n - k + 1) if n == window else fingerprints(F.col("ws"), n, 1)

    test = by_length(lambda n: item_words.where(F.col("len") == n).select(
        F.lit(n).alias("len"), F.explode(prints(n)).alias("fp"))).distinct()
    test = materialize(test, "decon-prints")

    def marked(n: int) -> Column:
        return F.transform(prints(n), lambda fp: F.struct(F.lit(n).alias("len"), fp.alias("fp")))

    marks = F.flatten(F.array(*[marked(n) for n in lengths]))
    shared = (base.select("text_key", F.explode(marks).alias("m")).select("text_key", "m.len", "m.fp")
              .join(_maybe_broadcast(test, test.count(), broadcast_rows), ["len", "fp"], "left_semi")
              .groupBy("text_key").agg(F.collect_set("len").alias("lens")))  # at most ``window`` lengths
    candidates = materialize(shared, "decon-candidates")
    rows = base.join(_maybe_broadcast(candidates, candidates.count(), broadcast_rows), "text_key", "left")
    rows = materialize(rows.select("text_key", "doc_id", F.size("ws").cast("long").alias("n_words"), "lens",
                                   F.when(F.col("lens").isNotNull(), F.col("ws")).alias("ws")), "decon-rows")

    # extension: whole windows of the candidates against whole windows of the items
    own = by_length(lambda n: item_words.where(F.col("len") == n).select(
        F.lit(n).alias("len"), F.explode(window_texts(F.col("ws"), n)).alias("window"))).distinct()
    own = materialize(own, "decon-windows")
    n_own = own.count()
    texts = rows.where(F.col("lens").isNotNull()).groupBy("text_key").agg(
        F.first("ws").alias("ws"), F.first("lens").alias("lens"))
    placed = by_length(lambda n: texts.where(F.array_contains("lens", n)).select(
        "text_key", F.lit(n).alias("len"), F.posexplode(window_texts(F.col("ws"), n)).alias("pos", "window")))
    found = placed.join(_maybe_broadcast(own, n_own, broadcast_rows), ["len", "window"]).select(
        "text_key", (F.col("pos") + 1).alias("pos"), "len", "window")
    return rows.select("text_key", "doc_id", "n_words"), materialize(found, "decon-found")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: text_key, doc_id, n_words, n_hit (words
    inside a matching window), n_items, items_sha256 (of the sorted,
    comma-joined ids; of the empty text if none) and contaminated."""
    base, found = find_windows(docs, items, doc_id, text, item_id, item_text, window, k, broadcast_rows)
    n_hit = (found.select("text_key", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("at"))
             .distinct().groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit")))
    ws = words_of(F.col(item_text))
    item_rows = items.select(F.col(item_id).cast("string").alias("item_id"), ws.alias("ws")).where(F.size("ws") > 0)
    item_windows = item_rows.select("item_id", F.explode(F.when(
        F.size("ws") >= window, window_texts(F.col("ws"), window)).otherwise(F.array(F.array_join("ws", " ")))).alias("window"))
    named = (found.select("text_key", "window").distinct().join(item_windows.distinct(), "window")
             .select("text_key", "item_id").distinct().groupBy("text_key")
             .agg(F.count("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("ids")))
    # written first: the join with all rows then has no aggregate in its stage, and copies of one text can be split
    per_text = materialize(n_hit.join(named, "text_key"), "decon-texts")
    out = base.join(per_text, "text_key", "left")
    return out.select(
        "text_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                        read_table(spark, sf_dir, "benchmark"))
    return out.drop("text_key")


#: The same by comparing every window of every document; no fingerprints.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS w
       FROM i, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM (
       SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT dw.r, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
