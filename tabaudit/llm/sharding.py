"""Sharding by a permutation-filled lookup table (Maglev hashing).

Every shard has a preference order over the slots of a prime-sized table,
``(offset + i * skip) mod size``. The shards take turns; each claims the next
slot of its order that is still free, until the table is full. A row goes to
slot ``hash(key) mod size`` and to the shard that holds the slot, so that
placement is one lookup in a table whose size is a parameter.

The table is a parameter-sized plan (like a list of shard names), filled once
on the driver; placement itself is DataFrame functions and one join with a
broadcast of exactly ``table_size`` rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters of the query: 64 shards, 127 or 128 slots each.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
TABLE_SIZE = 8191
#: The lookup table is broadcast, so its size has a hard bound (2 MB).
MAX_TABLE_SIZE = 131_071


def _number(text: str) -> int:
    """First 15 hex digits of the md5 as an integer (the same in SQL)."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's permutation; skip is never 0."""
    return _number(f"offset:{shard}") % size, _number(f"skip:{shard}") % (size - 1) + 1


def fill_table(shards: list[str], size: int) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be non-empty and distinct")
    if size < len(shards) or size > MAX_TABLE_SIZE or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"table size must be a prime from {len(shards)} to {MAX_TABLE_SIZE}")
    order = [preference(s, size) for s in shards]
    at = [0] * len(shards)
    slots = [-1] * size
    for turn in range(size):
        s = turn % len(shards)
        offset, skip = order[s]
        while slots[(offset + at[s] * skip) % size] >= 0:
            at[s] += 1
        slots[(offset + at[s] * skip) % size] = s
        at[s] += 1
    return slots


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard) with exactly ``size`` rows, built from one literal."""
    text = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    return (spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "no"))
            .select("slot", F.element_at(names, F.col("no").cast("int") + 1).alias("shard")))


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: md5 of its text; a NULL key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None,
                  size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with its slot and shard. Rows with equal keys share a shard; a
    NULL key is placed like empty text; an empty table stays empty. Columns of
    ``df`` that are named like the two outputs are replaced; other columns are
    kept as they are. No row moves: the table is broadcast."""
    shards = SHARDS if shards is None else shards
    kept = df.drop(slot_col, shard_col) if key not in (slot_col, shard_col) else df
    table = lookup_table(df.sparkSession, shards, size).select(
        F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    placed = kept.withColumn("_slot", slot_of(F.col(key), size)).join(F.broadcast(table), "_slot", "left")
    return placed.select(*[placed[c] for c in kept.columns],
                         placed["_slot"].alias(slot_col), placed["_shard"].alias(shard_col))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs).select("doc_id", "slot", "shard")


def oracle_sql(n_shards: int = 64, size: int = TABLE_SIZE) -> str:
    """The same table by a recursive query, one turn a step."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (
  SELECT i AS s, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard FROM range({n_shards}) t(i)),
pref AS (
  SELECT list({number.format("'offset:' || shard")} % {size} ORDER BY s) AS offs,
         list({number.format("'skip:' || shard")} % {size - 1} + 1 ORDER BY s) AS skips FROM shards),
fill(turn, slot, used) AS (
  SELECT 0, offs[1], set_bit(bitstring('0', {size}), offs[1]::INTEGER, 1) FROM pref
  UNION ALL
  SELECT turn + 1, c.slot, set_bit(used, c.slot::INTEGER, 1) FROM fill, pref, LATERAL (
    SELECT arg_min(x.slot, j) AS slot FROM (
      SELECT j, (offs[(turn + 1) % {n_shards} + 1] + j * skips[(turn + 1) % {n_shards} + 1]) % {size} AS slot
      FROM range({size}) r(j)) x
    WHERE get_bit(used, x.slot::INTEGER) = 0) c
  WHERE turn + 1 < {size}),
placed AS (SELECT slot, turn % {n_shards} AS s FROM fill)
SELECT d.doc_id, p.slot::INTEGER AS slot, s.shard
FROM (SELECT doc_id, {number.format("coalesce(doc_id::VARCHAR, '')")} % {size} AS slot FROM documents) d
JOIN placed p USING (slot) JOIN shards s USING (s)"""
