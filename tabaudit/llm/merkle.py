"""Merkle manifest of a table, and octopus multiproofs of its rows.

A row's leaf is the SHA-256 of its fields, each ``-`` if NULL and otherwise
its UTF-8 byte count, ``:`` and the value. The leaves of a tree (one a
language) ascend by id; every FAN consecutive nodes become the digest of their
hex digests until one is left, the subroot; subroots, NULL language first and
then by UTF-8 bytes, become the root in the same way.

Leaves get their places by a range sort and per-range counts, so that a tree
with most rows is spread like any other. Interior nodes are made in blocks of
FAN ** BLOCK_LEVELS nodes, BLOCK_LEVELS levels a round. For the proofs every
block of leaves works out the coordinates (level, place) of the nodes that its
leaves need and cannot derive themselves, each once; one join fetches them; the
block derives the interior nodes that its leaves share, and expands the proof
of every leaf locally. The same code proves any subset of the leaves.

Defined results: a NULL id sorts before all others and is never tampered with;
rows with equal ids are ordered by their leaves (rows equal in all fields have
one leaf, and any order of them is the same tree); a lone leaf is its subroot,
a lone subroot the root, with no siblings; an empty table has no proofs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, read_table

FAN = 8
#: Levels that a block of nodes makes in one round; a block has FAN ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree of subroots; trees of languages are named "" (NULL) or "=" and the language.
TOP = "/"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def width(n: int, level: int) -> int:
    """Nodes at a level of a tree with n leaves."""
    for _ in range(level):
        n = -(-n // FAN)
    return n


def number_leaves(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place ``idx`` (from 0) in the order of their tree
    and the tree's size ``n``. Ranges over (tree, order, a row number) split
    equal keys too; the places before a range come from one count a range."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [tree, *order, "_tie"]
    placed = materialize(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(tree)  # one row a range
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tree, "_range", F.sum("_n").over(own).alias("n"), (before - F.col("_first")).alias("_shift"))
    return placed.join(runs, [tree, "_range"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_tie", "_at", "_range", "_shift")


def _block(idx: Column) -> Column:
    return F.floor(idx / F.lit(FAN ** BLOCK_LEVELS)).cast("long")


def interior_nodes(level0: DataFrame, name: str) -> DataFrame:
    """All nodes above (tree, n, idx, digest): tree, n, level, idx, digest and
    ``top`` where a node is its tree's only one at that level."""
    spark = level0.sparkSession
    schema = "tree string, n long, level int, idx long, digest string, top boolean"
    most = level0.agg(F.max("n").alias("n")).first()["n"] or 0
    made, base, rows = [], 0, level0

    def up(base: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            tree, n, first = pdf["tree"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["idx"].iloc[0])
            nodes, here, out = pdf["digest"].tolist(), width(n, base), []
            for level in range(base + 1, base + BLOCK_LEVELS + 1):
                if here == 1:
                    break
                nodes = [digest("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
                here, first = -(-here // FAN), first // FAN
                out += [(tree, n, level, first + i, d, here == 1) for i, d in enumerate(nodes)]
            return pd.DataFrame(out, columns=["tree", "n", "level", "idx", "digest", "top"])
        return run

    while width(most, base) > 1:
        blocks = rows.withColumn("block", _block(F.col("idx"))).select("tree", "n", "idx", "digest", "block")
        found = materialize(blocks.groupBy("tree", "block").applyInPandas(up(base), schema), f"{name}-{base}")
        made.append(found)
        base += BLOCK_LEVELS
        rows = found.where((F.col("level") == base) & ~F.col("top"))
    out = spark.createDataFrame([], schema)
    for part in made:
        out = out.unionByName(part)
    return out


@dataclass
class Manifest:
    leaves: DataFrame  # columns of the rows, tree, idx, n, digest
    nodes: DataFrame   # tree, level, idx, digest: every node of every tree, leaves and the tree of subroots included
    trees: DataFrame   # tree, rank, n_trees, subroot, root


def build(rows: DataFrame, order: str, leaf: str = "leaf", tree: str = "tree") -> Manifest:
    """The manifest of rows that have a leaf digest and the name of a tree."""
    leaves = materialize(number_leaves(rows, tree, [order, leaf], "merkle-order").withColumnRenamed(leaf, "digest"), "merkle-leaves")
    inner = interior_nodes(leaves, "merkle-nodes")
    lone = leaves.where(F.col("n") == 1).select(tree, F.col("digest").alias("subroot"))
    subroots = inner.where("top").select(tree, F.col("digest").alias("subroot")).unionByName(lone).withColumn("group", F.lit(TOP))
    ranked = number_leaves(subroots, "group", [tree], "merkle-subroots")
    ranked = materialize(ranked.select(tree, "subroot", F.col("idx").alias("rank"), F.col("n").alias("n_trees")), "merkle-ranks")
    level0 = ranked.select(F.lit(TOP).alias("tree"), F.col("n_trees").alias("n"), F.col("rank").alias("idx"), F.col("subroot").alias("digest"))
    above = interior_nodes(level0, "merkle-top")
    root = above.where("top").select(F.col("digest").alias("root")).unionByName(
        ranked.where(F.col("n_trees") == 1).select(F.col("subroot").alias("root")))
    found = root.first()  # one row, none for an empty table
    trees = ranked.withColumn("root", F.lit(found["root"] if found else None).cast("string"))
    columns = ["tree", "level", "idx", "digest"]
    nodes = (leaves.withColumn("level", F.lit(0)).select(*columns).unionByName(inner.select(*columns))
             .unionByName(level0.withColumn("level", F.lit(0)).select(*columns)).unionByName(above.select(*columns)))
    return Manifest(leaves, nodes, trees)


def missing_coordinates(places: list[int], n: int) -> list[tuple[int, int]]:
    """The least set of (level, place) from which, with the leaves at
    ``places`` of a tree with n leaves, the subroot can be made."""
    have, level, out = sorted(set(places)), 0, []
    while n > 1:
        known, parents = set(have), sorted({i // FAN for i in have})
        out += [(level, i) for p in parents for i in range(p * FAN, min(n, p * FAN + FAN)) if i not in known]
        have, n, level = parents, -(-n // FAN), level + 1
    return out


class Octopus:
    """The nodes that some leaves share, made from these and the fetched ones."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.levels, self.n = [], n
        here, level = dict(leaves), 0
        while n > 1:
            parents = {i // FAN for i in here}
            here.update({i: d for (at, i), d in fetched.items() if at == level})
            self.levels.append({p: [here[i] for i in range(p * FAN, min(n, p * FAN + FAN))] for p in parents})
            here = {p: digest("".join(run)) for p, run in self.levels[-1].items()}
            n, level = -(-n // FAN), level + 1
        self.top = next(iter(here.values()))

    def siblings(self, place: int) -> str:
        """Digests beside the path of a leaf, level by level, left to right."""
        out = []
        for level in self.levels:
            run, at = level[place // FAN], place % FAN
            out += run[:at] + run[at + 1:]
            place //= FAN
        return "".join(out)

    def fold(self, place: int, leaf: str) -> str:
        """The top that a leaf in that place gives with the siblings there are."""
        for level in self.levels:
            run = level[place // FAN].copy()
            run[place % FAN] = leaf
            leaf = digest("".join(run))
            place //= FAN
        return leaf


def prove(leaves: DataFrame, manifest: Manifest, presented: str) -> DataFrame:
    """For every row of ``leaves`` (rows of ``manifest.leaves``, all or a part)
    its proof and the root that the digest in column ``presented`` folds to:
    key, leaf, presented, subroot, root, proof, folded_root. ``key`` is text."""
    known = leaves.select("key", "tree", "idx", "n", F.col("digest").alias("leaf"), F.col(presented).alias("presented"),
                          _block(F.col("idx")).alias("block")).join(manifest.trees, "tree")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, block = pdf["tree"].iloc[0], int(pdf["block"].iloc[0])
        rows = [(tree, block, tree, level, i) for level, i in missing_coordinates(pdf["idx"].tolist(), int(pdf["n"].iloc[0]))]
        rows += [(tree, block, TOP, level, i) for level, i in missing_coordinates([int(pdf["rank"].iloc[0])], int(pdf["n_trees"].iloc[0]))]
        return pd.DataFrame(rows, columns=["tree", "block", "of", "level", "idx"])

    asked = known.select("tree", "block", "idx", "n", "rank", "n_trees").groupBy("tree", "block").applyInPandas(
        ask, "tree string, block long, of string, level int, idx long")
    nodes = manifest.nodes.withColumnRenamed("tree", "of")
    fetched = asked.join(nodes, ["of", "level", "idx"]).select("tree", "block", "of", "level", "idx", "digest")

    def expand(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["key", "leaf", "presented", "subroot", "root", "proof", "folded_root"])
        given: dict[bool, dict] = {True: {}, False: {}}
        for of, level, i, d in zip(got["of"], got["level"], got["idx"], got["digest"]):
            given[of == TOP][(int(level), int(i))] = d
        first = own.iloc[0]
        rank = int(first["rank"])
        inside = Octopus(dict(zip(own["idx"].tolist(), own["leaf"])), given[False], int(first["n"]))
        above = Octopus({rank: inside.top}, given[True], int(first["n_trees"]))
        upper = above.siblings(rank)
        proofs, folded = [], []
        for place, leaf, shown in zip(own["idx"].tolist(), own["leaf"], own["presented"]):
            proofs.append(digest(inside.siblings(place) + upper))
            folded.append(above.top if shown == leaf else above.fold(rank, inside.fold(place, shown)))
        return pd.DataFrame({"key": own["key"], "leaf": own["leaf"], "presented": own["presented"], "subroot": own["subroot"],
                             "root": own["root"], "proof": proofs, "folded_root": folded})

    return known.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInPandas(
        expand, "key string, leaf string, presented string, subroot string, root string, proof string, folded_root string")


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def prove_documents(docs: DataFrame) -> DataFrame:
    """Proofs of all documents against tampered copies of them. Columns other
    than FIELDS are not read."""
    fields = [F.col(c) for c in FIELDS]
    changed = [tampered(F.col("doc_id"), F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    rows = materialize(docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
                                   leaf_digest(*fields).alias("leaf"), leaf_digest(*changed).alias("shown")), "merkle-rows")
    manifest = build(rows, "doc_id")
    leaves = manifest.leaves.withColumn("key", F.col("doc_id").cast("string"))
    out = prove(leaves, manifest, "shown")
    return out.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root",
                      F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove_documents(read_table(spark, sf_dir, "documents"))


# -------------------------------------------------------------------- SQL
def oracle_sql(levels: int = 8) -> str:
    """The trees level by level; a tree with one node stays as it is. Trees of
    up to FAN ** levels leaves."""
    def field(name: str, value: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    # DuckDB has no CRC-32: its table is made by the eight steps of the polynomial
    crc = """crc_table AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc_list AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
ids AS (SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, crc_list WHERE doc_id IS NOT NULL)"""
    lower = f"CASE WHEN hit THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    same = " || ".join(field(c, c) for c in FIELDS)
    other = " || ".join(field(c, f"({lower})" if c == "text" else c) for c in FIELDS)
    parts = [crc, f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({same}) AS leaf, sha256({other}) AS shown
  FROM documents LEFT JOIN ids USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY tree) AS n FROM leaves),
level_0 AS (SELECT tree, idx, n, leaf AS d FROM placed)"""]
    for k in range(levels):
        parts.append(f"""level_{k + 1} AS (SELECT tree, CASE WHEN n > 1 THEN idx // {FAN} ELSE idx END AS idx,
  (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY level_{k}.idx)) ELSE max(d) END AS d
  FROM level_{k} GROUP BY tree, CASE WHEN n > 1 THEN idx // {FAN} ELSE idx END)""")
    parts.append(f"""top_0 AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, d FROM level_{levels})""")
    for k in range(3):
        parts.append(f"""top_{k + 1} AS (SELECT CASE WHEN n > 1 THEN idx // {FAN} ELSE idx END AS idx, (max(n) + {FAN - 1}) // {FAN} AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY top_{k}.idx)) ELSE max(d) END AS d
  FROM top_{k} GROUP BY CASE WHEN n > 1 THEN idx // {FAN} ELSE idx END)""")
    # what stands left and right of a node in its run
    steps = [(f"level_{k}", "tree, ", "PARTITION BY tree, ") for k in range(levels)] + [(f"top_{k}", "", "PARTITION BY ") for k in range(3)]
    for t, keys, by in steps:
        window = f"OVER ({by}CASE WHEN n > 1 THEN idx // {FAN} ELSE idx END ORDER BY idx ROWS BETWEEN"
        parts.append(f"""side_{t} AS (SELECT {keys}idx, coalesce(string_agg(d, '') {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, n > 1 AS more FROM {t})""")
    parts.append("walk_0 AS (SELECT doc_id, tree, leaf, idx AS at, '' AS proof, shown AS fold FROM placed)")
    last = "walk_0"
    for i, (t, keys, _) in enumerate(steps):
        if t == "top_0":
            parts.append("walk_t AS (SELECT w.doc_id, w.tree, w.leaf, t.idx AS at, w.proof, w.fold, t.d AS subroot FROM "
                         f"{last} w JOIN top_0 t USING (tree))")
            last = "walk_t"
        extra = "w.subroot, " if t.startswith("top") else ""
        on = "w.tree = s.tree AND w.at = s.idx" if keys else "w.at = s.idx"
        parts.append(f"""walk_{i + 1} AS (SELECT w.doc_id, w.tree, w.leaf, {extra}CASE WHEN more THEN w.at // {FAN} ELSE w.at END AS at,
  w.proof || l || r AS proof, CASE WHEN more THEN sha256(l || w.fold || r) ELSE w.fold END AS fold
  FROM {last} w JOIN side_{t} s ON {on})""")
        last = f"walk_{i + 1}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified
FROM {last}, top_3"""


ORACLE = oracle_sql()
