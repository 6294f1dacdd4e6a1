"""Corpus pipeline: from ``documents`` to packed token sequences.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents; each works on all rows
that its predecessor kept, and rows it rejects are gone for those after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm import decontaminate, jaccard_join, langid, packing, toxicity
from tabaudit.llm.common import materialize, read_table
from tabaudit.session import ship_package

#: A document whose most likely language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; those without letters, or between
    languages, go."""
    ship_package(spark)
    model = langid.fit(langid.learning_rows(docs))
    scored = langid.predict(docs, model, lang_col="_lang_pred", score_col="_lang_score")
    kept = scored.where((F.col("_lang_pred") != langid.UNDETERMINED) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are predicted not toxic."""
    ship_package(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col="_toxic_score", hits_col="_toxic_matches")
    return scored.where(F.col("_toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every component of similar documents: the one with
    the smallest doc_id (NULL after all others), then the smallest hash of id
    and text, so that of different texts that repeat an id each component keeps
    its own. Documents without words are linked with nothing and stay; of rows
    that repeat an id and its text one stays."""
    ship_package(spark)
    # a hash of id and text names a row; rows that repeat both are one
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))))
    sets = materialize(jaccard_join.set_table(docs, "doc_id", "text", key=key), "stage-sets")
    classes = jaccard_join.similarity_classes(docs, sets)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    of_set = sets.where(F.col("sig").isNotNull()).groupBy("sig").agg(first)
    of_class = of_set.join(classes.select("sig", "class"), "sig").groupBy("class").agg(F.min("first").alias("first"))
    wordless = sets.where(F.col("sig").isNull()).select(F.col("key").alias("_keep_key"), F.col("doc_id").isNull().alias("_keep_each")).distinct()
    keep = of_class.select(F.col("first.key").alias("_keep_key"), F.lit(False).alias("_keep_each")).unionByName(wordless)
    keep = materialize(keep, "stage-keep")
    # documents with neither id nor words are not known to be the same: each is a row of its own
    named = docs.withColumn("_keep_row", F.monotonically_increasing_id()).withColumn("_keep_name", key)
    kept = named.join(keep, F.col("_keep_name") == F.col("_keep_key")).withColumn("_keep_row", F.when(F.col("_keep_each"), F.col("_keep_row")))
    return kept.dropDuplicates(["_keep_name", "_keep_row"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark window occurs."""
    ship_package(spark)
    _, found = decontaminate.find_windows(docs, read_table(spark, sf_dir, "benchmark"))
    hit = materialize(found.select("text_key").distinct(), "stage-hit")
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(hit, key == hit["text_key"], "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; one row a piece."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language ID, toxicity and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
