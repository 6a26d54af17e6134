"""Documents to packed training sequences: language, repeated lines, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table, wide_hash, written
from sightline.llm.decontamination import decontaminate
from sightline.llm.jaccard_join import jaccard_join
from sightline.llm.language import fit, predict_language
from sightline.llm.line_dedup import OVER_WORDS, dedup_lines
from sightline.llm.packing import pack_documents

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, texts without letters and texts of no language go."""
    columns = docs.columns
    found = predict_language(docs.withColumnRenamed("score", "_score"), fit(docs)) if "score" in columns else predict_language(docs, fit(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines go; a document of which nothing is left goes too. n_chars follows the text."""
    kept = dedup_lines(docs, OVER_WORDS).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (null ids come first).

    A document is known by its doc_id and text together, so documents without doc_id take part, and those that share one
    are told apart; of rows that agree in both one stays.
    """
    key = F.struct("doc_id", *(h.alias(a) for h, a in zip(wide_hash(F.col("text")), ("h1", "h2"))))
    groups = jaccard_join(docs.select(key.alias("doc_id"), "text"))
    kept = written(groups.filter("doc_id = class_id").groupBy(F.col("doc_id").alias("_near_duplicates_key")).agg(F.count(F.lit(1)).alias("_near_duplicates_times")), "kept")
    keyed = docs.withColumn("_near_duplicates_key", key)
    rows = keyed.join(kept.filter("_near_duplicates_times = 1"), "_near_duplicates_key", "left_semi")
    if not kept.filter("_near_duplicates_times > 1").isEmpty():
        rows = rows.unionByName(keyed.join(kept.filter("_near_duplicates_times > 1"), "_near_duplicates_key", "left_semi").dropDuplicates(["_near_duplicates_key"]))
    return rows.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 1024 tokens."""
    return pack_documents(docs, keep_ids=False).drop("ids")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: None: language models, content-defined chunks and similarity joins aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
