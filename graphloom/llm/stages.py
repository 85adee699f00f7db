"""The stages of corpus_pipeline.py: (name, function of spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.dist import ship
from graphloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_classifier
from graphloom.llm.common import free, settled, small_batches, spare, table
from graphloom.llm.word_ids import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels of these documents, doesn't reject."""
    ship(spark)
    small_batches(spark)
    scored = quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    kept = dict(zip(docs.columns, spare(docs, "score", "predicted").columns, strict=True))
    return scored.filter("predicted = 1").select(*(F.col(b).alias(a) for a, b in kept.items()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    ship(spark)
    small_batches(spark)
    kept = dict(zip(docs.columns, spare(docs, "lines").columns, strict=True))
    done = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*(F.col(b).alias(a) for a, b in kept.items()))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_id replaced by a 64-bit hash of doc_id and text: rows are judged by what they hold, so rows that
    share a doc_id, or have none, are told apart. Only doc_id and text stay."""
    return docs.select(_row_key().alias("doc_id"), "text")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    (row,) = free(docs, "row")
    return docs.join(keys.select(F.col("doc_id").alias(row)), _row_key() == F.col(row), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their 5-word n-grams one stays, the least by a hash of doc_id and
    text; of repeated rows (same doc_id and text) any one. Documents without a word all stay. A row whose doc_id is null
    or another row's too is judged by its own text."""
    ship(spark)
    small_batches(spark)

    def verdicts() -> DataFrame:
        found = ngram_join.similar(_keyed(docs), words=5, threshold=80).filter("n_shingles > 0")
        return found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 or doc_id <> component_id")

    rows = settled(verdicts)
    once = _without(docs, rows)
    repeated = rows.filter("rows > 1 and doc_id = component_id")
    if repeated.isEmpty():
        return once
    return once.unionByName(_without(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each judged by its own text as above."""
    ship(spark)
    small_batches(spark)
    return _without(docs, settled(lambda: decontaminate.leaks(_keyed(docs), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left, a row for each piece."""
    ship(spark)
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("packing", pack)]
