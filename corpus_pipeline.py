"""From raw documents to batches for training: five stages, each from a table of documents to the next one.

What all stages do: a null text is an empty one, which has no toxic words, little quality, no shingles, no secrets and no tokens;
texts of any length are judged whole; rows that are there twice are judged alike; an empty table gives an empty one; extra
columns, whatever their names, but without dots in them, are handed on by all stages but the last. Rows with null ids have no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import columns, cut, fold, free_names, labelled_rows, release, table
from vecloom.llm.ngram_join import drop_similar
from vecloom.llm.packing import pack, token_lengths
from vecloom.llm.quality import document_statistics, fit_quality, score_texts
from vecloom.llm.secret_scan import find_secrets, redacted
from vecloom.llm.toxicity import fit_toxicity, score_toxicity

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """Documents are long, so Arrow batches of the usual 10,000 rows would take much memory beside Spark's own.

    The setting holds for the session until run() ends, as stages' results are computed after they return.
    """
    spark.conf.set(BATCH_ROWS, "2000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from labels outside the held-out fold.

    Null and empty texts get the model's base score, which is below 0.5 unless most labelled texts are toxic. Equal texts, so
    repeated rows too, stay or go together. Without labels of both classes all scores are the share of toxic ones.
    """
    _short_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    score = free_names(docs.columns, "__toxicity")[0]
    return score_toxicity(docs, model, keep=docs.columns, score=score).where(F.col(score) < 0.5).select(*columns(docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; the model learns from labels outside the held-out fold.

    Null, empty and blank texts have statistics of zeros and the score that the model gives these. Equal texts stay or go
    together. Without labels of both classes all scores are the share of good ones, 1 without any.
    """
    _short_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    labelled = labelled_rows(docs, labels, "quality", "text", "doc_id", 60_000).select(F.col("key").alias("doc_id"), "text")
    model = fit_quality(document_statistics(labelled), labels)
    score = free_names(docs.columns, "__quality")[0]
    return score_texts(docs, model, keep=docs.columns, score=score).where(F.col(score) >= 0.7).select(*columns(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 or more on 5-word shingles join: the first by doc_id, null last.

    Documents without words link with nothing and stay, all of them. Of repeated rows, and of equal texts, one stays.
    """
    _short_batches(spark)
    return drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows where the text changed.

    Secrets that overlap get one mark. Null and empty texts stay as they are; repeated rows stay repeated.
    """
    spans = free_names(docs.columns, "__found")[0]
    found = find_secrets(docs, keep=docs.columns, out=spans).withColumn("text", redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*columns(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_tokens, batch and place of every document.

    Null and empty texts have 0 tokens and are packed too, as are null ids and repeated rows, one by one; a text of more
    tokens than the budget is a batch of its own.
    """
    _short_batches(spark)
    return pack(token_lengths(docs))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL expresses neither the trained classifiers nor the token counts; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last into the checkpoint folder before the next."""
    usual = spark.conf.get(BATCH_ROWS)
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = cut(docs)
                release(spark)
        return docs
    finally:
        spark.conf.set(BATCH_ROWS, usual)
