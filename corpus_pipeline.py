"""Corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from rosterlake.llm.common import shielded, stored, table
from rosterlake.llm.queries import tokenizer_path


def _changed(docs: DataFrame, work: Callable[[DataFrame], DataFrame], text: str) -> DataFrame:
    """The columns of ``docs`` after ``work``, with its column ``text`` as the new
    text and n_chars following it; other columns are out of its reach."""
    inner, restore = shielded(docs, "doc_id", "text", "n_chars")
    out = work(inner)
    if text != "text":
        out = out.drop("text").withColumnRenamed(text, "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go."""
    return _changed(docs, lambda d: quality_rules.quality_columns(d).filter("kept"), "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters and more in three documents and more stay in the last only."""
    return _changed(docs, line_dedup.dedup_lines, "kept_text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest doc_id stays."""
    groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = groups.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents that are mostly benchmark go whole."""
    return _changed(docs, lambda d: decontaminate.remove_contamination(d, table(spark, sf_dir, "benchmark")), "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of their decoded text."""
    encoded = bpe.encode_documents(docs, tokenizer_path())
    return bpe.digests(encoded).drop("text", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("line dedup", lines), ("near copies", near_copies),
    ("benchmark decontamination", benchmark), ("bpe", tokens)]

# SQL can't express the merges of the last stage: tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
