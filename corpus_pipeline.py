"""A corpus from documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, ngram_join, packing, pii, quality
from quern.llm.queries import vocabulary_path
from quern.sources import parquet_table
from quern.storage import new_folder, remove, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labelled ones of ``docs``."""
    return quality.keep(docs, quality.fit(docs, parquet_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: one with the smallest doc_id, null last. Rows without words all stay; ids may be repeated."""
    return ngram_join.drop_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item, each judged by its own text: ids may be null or repeated, and null or empty texts stay."""
    return decontaminate.clean(docs, parquet_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data generalised or removed; null texts stay null."""
    return pii.clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens; null or empty text is the end id alone, repeated rows are packed once each."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written as Parquet and read again, and what it was made from is removed."""
    docs, before = parquet_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
