"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, hnsw, licenses, ngram_join, oracles, packing, pii, quality, sharding, toxicity, warc
from quern.sources import parquet_table


def vocabulary_path(name: str = "word_bpe_49k.json", package: str = "public_tokenizers", folder: str = "/opt/tokenizers") -> str:
    """Where the public tokenizer file ``name`` is; folder: that of the package, used where it is not on the path."""
    try:
        found = __import__(package)
    except ImportError:
        sys.path.append(str(Path(folder).resolve().parent))
        found = __import__(package)
    return found.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(parquet_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, parquet_table(spark, sf_dir, "labels")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(parquet_table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet_table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build(rows), rows.filter("vec_id % 20 = 0"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parquet_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, parquet_table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(parquet_table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own; here it is source, language, and the id in groups of 512."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 512).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(parquet_table(spark, sf_dir, "documents"), path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(parquet_table(spark, sf_dir, "pages")).drop("url", "payload")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(parquet_table(spark, sf_dir, "documents"), parquet_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_toxicity, op3_ngram_join, op4_nearest, op5_packing, op6_quality, op7_pii, op8_licences, op9_warc, op10_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": oracles.OP3, "op8_licences": oracles.OP8, "op9_warc": oracles.OP9, "op10_decontamination": oracles.OP10}
