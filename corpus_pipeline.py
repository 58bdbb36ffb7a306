"""A training-data pipeline of five operators, each stage written as Parquet and read back.

Every stage works on all the rows its predecessor kept. ORACLE_SQL is None: scores of boosted trees
and token ids cannot be had from SQL; tests compare the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import bpe, decontaminate, jaccard, lines, toxicity
from inkprint.llm.common import narrow_batches, stored
from inkprint.session import work_folder

ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; ids with several rows go if one of them is rejected."""
    narrow_batches(spark)
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = stored(scored.filter("predicted = 1").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines and passages of over 50 words go.

    A document of which nothing is left goes too, n_chars follows the text.
    """
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    kept = lines.dedup(docs, keep=("lang", "source", "n_chars")).filter("n_removed = 0 OR n_removed < n_lines")
    return kept.select("doc_id", "text", "lang", "source", n_chars)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 80 per cent) the document with the smallest id stays.

    Texts without words are near nothing and stay; so do rows without an id.
    """
    narrow_batches(spark)
    joined = jaccard.join(docs, size=5, percent=80)
    copies = stored(joined.filter("component_id != doc_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = stored(found.select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them."""
    narrow_batches(spark)
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmarks),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        path = work_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
