"""The registered queries of the subpackage and the corpus pipeline."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oracles.compare import compare

NAMES = [n for n in contract.queries() if n.startswith("op")]


def test_each_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


@pytest.mark.parametrize("name", [n for n in NAMES if n in contract.oracle_sql()])
def test_statement(spark, sf_dir, duck, name):
    assert compare(contract.queries()[name](spark, sf_dir), duck, contract.oracle_sql()[name]) is None


# what tells the rows of a query apart where they are not one per document or page
KEYS = {
    "op1_benchmark_decontamination": ("doc_id", "item_id"), "op11_best_fit_packing": ("doc_id", "piece"),
    "op12_hard_negatives": ("anchor_id", "positive_id", "rank"), "op13_conversation_trie": ("conv_id", "depth"),
}


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, sf_dir, name):
    rows = contract.queries()[name](spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/{'pages' if 'page_id' in rows.columns else 'documents'}.parquet")
    if name in KEYS:
        assert 0 < rows.count() == rows.select(*KEYS[name]).distinct().count()
    else:
        assert rows.count() == source.count()


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, previous, sf_dir).collect(), docs.schema)
        assert kept.columns == docs.columns and kept.count() <= previous.count(), name
        assert kept.join(previous.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name != "line dedup":
            assert kept.join(previous.select("doc_id", F.col("text").alias("before")), "doc_id").filter("NOT text <=> before").isEmpty()
        previous = kept
    last = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.STAGES[-1][1](spark, previous, sf_dir).collect()}
    assert last == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in previous.collect()}


def test_awkward_rows_pass_through(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", None, None, 5), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(tuple, stage(spark, docs, sf_dir).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
