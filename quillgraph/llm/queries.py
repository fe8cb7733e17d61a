"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, table
from . import decontam, fingerprints, hashtree, langid, neardup, packing, pii, quality, secretscan, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a copy or near copy by verified Jaccard, with its group and number of links."""
    return fingerprints.near(table(spark, sf_dir, "documents"))


@query("op9_weighted_hash_tree", hashtree.sql("documents", "doc_id"))
def op9_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, rack and shard of every document."""
    return hashtree.place(table(spark, sf_dir, "documents").select("doc_id"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised, with language and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.accept(docs, carry=["doc_id", "lang"])


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that quotes a benchmark item, with score and overlaps."""
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents, with the pieces in each."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every document, with its span and score."""
    return secretscan.findings(table(spark, sf_dir, "documents"))


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a near copy, with its group, class and number of links."""
    return neardup.near(table(spark, sf_dir, "documents"))


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data of every document, with its span and kind."""
    return pii.entities(table(spark, sf_dir, "documents"))


@query("op3_quality_kneser_ney")
def op3_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose perplexity is within their language's threshold."""
    return quality.keep(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_warc_writer")
def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every page is in the WARC files written from them."""
    return warc.write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")
