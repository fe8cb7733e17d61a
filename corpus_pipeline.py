"""Corpus pipeline: each stage works on all documents that its predecessor kept.

Defined results, for every stage: columns other than ``doc_id``, ``text``,
``lang`` and ``n_chars`` are carried along, whatever they are called; repeated
rows are judged alike, each for itself; very long texts are read whole; an
empty table gives an empty one, with the same columns. What a null or an empty
text or a tie gives is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontam, langid, neardup, packing, secretscan
from quillgraph.session import shared_dir, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (string-kernel classification).

    Null, empty and letterless texts go; a null id stays; a null ``lang`` rejects nothing; of equal scores the language that sorts first counts.
    """
    return langid.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id (signature-coordinate join).

    Null ids, null and empty texts and texts without a token have no copy and stay; a repeated id is one document, whose rows stay or go together.
    """
    return neardup.drop_near(docs)


def quoted_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no benchmark item (BM25 and block-max WAND).

    Null and empty texts quote nothing and stay; null and empty items are quoted by none.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark (random forest); ``n_chars``, if there, follows the text. Null and empty texts stay as they are."""
    return secretscan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the remaining documents' pieces (hierarchical best fit).

    Null texts are not packed, an empty one is one end mark; pieces of equal length are taken by id and start.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("near copies", near_copies),
    ("decontamination", quoted_benchmark),
    ("secrets", secrets),
    ("packing", packed),
]

#: The stages hold trained models and text kernels that SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder and read again by the next.

    The folder goes with :func:`quillgraph.session.drop_written`.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    written(base)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
