"""Extraction cache: entities and concepts of passages, a Parquet table keyed by the md5 of the content.

Every extraction is kept, whatever made it. A passage that is there already
isn't extracted again; one whose extraction failed has its error in ``error``
and no entities, and is tried again next time. Null contents are left out;
equal contents are extracted once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import cut
from .embeddings import _exists, clear_cache as clear

Extractor = Callable[[str], tuple[list[str], list[str]]]
SCHEMA = "passage_hash string, content string, entities array<string>, concepts array<string>, document_metadata map<string,string>, passage_metadata map<string,string>, model_used string, processing_time double, api_cost_estimate double, error string, timestamp timestamp"
#: Tokens of a word, share of a request's tokens that are input, and dollars for a thousand of either.
TOKENS_A_WORD, INPUT_SHARE, DOLLARS = 1.3, 0.6, {"none": (0.0, 0.0), "small": (0.00005, 0.0004)}


def cost(words, prices: tuple[float, float] = DOLLARS["none"], share: float = INPUT_SHARE):
    """Dollars for so many words (a number or a column)."""
    tokens = words * TOKENS_A_WORD
    return tokens * share / 1000 * prices[0] + tokens * (1 - share) / 1000 * prices[1]


def _metadata(df: DataFrame, name: str):
    return F.col(name).cast("map<string,string>") if name in df.columns else F.create_map().cast("map<string,string>")


def split(passages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """``passages(content, ...)`` with ``passage_hash``: those that the cache has, and the others, each content once."""
    spark = passages.sparkSession
    keyed = passages.where("content IS NOT NULL").withColumn("passage_hash", F.md5("content"))
    if not _exists(spark, path):
        return keyed.limit(0), keyed.dropDuplicates(["passage_hash"])
    held = spark.read.schema(SCHEMA).parquet(path).where("error IS NULL").select("passage_hash").distinct()
    return keyed.join(held, "passage_hash", "left_semi"), keyed.join(held, "passage_hash", "left_anti").dropDuplicates(["passage_hash"])


def extract(passages: DataFrame, path: str | None = None, extractor: Extractor | None = None, model: str = "patterns", prices: tuple[float, float] = DOLLARS["none"]) -> DataFrame:
    """Rows of the cache's schema for each distinct content of ``passages(content[, document_metadata, passage_metadata])``.

    Without an ``extractor`` the patterns of :mod:`quillgraph.functions.text`
    are used; a failing one leaves its error, and the patterns' finds.
    """
    spark = passages.sparkSession
    missing = split(passages, path)[1] if path else passages.where("content IS NOT NULL").withColumn("passage_hash", F.md5("content")).dropDuplicates(["passage_hash"])
    base = missing.select("passage_hash", "content", T.entities(F.col("content")).alias("entities"), T.concepts(F.col("content")).alias("concepts"), _metadata(missing, "document_metadata").alias("document_metadata"), _metadata(missing, "passage_metadata").alias("passage_metadata"))
    words = F.size(T.words(F.col("content")))
    if extractor is None:
        made = base.select("*", F.lit(model).alias("model_used"), F.lit(0.0).alias("processing_time"), F.lit(None).cast("string").alias("error"))
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for text in frame["content"]:
                    began, entities, concepts, error = time.time(), None, None, None
                    try:
                        entities, concepts = extractor(text)
                    except Exception as e:  # kept with the row
                        error = f"{type(e).__name__}: {e}"
                    out.append((entities, concepts, time.time() - began, error))
                yield frame[["passage_hash"]].assign(**{c: [r[k] for r in out] for k, c in enumerate(("e", "c", "processing_time", "error"))})

        told = cut(base.select("passage_hash", "content").mapInPandas(run, "passage_hash string, e array<string>, c array<string>, processing_time double, error string"))
        made = base.join(told, "passage_hash").select(
            "passage_hash", "content", F.coalesce("e", "entities").alias("entities"), F.coalesce("c", "concepts").alias("concepts"), "document_metadata", "passage_metadata",
            F.when(F.col("error").isNull(), model).otherwise("patterns").alias("model_used"), "processing_time", "error",
        )
    made = made.withColumns({"api_cost_estimate": cost(words, prices) if extractor is not None else F.lit(0.0), "timestamp": F.current_timestamp()})
    fresh = cut(made.select(*[c.split()[0] for c in SCHEMA.split(", ")]))
    if path is None:
        return fresh
    fresh.write.mode("append").parquet(path)
    wanted = passages.where("content IS NOT NULL").select(F.md5("content").alias("passage_hash")).distinct()
    latest = spark.read.schema(SCHEMA).parquet(path).join(wanted, "passage_hash", "left_semi")
    good = F.max_by(F.struct("*"), F.struct(F.col("error").isNull(), "timestamp")).alias("r")
    return latest.groupBy(F.col("passage_hash").alias("__h")).agg(good).select("r.*")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The whole cache; an empty table if there is none."""
    return spark.read.schema(SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SCHEMA)


def summary(cached: DataFrame) -> DataFrame:
    """One row: documents, passages, distinct entities and concepts."""
    doc = F.coalesce(F.col("document_metadata")["document_id"], F.col("document_metadata")["source"])
    distinct = lambda c: cached.select(F.explode(c).alias("x")).agg(F.countDistinct("x").alias(f"unique_{c}"))
    return cached.agg(F.countDistinct(doc).alias("documents"), F.countDistinct("passage_hash").alias("passages")).crossJoin(distinct("entities")).crossJoin(distinct("concepts"))


def progress(cached: DataFrame, total: int) -> DataFrame:
    """One row: passages done, failed and left of ``total``, mean seconds, what it cost, and seconds to go."""
    done = cached.agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("processed"), F.count("error").alias("failed"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("avg_seconds"), F.coalesce(F.sum("api_cost_estimate"), F.lit(0.0)).alias("total_cost"),
    )
    left = F.greatest(F.lit(total) - F.col("processed"), F.lit(0))
    share = F.when(F.lit(total) > 0, F.least(F.lit(100.0), 100 * F.col("processed") / total)).otherwise(0.0)
    return done.select("*", left.alias("remaining"), share.alias("percent"), (left * F.col("avg_seconds")).alias("seconds_left"))


def document_passages(cached: DataFrame, document_id: str) -> DataFrame:
    """The passages of a document (its id, or else its source), by chunk index, 0 where there is none."""
    doc = F.coalesce(F.col("document_metadata")["document_id"], F.col("document_metadata")["source"])
    return cached.where(doc == document_id).orderBy(F.coalesce(F.expr("try_cast(passage_metadata['chunk_index'] AS bigint)"), F.lit(0)), "passage_hash")


def document_registry(cached: DataFrame) -> DataFrame:
    """``document_id, metadata``: the first metadata that was seen for each document."""
    doc = F.coalesce(F.col("document_metadata")["document_id"], F.col("document_metadata")["source"]).alias("document_id")
    return cached.groupBy(doc).agg(F.min_by("document_metadata", F.struct("timestamp", "passage_hash")).alias("metadata")).where("document_id IS NOT NULL")


def export(cached: DataFrame, path: str, content: bool = True) -> None:
    """JSON lines of the extractions, without their contents if not ``content``."""
    (cached if content else cached.drop("content")).write.json(path)


__all__ = ["clear", "cost", "document_passages", "document_registry", "export", "extract", "load", "progress", "split", "summary"]
