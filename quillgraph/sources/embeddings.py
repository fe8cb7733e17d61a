"""Embeddings: what gives vectors, and a cache of them as a Parquet table keyed by the texts' md5.

A provider is any object with ``encode(texts)``, one vector for each text. It
runs in the tasks, a batch of texts at a time, three attempts each, waiting
longer after each failure. Null texts have no vector; equal texts are encoded
once; an empty table gives an empty result.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Texts of a call of the provider, attempts, and seconds that each failure adds to the wait.
BATCH, ATTEMPTS, WAIT = 100, 3, 1.0


class Provider(Protocol):
    def encode(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


class HashedProvider:
    """Vectors from hashed three-letter runs: deterministic, offline, alike for alike spellings; for tests and as a default."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            padded = f" {text.lower()} "
            for i in range(len(padded) - 2):
                h = zlib.crc32(padded[i : i + 3].encode("utf-8", "replace"))
                row[h % self.width] += 1 if h >> 16 & 1 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


class FixedProvider:
    """Vectors of given texts (by lower case and single blanks), zero for all others."""

    def __init__(self, known: dict[str, Sequence[float]]):
        self.known = {" ".join(t.lower().split()): list(map(float, v)) for t, v in known.items()}
        self.width = max((len(v) for v in self.known.values()), default=1)

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [self.known.get(" ".join(t.lower().split()), [0.0] * self.width) for t in texts]


def encoded(provider: Provider, texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT) -> list[list[float]]:
    """The provider's vectors; raises the last failure."""
    for attempt in range(1, attempts + 1):
        try:
            return [[float(x) for x in v] for v in provider.encode(texts)]
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(wait * attempt)
    return []


def _fresh(texts: DataFrame, provider: Provider, batch: int, wait: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame["text"].iloc[lo : lo + batch].tolist()
                yield pd.DataFrame({"text": part, "embedding": encoded(provider, part, wait=wait)})

    return texts.mapInPandas(run, "text string, embedding array<double>")


def _exists(spark, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def embed(texts: DataFrame, provider: Provider, cache: str | None = None, batch: int = BATCH, wait: float = WAIT) -> DataFrame:
    """``text, embedding`` of the distinct texts of a one-column frame; with ``cache`` known ones are read from there and new ones added."""
    spark = texts.sparkSession
    one = texts.select(texts[0].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    if cache is None:
        return cut(_fresh(one, provider, batch, wait))
    keyed = cut(one.withColumn("key", F.md5("text")))
    known = spark.read.parquet(cache).select("key", "embedding") if _exists(spark, cache) else None
    missing = keyed if known is None else keyed.join(known, "key", "left_anti")
    fresh = cut(_fresh(missing.select("text"), provider, batch, wait))
    fresh.select(F.md5("text").alias("key"), "text", "embedding", F.current_timestamp().alias("made_at")).write.mode("append").parquet(cache)
    if known is None:
        return fresh
    return fresh.unionByName(keyed.join(known.dropDuplicates(["key"]), "key").select("text", "embedding"))


def cache_statistics(spark, cache: str) -> DataFrame:
    """One row: vectors, their bytes and width, when the first and the last were made."""
    if not _exists(spark, cache):
        return spark.createDataFrame([(0, 0, None, None, None)], "vectors bigint, bytes bigint, width int, first timestamp, last timestamp")
    table = spark.read.parquet(cache)
    return table.agg(F.countDistinct("key").alias("vectors"), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0)).cast("bigint").alias("bytes"), F.max(F.size("embedding")).alias("width"), F.min("made_at").alias("first"), F.max("made_at").alias("last"))


def clear_cache(spark, cache: str) -> None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def embed_concepts(concepts: DataFrame, provider: Provider, cache: str | None = None) -> DataFrame:
    """``concept_id, embedding`` by the concepts' texts."""
    made = embed(concepts.select("concept_text"), provider, cache)
    return concepts.join(made, concepts["concept_text"] == made["text"]).select("concept_id", "embedding")


def embed_passages(passages: DataFrame, provider: Provider, cache: str | None = None) -> DataFrame:
    """``passages`` with their ``embedding``."""
    made = embed(passages.select("content"), provider, cache)
    return passages.join(made.withColumnRenamed("text", "content"), "content")


def pair_similarity(a: str, b: str, vectors: DataFrame) -> float | None:
    """Cosine of two texts of ``vectors(text, embedding)``; None if one is missing."""
    from ..functions.text import cosine

    x, y = (vectors.where(F.col("text") == t).select(F.col("embedding").alias(n)).limit(1) for t, n in ((a, "x"), (b, "y")))
    row = x.crossJoin(y).select(cosine(F.col("x"), F.col("y"))).first()
    return row[0] if row else None
