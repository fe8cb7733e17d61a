"""Incremental indexing: of a stream of passages, and of files by their signatures.

What is kept is unfiltered: the mention rows of every passage. Which concepts
are in the frequency band changes with every batch, so the graph is derived
from the mentions when it is asked for. The signatures of what is indexed are
a table of their own, so a batch reads no mentions. Null contents are left
out; a passage that was indexed before, in whatever batch, is skipped; a batch
that is run again replaces its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph as G
from ..session import cut
from ..sources import documents as D


def index_batch(batch: DataFrame, number: int, path: str) -> None:
    """Add the new passages of ``batch(passage_id, content[, chunk_index])`` to the tables below ``path``."""
    spark = batch.sparkSession
    new = batch.where("content IS NOT NULL").withColumn("signature", F.md5("content")).dropDuplicates(["signature"])
    if "chunk_index" not in new.columns:
        new = new.withColumn("chunk_index", F.lit(None).cast("bigint"))
    if G._there(spark, f"{path}/signatures"):
        old = spark.read.parquet(f"{path}/signatures").where(F.col("batch") < number).select("signature")
        new = new.join(old, "signature", "left_anti")
    new = cut(new.select("signature", "passage_id", "content", F.coalesce("chunk_index", F.lit(0)).cast("bigint").alias("chunk_index")))
    G.mentions(new).select("passage_id", "chunk_index", "kind_rank", "surface", "concept_id").write.mode("overwrite").parquet(f"{path}/mentions/batch={number}")
    new.drop("signature").write.mode("overwrite").parquet(f"{path}/passages/batch={number}")
    new.select("signature").write.mode("overwrite").parquet(f"{path}/signatures/batch={number}")


def index_stream(passages: DataFrame, path: str, checkpoint: str):
    """A writer that indexes a streaming ``passage_id, content[, chunk_index]`` batch by batch."""
    return passages.writeStream.foreachBatch(lambda batch, number: index_batch(batch, number, path)).option("checkpointLocation", checkpoint)


def graph(spark: SparkSession, path: str, min_freq: int = 2, max_ratio: float = 0.5) -> G.Graph:
    """The graph of all that is indexed, as :func:`quillgraph.operators.graph.build` makes it."""
    passages = spark.read.parquet(f"{path}/passages").drop("batch")
    return G.from_mentions(passages, spark.read.parquet(f"{path}/mentions").drop("batch"), min_freq, max_ratio)


def index_files(spark: SparkSession, paths: str | list[str], path: str, size: int = 1200, overlap: int = 150, extensions: tuple[str, ...] = D.EXTENSIONS) -> int:
    """Index the files that aren't in the manifest yet; how many were new.

    The manifest at ``path/manifest`` has a row for each file: signature, name,
    size, sha256, how it was cut, its number of chunks and their range among
    all, and when it was indexed. Chunks are numbered on in the order of the
    files' sources.
    """
    found = D.files(spark, paths, extensions).withColumn("signature", D.signature(size, overlap))
    known = spark.read.parquet(f"{path}/manifest") if G._there(spark, f"{path}/manifest") else None
    start, number = 0, 0
    if known is not None:
        start, number = known.agg(F.coalesce(F.max("last_chunk") + 1, F.lit(0)), F.coalesce(F.max("batch") + 1, F.lit(0))).first()
        found = found.join(known.select("signature"), "signature", "left_anti")
    found = cut(found.dropDuplicates(["signature"]))
    chunks = cut(D.chunk_files(found, size, overlap))
    each = [(r.source, r.n) for r in chunks.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()]  # one row for each file
    if not each:
        return 0
    ranges, at = [], int(start)
    for source, n in each:
        ranges.append((source, n, at, at + n - 1))
        at += n
    table = spark.createDataFrame(ranges, "source string, num_chunks bigint, first_chunk bigint, last_chunk bigint")
    numbered = chunks.join(F.broadcast(table), "source").withColumn("i", F.col("first_chunk") + F.col("chunk_index"))
    index_batch(numbered.select(F.concat(F.lit("passage_"), F.col("i").cast("string")).alias("passage_id"), "content", F.col("i").alias("chunk_index")), int(number), path)
    rows = found.join(F.broadcast(table), "source").select(
        "signature", "source", F.col("file_name").alias("name"), "size", F.sha2("data", 256).alias("sha256"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), "num_chunks", "first_chunk", "last_chunk", F.current_timestamp().alias("indexed_at"), F.lit(int(number)).alias("batch")
    )
    rows.write.mode("append").parquet(f"{path}/manifest")
    return len(each)
