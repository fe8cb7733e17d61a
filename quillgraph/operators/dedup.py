"""Entity deduplication: candidate pairs, three phases, clusters, canonical concepts.

Nulls and blank texts have no pair; repeated rows count once; pairs come once, with the
smaller text or id first; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import PART_ROWS, cut, parted
from . import vectors as V
from .components import connected_components
from .contain import contained


def _share_letters(one: DataFrame, least: float) -> DataFrame:
    """``a, b`` of texts that may share ``least`` of the longer one's characters.

    Two texts that do have lengths in that ratio, and meet in one of the
    rarest letters of either: of n distinct letters of a text of length L all
    but the last ceil(least L) - 1 (in one order of all letters).
    """
    split = one.select("k", F.length("k").alias("n"), F.array_distinct(F.split("k", "")).alias("letters")).withColumn("need", F.ceil(F.round(F.col("n") * least, 9)))
    able = split.where(F.size("letters") >= F.col("need"))
    letters = able.select("k", "n", "need", F.size("letters").alias("m"), F.explode("letters").alias("c"))
    counted = letters.join(F.broadcast(letters.groupBy("c").agg(F.count("*").alias("df"))), "c")  # at most one row for each character there is
    order = Window.partitionBy("k").orderBy("df", "c")
    kept = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("m") - F.col("need") + 1)
    # lengths from ceil(least n) to n: the shorter side posts its own length, the longer all that it may meet
    long = kept.select(F.col("k").alias("a"), "c", F.explode(F.sequence(F.col("need"), F.col("n").cast("bigint"))).alias("n"))
    met = long.join(kept.select(F.col("k").alias("b"), "c", F.col("n").cast("bigint").alias("n")), ["c", "n"]).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def string_pairs(entities: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, similarity`` of distinct texts ``a < b`` of the column ``entity``.

    Only texts that contain one another, are equal but for case and blanks at
    the ends, or share a rare letter at fitting lengths are compared; no pair
    of at least ``least`` (above 0) is lost.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    one = cut(entities.where("entity IS NOT NULL").select("entity", F.trim(F.lower("entity")).alias("k")).distinct())
    keys = one.where("k <> ''").select("k").distinct()
    found = _share_letters(keys, least)
    if least <= 0.9:
        inside = contained(keys, keys).where("inner <> outer")
        found = found.union(inside.select(F.least("inner", "outer"), F.greatest("inner", "outer")))
    equal = keys.select(F.col("k").alias("a"), F.col("k").alias("b"))
    both = found.distinct().union(equal)
    a, b = (one.select(F.col("k").alias(x), F.col("entity").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    pairs = both.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("similarity", T.string_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)


def embedding_pairs(vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """``a, b, similarity`` of ids ``a < b`` of ``vectors(id, embedding)`` with that cosine; exact, by blocks of matrix products."""
    return V.pairs(vectors, least)


def jaccard_pairs(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """``a, b, jaccard`` of concepts by the passages that they share; pairs meet in a passage, never all with all.

    The join is quadratic in the number of concepts of a passage.
    """
    with parted(edges.sparkSession, edges.count()):
        e = cut(edges.select("passage_id", "concept_id").distinct())
    degree = F.col("n").cast("double")
    pairs = e.groupBy("passage_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(degree * (degree - 1) / 2), F.lit(0.0))).first()[0]
    size = e.groupBy("concept_id").agg(F.count("*").alias("n"))
    a = e.select("passage_id", F.col("concept_id").alias("a"))
    b = e.select("passage_id", F.col("concept_id").alias("b"))
    with parted(edges.sparkSession, min(int(pairs), 10_000 * PART_ROWS)):
        both = cut(a.join(b, "passage_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both")))
    sized = both.join(size.withColumnsRenamed({"concept_id": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"concept_id": "b", "n": "nb"}), "b")
    return sized.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least)


def jaccard_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the ``jaccard`` of their passages: 1 if both have none, 0 if one has none."""
    e = edges.select("passage_id", "concept_id").distinct()
    size = e.groupBy("concept_id").agg(F.count("*").alias("n"))
    one = pairs.select("a", "b").distinct()
    both = one.join(e.withColumnRenamed("concept_id", "a"), "a").join(e.withColumnRenamed("concept_id", "b"), ["b", "passage_id"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = one.join(size.withColumnsRenamed({"concept_id": "a", "n": "na"}), "a", "left").join(size.withColumnsRenamed({"concept_id": "b", "n": "nb"}), "b", "left").join(both, ["a", "b"], "left").fillna(0, ["na", "nb", "both"])
    union = F.col("na") + F.col("nb") - F.col("both")
    return pairs.join(sized.select("a", "b", F.when(union == 0, 1.0).otherwise(F.col("both") / union).alias("jaccard")), ["a", "b"])


def confidence(string: Column, embedding: Column, graph: Column) -> Column:
    """How sure a pair is, from its three similarities; a missing one counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.least(F.lit(1.0), 0.3 * zero(string) + 0.4 * zero(embedding) + 0.3 * zero(graph))


def candidates(
    concepts: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, string_least: float = 0.8, embedding_least: float = 0.85, graph_least: float = 0.6, certain: float = 0.95
) -> DataFrame:
    """``a, b, string_similarity, embedding_similarity, graph_similarity, confidence, phase`` of duplicate texts of named entities and plain concepts.

    Phase 1 finds pairs by their letters. Phase 2, with ``vectors(text,
    embedding)`` and ``embedding_least`` below 0.99, drops those of which a
    text has no vector and adds all pairs near in meaning. Phase 3 keeps pairs
    whose passages agree, and those whose letters are ``certain``. Of concepts
    with equal texts the first id stands for the text.
    """
    named = concepts.where(F.col("concept_type").isin("named_entity", "concept") & F.col("concept_text").isNotNull())
    first = named.groupBy(F.col("concept_text").alias("text")).agg(F.min("concept_id").alias("concept_id"))
    found = string_pairs(first.select(F.col("text").alias("entity")), string_least).select("a", "b", F.col("similarity").alias("s"))
    if vectors is not None and embedding_least < 0.99:
        mine = cut(vectors.join(first.select("text"), "text", "left_semi").dropDuplicates(["text"]))
        x, y = (mine.select(F.col("text").alias(c), F.col("embedding").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        noted = found.join(x, "a").join(y, "b").select("a", "b", "s", T.cosine(F.col("x"), F.col("y")).alias("e"), F.lit("string+embedding").alias("phase"))
        near = V.pairs(mine.withColumnRenamed("text", "id"), embedding_least).join(found, ["a", "b"], "left_anti")
        found = noted.unionByName(near.select("a", "b", T.string_similarity(F.col("a"), F.col("b")).alias("s"), F.col("similarity").alias("e"), F.lit("embedding").alias("phase")))
    else:
        found = found.select("a", "b", "s", F.lit(None).cast("double").alias("e"), F.lit("string").alias("phase"))
    ids = lambda c: first.select(F.col("text").alias(c), F.col("concept_id").alias(f"{c}_id"))
    found = cut(found.join(ids("a"), "a").join(ids("b"), "b"))
    graph = jaccard_of(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct(), edges).withColumnsRenamed({"a": "a_id", "b": "b_id"})
    judged = found.join(graph, ["a_id", "b_id"])
    agree = F.col("jaccard") >= graph_least
    return judged.where(agree | (F.col("s") >= certain)).select(
        "a", "b", F.col("s").alias("string_similarity"), F.col("e").alias("embedding_similarity"), F.col("jaccard").alias("graph_similarity"),
        confidence(F.col("s"), F.col("e"), F.col("jaccard")).alias("confidence"), F.concat("phase", F.when(agree, "+graph").otherwise("+certain")).alias("phase"),
    )


def clusters(pairs: DataFrame) -> DataFrame:
    """``cluster_id, canonical, duplicates, size, confidence``: connected pairs, named by the longest text (the least of equal length)."""
    label = connected_components(pairs, "a", "b")
    text = F.col("node").cast("string")
    best = F.min(F.struct((-F.length(text)).alias("l"), F.col("node").alias("t")))["t"]
    grouped = label.groupBy("component").agg(best.alias("canonical"), F.array_sort(F.collect_set("node")).alias("nodes"))
    return grouped.select(F.col("component").alias("cluster_id"), "canonical", F.array_except("nodes", F.array("canonical")).alias("duplicates"), F.size("nodes").alias("size"), F.lit(0.8).alias("confidence"))


def canonical(pairs: DataFrame) -> DataFrame:
    """``duplicate, canonical``: the longest text of each cluster (the least of equal length) for all of its others."""
    label = connected_components(pairs, "a", "b")
    best = label.groupBy("component").agg(F.min(F.struct((-F.length(F.col("node").cast("string"))).alias("l"), F.col("node").alias("t")))["t"].alias("canonical"))
    return label.join(best, "component").where("node <> canonical").select(F.col("node").alias("duplicate"), "canonical")


def report(before: DataFrame, mapping: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row of counts (concepts before and after, reduction, clusters, their mean and largest size), and the largest merges."""
    size = mapping.groupBy("canonical").agg((F.count("*") + 1).alias("size"), F.array_sort(F.collect_set("duplicate")).alias("duplicates"))
    gone = mapping.select("duplicate").distinct().count()
    held = before.count()
    counts = size.agg(F.count("*").alias("clusters"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_cluster_size"), F.coalesce(F.max("size"), F.lit(0)).alias("max_cluster_size")).select(
        F.lit(held).alias("before"), F.lit(held - gone).alias("after"), F.lit(100.0 * gone / held if held else 0.0).alias("reduction_percent"), "clusters", "avg_cluster_size", "max_cluster_size"
    )
    return counts, size.orderBy(F.desc("size"), "canonical").limit(top)


def merge_concepts(concepts: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and edges after ``mapping(duplicate, canonical)`` of concept ids.

    Concepts that meet keep the longest text (the first id's of equal length),
    the most common type (the least of equal counts) and all passages; edges
    that meet keep the larger weight. A concept that only changes its id keeps
    its text.
    """
    to = mapping.select(F.col("duplicate").alias("concept_id"), "canonical")
    new = concepts.join(to, "concept_id", "left").withColumn("to", F.coalesce("canonical", "concept_id"))
    moved = edges.join(to, "concept_id", "left").groupBy("passage_id", F.coalesce("canonical", "concept_id").alias("concept_id")).agg(F.max("weight").alias("weight"))
    kinds = new.groupBy("to", "concept_type").agg(F.count("*").alias("n")).groupBy("to").agg(F.min(F.struct((-F.col("n")).alias("n"), "concept_type"))["concept_type"].alias("concept_type"))
    texts = new.groupBy("to").agg(F.min(F.struct((-F.length("concept_text")).alias("l"), F.col("concept_id"), F.col("concept_text").alias("t")))["t"].alias("concept_text"), F.count("*").alias("merged"))
    held = moved.groupBy(F.col("concept_id").alias("to")).agg(F.countDistinct("passage_id").alias("frequency"))
    out = texts.join(kinds, "to").join(held, "to", "left").select(F.col("to").alias("concept_id"), "concept_text", "concept_type", F.coalesce("frequency", F.lit(0)).alias("frequency"), "merged")
    return out, moved
