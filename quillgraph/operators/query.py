"""Query processing: terms, entities by three strategies, confidence, and hybrid retrieval.

A query of fewer than ``MIN_LENGTH`` characters is an error: its row says so
in ``error``, has no entity and confidence 0. Null queries are such; ties go
to the concept id that sorts first; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut
from ..sources.embeddings import Provider, embed
from . import retrieval as R, vectors
from .contain import contained
from .graph import Graph

#: Characters that a query needs, entities that it keeps, and least similarities of terms and of whole queries.
MIN_LENGTH, ENTITIES, TERM_LEAST, QUERY_LEAST = 3, 10, 0.6, 0.5


def terms(text: Column) -> Column:
    """Words of more than two letters that aren't stop words, and the runs of two and three words without one."""
    w = T.words(F.lower(text))
    n = F.size(w)
    stop = lambda x: x.isin(T.TERM_STOP)
    one = F.filter(w, lambda x: ~stop(x) & (F.length(x) > 2))
    runs = lambda k: F.when(n >= k, F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: ~F.exists(F.slice(w, i, k), stop)), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, runs(2), runs(3))


def _share_words(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """``query_id, concept_id`` that may share half of the concept's words: they meet in one of its rarest ones."""
    said = queries.select("query_id", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("word"))
    split = concepts.select("concept_id", F.explode(F.array_distinct(T.words(F.lower("concept_text")))).alias("word"))
    counted = split.join(split.groupBy("word").agg(F.count("*").alias("df")), "word")
    order = Window.partitionBy("concept_id").orderBy("df", "word")
    n = F.count("*").over(Window.partitionBy("concept_id"))
    rare = counted.withColumns({"place": F.row_number().over(order), "n": n}).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") / 2) + 1)
    return said.join(rare.select("concept_id", "word"), "word").select("query_id", "concept_id").distinct()


def text_matches(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """``query_id, concept_id, score`` of concepts whose words the query has: 0.8 + 0.2 x overlap."""
    q = queries.where("text IS NOT NULL").select("query_id", "text", F.lower("text").alias("q"))
    c = concepts.where("concept_text IS NOT NULL").select("concept_id", "concept_text", F.lower("concept_text").alias("c"))
    held = contained(c.select("c"), q.select("q")).select(F.col("inner").alias("c"), F.col("outer").alias("q"))
    holds = contained(q.select("q"), c.select("c")).select(F.col("outer").alias("c"), F.col("inner").alias("q"))
    inside = held.union(holds).distinct().join(q.select("query_id", "q"), "q").join(c.select("concept_id", "c"), "c").select("query_id", "concept_id")
    met = inside.union(_share_words(q, c)).distinct().join(q.select("query_id", "q"), "query_id").join(c.select("concept_id", "c"), "concept_id")
    return met.withColumn("o", T.text_overlap(F.col("q"), F.col("c"))).where("o > 0").select("query_id", "concept_id", (0.8 + 0.2 * F.col("o")).alias("score"))


def merge_entities(by_text: DataFrame, by_term: DataFrame, by_query: DataFrame, most: int = ENTITIES) -> DataFrame:
    """``query_id, concept_id, score, rank``: the better of text and term, the query's similarity only where both are missing."""
    side = lambda df, name: df.groupBy("query_id", "concept_id").agg(F.max("score").alias(name))
    keys = ["query_id", "concept_id"]
    all_ = side(by_text, "x").join(side(by_term, "t"), keys, "full").join(side(by_query, "q"), keys, "full")
    scored = all_.select(*keys, F.coalesce(F.greatest("x", "t"), F.col("q")).alias("score"))
    return R.top_k(scored, most, "concept_id")


def confidence(queries: DataFrame, entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """``query_id, confidence``: mean score of the entities, with a bonus for their number and for frequent ones; 0.1 without any."""
    held = entities.join(concepts.select("concept_id", "frequency"), "concept_id", "left")
    each = held.groupBy("query_id").agg(F.avg("score").alias("s"), F.count("*").alias("n"), F.count(F.when(F.col("frequency") > 5, 1)).alias("often"))
    bonus = lambda c: F.least(F.lit(0.2), 0.05 * F.col(c))
    return queries.select("query_id").distinct().join(each, "query_id", "left").select(
        "query_id", F.when(F.col("n").isNull(), 0.1).otherwise(F.least(F.lit(1.0), F.col("s") + bonus("n") + bonus("often"))).alias("confidence")
    )


def process(queries: DataFrame, concepts: DataFrame, provider: Provider, cache: str | None = None, most: int = ENTITIES) -> tuple[DataFrame, DataFrame]:
    """Processed queries ``query_id, text, cleaned, embedding, confidence, error`` and their entities ``query_id, concept_id, score, rank``."""
    asked = queries.select("query_id", "text", T.clean_query(F.lower("text")).alias("cleaned")).withColumn(
        "error", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < MIN_LENGTH, F.lit(f"Query too short (minimum {MIN_LENGTH} characters)"))
    )
    good = cut(asked.where("error IS NULL"))
    vector = lambda df, column: embed(df.select(F.col(column).alias("text")), provider, cache)
    whole = good.join(vector(good, "cleaned").withColumnRenamed("text", "cleaned"), "cleaned")
    known = cut(concepts.join(vector(concepts, "concept_text").withColumnRenamed("text", "concept_text"), "concept_text").select("concept_id", "concept_text", "embedding"))
    rows = known.select(F.col("concept_id").alias("passage_id"), "embedding")
    asked_terms = cut(good.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")))
    term_vectors = vector(asked_terms, "term").withColumnRenamed("text", "query_id")
    near = vectors.search(term_vectors, rows, None, TERM_LEAST).select(F.col("query_id").alias("term"), F.col("passage_id").alias("concept_id"), "score")
    near = near.join(concepts.select("concept_id", F.lower("concept_text").alias("c")), "concept_id")
    by_term = asked_terms.join(near.select("term", "concept_id", (F.col("score") + 0.2 * T.text_overlap(F.col("term"), F.col("c"))).alias("score")), "term")
    by_query = vectors.search(whole.select("query_id", "embedding"), rows, None, QUERY_LEAST).withColumnRenamed("passage_id", "concept_id")
    entities = cut(merge_entities(text_matches(good, concepts), by_term.select("query_id", "concept_id", "score"), by_query, most))
    sure = confidence(good, entities, concepts)
    out = whole.join(sure, "query_id").select("query_id", "text", "cleaned", "embedding", "confidence", "error")
    failed = asked.where("error IS NOT NULL").select("query_id", "text", "cleaned", F.lit(None).cast("array<double>").alias("embedding"), F.lit(0.0).alias("confidence"), "error")
    return cut(out.unionByName(failed)), entities


def hybrid(
    graph: Graph, queries: DataFrame, provider: Provider, k: int = 20, ppr_k: int = 30, semantic_k: int = 30, method: str = "weighted_sum", ppr_weight: float = 0.6,
    semantic_weight: float = 0.4, alpha: float = 0.15, least: float = 0.5, diverse: bool = True, cache: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results of both rankings fused, and the analysis of each query.

    Results are ``query_id, rank, passage_id, content, score, ppr_score,
    semantic_score, entity_matches, confidence, explanation``.
    """
    asked, entities = process(queries, graph.concepts, provider, cache)
    said = entities.join(graph.concepts.select("concept_id", "concept_text"), "concept_id")
    matched = cut(R.match(said.select("query_id", T.normalize(F.col("concept_text")).alias("entity")).where("entity <> ''").distinct(), graph.concepts))
    by_graph = cut(R.ppr_rank(graph, matched, ppr_k, alpha))
    texts = graph.passages.select("passage_id", "content")
    held = texts.join(embed(texts.select(F.col("content").alias("text")), provider, cache).withColumnRenamed("text", "content"), "content")
    by_meaning = cut(R.semantic(asked.where("embedding IS NOT NULL").select("query_id", "embedding"), held.select("passage_id", "content", "embedding"), semantic_k, least))
    fused = R.fuse(by_graph, by_meaning, method, ppr_weight, semantic_weight).join(texts, "passage_id")
    ranked = R.diversify(fused, k) if diverse else R.top_k(fused, k)
    named = said.join(graph.edges.select("passage_id", "concept_id"), "concept_id").groupBy("query_id", "passage_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept_text"))), lambda x: x["concept_text"]).alias("entity_matches")
    )
    out = ranked.join(named, ["query_id", "passage_id"], "left").join(asked.select("query_id", F.col("confidence").alias("sure")), "query_id")
    p, s, m = F.col("ppr_score"), F.col("semantic_score"), F.coalesce("entity_matches", F.array().cast("array<string>"))
    shown = out.select("query_id", "rank", "passage_id", "content", "score", "ppr_score", "semantic_score", m.alias("entity_matches"), R.confidence(p, s, F.col("sure")).alias("confidence"), R.explanation(p, s, m).alias("explanation"))
    return shown, R.analyse(by_graph, by_meaning).join(asked.select("query_id", F.col("confidence").alias("query_confidence")), "query_id")
