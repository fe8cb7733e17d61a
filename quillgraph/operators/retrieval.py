"""Retrieval: concept matching, PPR and semantic ranking, fusion, results.

Queries come as rows, so every operator answers a batch. Rows with a null
query id or text match nothing; ties of a ranking go to the earlier passage
(``chunk_index``, then id); empty tables give empty results; columns that an
operator doesn't name are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut
from . import ppr as P, vectors
from .contain import contained
from .graph import Graph


def query_entities(queries: DataFrame) -> DataFrame:
    """``query_id, entity`` (normalised, distinct) of ``queries(query_id, text)``."""
    return (
        queries.select("query_id", F.explode(T.query_entities(F.col("text"))).alias("e"))
        .select("query_id", T.normalize(F.col("e")).alias("entity"))
        .where("entity <> ''")
        .distinct()
    )


def match(entities: DataFrame, concepts: DataFrame, partial: bool = True, semantic: tuple[DataFrame, DataFrame] | None = None, threshold: float = 0.7) -> DataFrame:
    """``query_id, concept_id``: concepts that equal an entity, contain it or lie in it, or are near it in meaning.

    Without ``partial`` equal ones only. ``semantic`` holds the vectors of
    entities and of concepts, ``(text, embedding)`` each; pairs whose plain
    product is at least ``threshold`` match too.
    """
    ids = concepts.select("concept_id").distinct()
    if partial:
        inside = contained(entities.select("entity"), ids).select(F.col("inner").alias("entity"), F.col("outer").alias("concept_id"))
        around = contained(ids, entities.select("entity")).select(F.col("outer").alias("entity"), F.col("inner").alias("concept_id"))
        pairs = inside.union(around)
    else:
        pairs = ids.select(F.col("concept_id").alias("entity"), "concept_id")
    if semantic is not None:
        mine, theirs = (v.select(F.col("text").alias(c), "embedding") for v, c in zip(semantic, ("query_id", "passage_id")))
        near = vectors.search(mine, theirs, None, threshold, unit=False).select(F.col("query_id").alias("entity"), F.col("passage_id").alias("concept_id"))
        pairs = pairs.union(near.join(ids, "concept_id", "left_semi").select("entity", "concept_id"))
    return entities.join(pairs.distinct(), "entity").select("query_id", "concept_id").distinct()


def top_k(scored: DataFrame, k: int, id_col: str = "passage_id", score: Column | None = None) -> DataFrame:
    """``scored`` with the ``rank`` of each query's best ``k`` rows."""
    score = F.round("score", 12) if score is None else score
    order = [score.desc(), *(["chunk_index"] if "chunk_index" in scored.columns else []), id_col]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def pad(scored: DataFrame, matched: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """``scored`` and, for queries with a match but fewer than ``k`` positive scores, the first unscored passages with score 0."""
    held = scored.groupBy("query_id").agg(F.count(F.when(F.col("score") > 0, 1)).alias("positive"), F.count("*").alias("n"))
    short = cut(matched.select("query_id").distinct().join(held, "query_id", "left").fillna(0, ["positive", "n"]).where(F.col("positive") < k).select("query_id", "n"))
    most = short.agg(F.max("n")).first()[0]
    if most is None:
        return scored
    # among the first k + n passages of any order k are unscored; with a positive restart n is below k, so these are few
    first = passages.select("passage_id", "chunk_index").orderBy("chunk_index", "passage_id").limit(k + most)
    zero = short.select("query_id").join(F.broadcast(first.select("passage_id"))).join(scored.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    return scored.select("query_id", "passage_id", "score").unionByName(zero.withColumn("score", F.lit(0.0)))


def ppr_rank(graph: Graph, matched: DataFrame, k: int = 10, alpha: float = 0.15, max_iter: int = 100, weights: tuple[float, float] = (0.5, 0.5), drop_zero: bool = False) -> DataFrame:
    """``query_id, passage_id, score, rank`` of the best ``k`` passages of each query of ``matched(query_id, concept_id[, similarity])``.

    Passages that no mass reaches fill the ranking with score 0, in the order
    of ``chunk_index``, unless ``drop_zero``.
    """
    start = P.restart(matched, graph.concepts, graph.passages.count(), *weights)
    scored = cut(P.ppr(graph.edges, start, alpha, max_iter=max_iter, top=k))
    if not drop_zero:
        scored = pad(scored, matched, graph.passages, k)
    # a few more than k, so that the order of the passages decides ties at the end
    ranked = top_k(scored.join(graph.passages.select("passage_id", "chunk_index"), "passage_id"), k)
    return ranked.select("query_id", "passage_id", "score", "rank")


def ppr_retrieve(graph: Graph, queries: DataFrame, k: int = 10, partial: bool = True, alpha: float = 0.15, drop_zero: bool = False) -> DataFrame:
    """``query_id, passage_id, score, rank`` of the best ``k`` passages of each query with a match."""
    matched = cut(match(query_entities(queries), graph.concepts, partial))
    return ppr_rank(graph, matched, k, alpha, drop_zero=drop_zero)


def results(graph: Graph, ranked: DataFrame, matched: DataFrame) -> DataFrame:
    """``ranked`` with ``content`` (and ``metadata`` if passages have it) and the sorted ``matched_concepts`` of each passage."""
    held = ranked.select("query_id", "passage_id").join(graph.edges.select("passage_id", "concept_id"), "passage_id").join(matched.select("query_id", "concept_id"), ["query_id", "concept_id"], "left_semi")
    named = held.groupBy("query_id", "passage_id").agg(F.array_sort(F.collect_set("concept_id")).alias("matched_concepts"))
    more = [c for c in ("content", "metadata") if c in graph.passages.columns]
    out = ranked.join(graph.passages.select("passage_id", *more), "passage_id").join(named, ["query_id", "passage_id"], "left")
    return out.select(*ranked.columns, *more, F.coalesce("matched_concepts", F.array().cast(named.schema["matched_concepts"].dataType)).alias("matched_concepts"))


def length_boost(n_words: Column) -> Column:
    """1 up to 50 words, then rising to 1.1."""
    return F.when(n_words > 50, F.least(F.lit(1.1), 1 + (n_words - 50) / 500)).otherwise(1.0)


def semantic(queries: DataFrame, passages: DataFrame, k: int = 10, least: float = 0.3, normalise: bool = True) -> DataFrame:
    """Best ``k`` passages by cosine from ``least`` on, scores divided by the query's best; vectors in ``embedding``.

    With a column ``n_words`` (or ``content``, whose words are counted) longer passages get :func:`length_boost`, before the threshold.
    """
    rows = passages.select("passage_id", "embedding", *(["n_words"] if "n_words" in passages.columns else ["content"] if "content" in passages.columns else []))
    if "content" in rows.columns:
        rows = rows.withColumn("n_words", F.size(T.words(F.coalesce("content", F.lit("")))))
    if "n_words" in rows.columns:
        rows = rows.select("passage_id", "embedding", length_boost(F.col("n_words")).alias("boost"))
    found = top_k(vectors.search(queries, rows, k, least), k)
    if not normalise:
        return found
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")))


def fuse(
    ppr: DataFrame, sem: DataFrame, method: str = "weighted_sum", ppr_weight: float = 0.6, semantic_weight: float = 0.4, *, min_semantic: float = 0.3, min_ppr: float = 1e-6
) -> DataFrame:
    """Full outer join of two rankings: ``weighted_sum``, ``max`` or ``harmonic_mean`` of their weighted scores.

    Scores below the least ones are left out, a missing one is 0. The harmonic
    mean of one score, and any other method, is the weighted sum.
    """
    p, s = F.coalesce("p", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    side = lambda df, name, least: df.where(F.col("score") >= least).select("query_id", "passage_id", F.col("score").alias(name))
    both = side(ppr, "p", min_ppr).join(side(sem, "s", min_semantic), ["query_id", "passage_id"], "full")
    a, b = ppr_weight * p, semantic_weight * s
    score = {"max": F.greatest(a, b), "harmonic_mean": F.when((p > 0) & (s > 0) & (a + b > 0), 2 * a * b / (a + b)).otherwise(a + b)}.get(method, a + b)
    return both.select("query_id", "passage_id", p.alias("ppr_score"), s.alias("semantic_score"), score.alias("score"))


def confidence(ppr_score: Column, semantic_score: Column, query_confidence: Column) -> Column:
    """How sure a fused result is: whether both rankings have it, the query's confidence, and the larger score."""
    base = F.when((ppr_score > 0) & (semantic_score > 0), 0.9).when(ppr_score > 0, 0.7).when(semantic_score > 0, 0.6).otherwise(0.0)
    return F.least(F.lit(1.0), base + 0.2 * query_confidence + F.least(F.lit(0.2), 0.1 * F.greatest(ppr_score, semantic_score)))


def explanation(ppr_score: Column, semantic_score: Column, matches: Column) -> Column:
    """Why a fused result was found."""
    why = (
        F.when((ppr_score > 0) & (semantic_score > 0), F.format_string("Linked in the graph (%.3f) and similar in meaning (%.3f)", ppr_score, semantic_score))
        .when(ppr_score > 0, F.format_string("Linked in the graph through entities (%.3f)", ppr_score))
        .when(semantic_score > 0, F.format_string("Similar in meaning (%.3f)", semantic_score))
    )
    named = F.when(F.size(matches) > 0, F.concat(F.lit("Mentions: "), F.array_join(matches, ", ")))
    return F.coalesce(F.nullif(F.concat_ws(" | ", why, named), F.lit("")), F.lit("Only weakly linked"))


def band(score: Column) -> Column:
    """A word for a similarity."""
    return F.when(score > 0.8, "very high").when(score > 0.6, "high").when(score > 0.4, "moderate").otherwise("low")


def semantic_explain(queries: DataFrame, passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id, passage_id, similarity, n_words, preview, level`` of ``pairs(query_id, passage_id)``; those without a vector are left out."""
    both = pairs.select("query_id", "passage_id").join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id").join(passages.select("passage_id", "content", F.col("embedding").alias("__p")), "passage_id")
    content = F.coalesce("content", F.lit(""))
    preview = F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("..."))).otherwise(content)
    similarity = T.cosine(F.col("__q"), F.col("__p"))
    return both.where("__q IS NOT NULL AND __p IS NOT NULL").select("query_id", "passage_id", similarity.alias("similarity"), F.size(T.words(content)).alias("n_words"), preview.alias("preview"), band(similarity).alias("level"))


def diversify(scored: DataFrame, k: int, words: int = 20, overlap: float = 0.7) -> DataFrame:
    """The best ``k`` rows of each query of ``scored(query_id, passage_id, score, content)`` that differ in their first words.

    In the order of score (ties by id) a row is kept unless more than
    ``overlap`` of its first ``words`` distinct words are those of a kept one;
    what is still missing is filled with the others in the same order. Queries
    of at most ``k`` rows keep all. A query's rows are one group, so give it
    rankings that are cut to their best.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(__s=rows["score"].round(12)).sort_values(["__s", "passage_id"], ascending=[False, True]).drop(columns="__s")
        if len(rows) > k:
            kept, seen = [], []
            for at, content in enumerate(rows["content"]):
                mine = set((content or "").lower().split()[:words])
                if all(len(mine & other) / max(len(mine), 1) <= overlap for other in seen):
                    kept.append(at)
                    seen.append(mine)
                    if len(kept) == k:
                        break
            taken = set(kept)
            kept += [at for at in range(len(rows)) if at not in taken][: k - len(kept)]
            rows = rows.iloc[kept]
        return rows.assign(rank=range(1, len(rows) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema) + ", rank int"
    return scored.groupBy("query_id").applyInPandas(pick, schema)


def analyse(ppr: DataFrame, sem: DataFrame) -> DataFrame:
    """``query_id`` with how many results only one ranking or both have, their mean scores and the share that both have."""
    side = lambda df, name: df.select("query_id", "passage_id", F.col("score").alias(name))
    both = side(ppr, "p").join(side(sem, "s"), ["query_id", "passage_id"], "full")
    count = lambda c: F.count(F.when(c, 1))
    p, s = F.col("p").isNotNull(), F.col("s").isNotNull()
    return both.groupBy("query_id").agg(
        count(p & ~s).alias("ppr_only"), count(s & ~p).alias("semantic_only"), count(p & s).alias("combined"),
        F.coalesce(F.avg("p"), F.lit(0.0)).alias("avg_ppr_score"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("avg_semantic_score"), (count(p & s) / F.count("*")).alias("coverage_overlap"),
    )


def hit_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row for each k: hit rate, full support, support coverage, and the mean reciprocal rank over all queries.

    Coverage is averaged over the queries that have gold passages, everything else over all. Repeated rows count once.
    """
    gold = gold.select("query_id", "passage_id").distinct()
    best = ranked.groupBy("query_id", "passage_id").agg(F.min("rank").alias("rank"))
    found = gold.join(best, ["query_id", "passage_id"], "left")
    per = queries.select("query_id").distinct().join(found, "query_id", "left").groupBy("query_id").agg(
        F.min("rank").alias("best"), F.count("passage_id").alias("n"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"n{k}") for k in ks]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("got")) for k in ks])
    flat = per.select("query_id", "best", "n", F.inline(rows))
    return flat.groupBy("k").agg(
        F.round(F.avg((F.col("got") > 0).cast("double")), 6).alias("hit"),
        F.round(F.avg(((F.col("n") > 0) & (F.col("got") == F.col("n"))).cast("double")), 6).alias("full_support"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("got") / F.col("n"))), 6).alias("coverage"),
        F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
    )
