"""Retrieval evaluation: stratified samples, corpora, metrics by type, percentiles, comparison of runs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import retrieval as R


def allocation(rows: DataFrame, strata: list[str], target: int) -> DataFrame:
    """``strata..., size, taken``: how many rows of each stratum make a sample of ``target``.

    Shares are rounded down; what is left goes, one each, to the largest
    fractions (of equal ones to the last stratum), and to none beyond its size.
    """
    counted = rows.groupBy(*strata).agg(F.count("*").alias("size"))
    total = rows.count()
    share = F.col("size") * F.lit(float(target)) / F.lit(float(max(total, 1)))
    based = counted.withColumns({"base": F.least(F.floor(share), F.col("size")), "part": share - F.floor(share)})
    left = F.lit(min(target, total)) - F.sum("base").over(Window.partitionBy())  # one row for each stratum
    place = F.row_number().over(Window.orderBy(F.desc(F.round("part", 9)), *[F.desc(c) for c in strata]))
    extra = ((F.col("place") <= F.col("left")) & (F.col("base") < F.col("size"))).cast("bigint")
    return based.withColumns({"left": left, "place": place}).select(*strata, "size", (F.col("base") + extra).alias("taken"))


def stratified(rows: DataFrame, strata: list[str], target: int, key: str, seed: int = 42) -> DataFrame:
    """A sample with the allocation's numbers; in a stratum those of the least md5 of seed and key, so it depends on the rows only."""
    same = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    on = same(strata[0])
    for c in strata[1:]:
        on = on & same(c)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    placed = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key)))
    taken = allocation(rows, strata, target).select(*strata, "taken")
    return placed.alias("r").join(F.broadcast(taken.alias("t")), on).where("__place <= taken").select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])


def corpus(passages: DataFrame, qa: DataFrame, target: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Passages of a sample, numbered anew, and its questions with the new ids: all that support a question, and others up to ``target``.

    Raises if a question has no support or one that isn't there.
    """
    support = qa.select("id", F.explode_outer("supporting_passage_ids").alias("passage_id"))
    gone = support.join(passages.select("passage_id"), "passage_id", "left_anti").limit(1).count()
    if gone:
        raise ValueError("a question has no supporting passage, or one that is missing")
    gold = support.select("passage_id").distinct()
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("passage_id").cast("string")))
    others = passages.join(gold, "passage_id", "left_anti").orderBy(order, "passage_id").limit(max(0, target - gold.count()))
    kept = passages.join(gold, "passage_id", "left_semi").unionByName(others)
    numbered = kept.withColumn("new_id", F.row_number().over(Window.orderBy("passage_id")) - 1)  # a sample is bounded by its target
    new = support.join(numbered.select("passage_id", "new_id"), "passage_id").groupBy("id").agg(F.array_sort(F.collect_set("new_id")).alias("supporting_passage_ids"))
    out = numbered.withColumnsRenamed({"passage_id": "original_passage_id", "new_id": "passage_id"})
    return out, qa.drop("supporting_passage_ids").join(new, "id")


def manifest(name: str, seed: int, passages: DataFrame, qa: DataFrame, **about) -> dict:
    """What a sample holds, with a hash of it."""
    ids = [r[0] for r in passages.select("original_passage_id").orderBy("original_passage_id").collect()]
    body = {"sample_name": name, "seed": seed, **about, "actual": {"passages": len(ids), "qa": qa.count()}, "qa_ids": [r[0] for r in qa.select("id").orderBy("id").collect()], "old_passage_ids": ids}
    return body | {"manifest_sha256": hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()}


def result_id(metadata_id: Column, passage_id: Column) -> Column:
    """The number of a passage: its metadata's, else that at the end of its id, else the id itself if it is one."""
    return F.coalesce(F.expr("try_cast({} AS bigint)".format("null")) if metadata_id is None else metadata_id.try_cast("bigint"), F.nullif(F.regexp_extract(passage_id.cast("string"), r"^passage_(\d+)$", 1), F.lit("")).try_cast("bigint"), passage_id.cast("string").try_cast("bigint"))


def evaluate(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics by k, hit rates by ``type`` and k, and counts of queries, errors and queries without entities.

    ``queries`` has ``query_id`` and may have ``type``, ``error`` and
    ``n_entities``. A query with an error counts as a miss, and not at all in
    the coverage.
    """
    has = lambda c: F.col(c) if c in queries.columns else F.lit(None)
    q = queries.select("query_id", has("type").cast("string").alias("type"), has("error").cast("string").alias("error"), has("n_entities").cast("bigint").alias("n_entities"))
    good = q.where("error IS NULL")
    held = ranked.join(good.select("query_id"), "query_id", "left_semi")
    metrics = R.hit_metrics(held, gold, q, ks).drop("coverage").join(R.hit_metrics(held, gold, good, ks).select("k", "coverage"), "k", "left")
    best = gold.select("query_id", "passage_id").distinct().join(held.select("query_id", "passage_id", "rank"), ["query_id", "passage_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    each = q.select("query_id", "type").join(best, "query_id", "left").select("type", "best", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    by_type = each.groupBy("type", "k").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce((F.col("best") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("hit"))
    counts = q.agg(F.count("*").alias("queries"), F.count("error").alias("errors"), F.count(F.when((F.col("n_entities") == 0) & F.col("error").isNull(), 1)).alias("without_entities"))
    return metrics, by_type, counts


def percentiles(rows: DataFrame, value: str, wanted: tuple[float, ...] = (50, 95), by: list[str] | None = None) -> DataFrame:
    """``p, value``: nearest-rank percentiles, the place ``p / 100 (n - 1)`` rounded half to even; without interpolation."""
    by = by or []
    kept = rows.where(F.col(value).isNotNull())
    counted = kept.groupBy(*by, value).agg(F.count("*").alias("__c"))
    upto = counted.withColumns({"__hi": F.sum("__c").over(Window.partitionBy(*by).orderBy(value)), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    asked = upto.select(*by, value, "__hi", "__c", "__n", F.explode(F.array(*[F.lit(float(p)) for p in wanted])).alias("p"))
    place = F.bround(F.col("p") / 100 * (F.col("__n") - 1)).cast("bigint")
    return asked.where((place < F.col("__hi")) & (place >= F.col("__hi") - F.col("__c"))).select(*by, "p", F.col(value).alias("value"))


def read_path(result: dict, path: str):
    for key in path.split("."):
        result = result[key]
    return result


def compare(base: dict, new: dict, thresholds: dict[str, dict[str, float]]) -> list[dict]:
    """For each dot path the two values and whether the new one holds: ``min_delta`` (it may fall by so much) or ``max_multiplier`` (it may grow so many times)."""
    out = []
    for path, rule in thresholds.items():
        a, b = read_path(base, path), read_path(new, path)
        ok = ("min_delta" not in rule or b - a >= rule["min_delta"]) and ("max_multiplier" not in rule or b <= a * rule["max_multiplier"])
        out.append({"metric": path, "base": a, "new": b, "ok": ok})
    return out


def markdown(title: str, metrics: DataFrame, counts: DataFrame) -> str:
    """A report of :func:`evaluate`'s metrics and counts."""
    rows, n = metrics.orderBy("k").collect(), counts.first().asDict()
    lines = [f"# {title}", "", ", ".join(f"{k}: {v}" for k, v in n.items()), "", "| k | hit | full support | coverage | MRR |", "|---|---|---|---|---|"]
    return "\n".join([*lines, *[f"| {r.k} | {r.hit} | {r.full_support} | {r.coverage} | {r.mrr} |" for r in rows], ""])


def inspection(ranked: DataFrame, gold: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, rank, passage_id, score (8 digits), is_support, snippet`` of what was retrieved."""
    support = gold.select("query_id", "passage_id").distinct().withColumn("__s", F.lit(True))
    return ranked.join(passages.select("passage_id", "content"), "passage_id", "left").join(support, ["query_id", "passage_id"], "left").select(
        "query_id", "rank", "passage_id", F.round("score", 8).alias("score"), F.coalesce("__s", F.lit(False)).alias("is_support"), snippet(F.col("content")).alias("snippet")
    )


def snippet(text: Column, limit: int = 200) -> Column:
    """The text with single blanks, cut to ``limit`` characters with three dots."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)
