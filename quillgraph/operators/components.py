"""Connected components by alternating star contraction.

Large-star and small-star steps rewire every edge towards the least label of
its neighbourhood; edges never multiply, hubs are spread by label, and the
number of rounds is logarithmic in practice. The least neighbour of a node is
an aggregate, combined before the shuffle, and joined back, so that the edges
of a hub are never one window of one task. Each round is one written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut, parted


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component = least node.

    Null endpoints and self loops are ignored, repeated edges count once, and
    an empty edge table gives an empty result. Raises if ``max_rounds`` rounds
    do not converge, rather than returning partly merged labels.
    """
    spark, rows = edges.sparkSession, edges.count()
    with parted(spark, rows):
        cur = cut(
            edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
            .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
    last = None
    for _ in range(max_rounds):
        with parted(spark, 2 * rows):  # edges never multiply, and a step has them both ways
            cur = cut(_small_star(_large_star(cur)))
        # every rewiring lowers a label, so equal sums of both ends mean a fixed point
        state = tuple(
            cur.agg(
                F.count("*"),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )
        if state == last or state[0] == 0:
            break
        last = state
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
