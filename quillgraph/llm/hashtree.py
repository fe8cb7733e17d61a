"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in them and shards in those, each with a weight of
its own. A key descends from the root: at every level each child draws
``-ln(u) / weight`` with ``u`` from a hash of the key and the child's path,
and the least draw wins. The draws of one level don't depend on other levels,
so a change of a weight moves keys only within the children of its parent: a
shard's weight moves keys inside its rack, a rack's inside its region.

All of it is one JVM-side projection over the key column; nothing shuffles.

Defined results: a null key is placed like any other, as the word ``null``;
equal keys (repeated rows) go to the same shard; a node of weight 0 gets
nothing; equal draws go to the path that sorts first. Extra columns are kept
by ``place`` unless they are named region, rack or shard, which are replaced.
An empty table gives an empty result; an empty tree or a negative weight is a
ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Tree = dict[str, tuple[float, "Tree | None"]]

LEVELS = ("region", "rack", "shard")


def uniform_tree(regions: dict[str, float], racks: dict[str, float], shards: int) -> Tree:
    """A tree whose regions hold the same racks of equal shards."""
    leaf = {f"s{k}": (1.0, None) for k in range(shards)}
    return {r: (w, {k: (v, dict(leaf)) for k, v in racks.items()}) for r, w in regions.items()}


#: Three unequal regions of four unequal racks of eight shards.
PRODUCTION = uniform_tree({"east": 3.0, "west": 2.0, "north": 1.0}, {"a": 2.0, "b": 1.0, "c": 1.0, "d": 0.5}, 8)


def children(tree: Tree, path: str = "") -> dict[str, list[tuple[str, float]]]:
    """The weighted children of every inner node, by path; the root's is empty."""
    if any(w < 0 for w, _ in tree.values()):
        raise ValueError(f"a negative weight below {path or 'the root'}")
    here = [(f"{path}/{name}", float(w)) for name, (w, _) in sorted(tree.items()) if w > 0]
    if not here:
        raise ValueError(f"no child of {path or 'the root'} has a weight")
    out = {path: here}
    for name, (w, below) in tree.items():
        if below is not None and w > 0:
            out |= children(below, f"{path}/{name}")
    return out


def draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1] from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path)), 1, 13), 16, 10).cast("bigint")
    return -F.ln((bits + 1) / F.lit(float(1 << 52))) / weight


def place(df: DataFrame, key: str = "doc_id", tree: Tree = PRODUCTION) -> DataFrame:
    """``df`` with the region, rack and shard of each row's key."""
    below = children(tree)
    table = F.create_map(
        *[x for path, nodes in below.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in nodes]))]
    )
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    path = F.lit("")
    out = df.drop(*[c for c in LEVELS if c in df.columns and c != key])
    keep = out.columns
    for level in LEVELS:
        best = F.array_min(F.transform(F.element_at(table, path), lambda c: F.struct(draw(k, c.p, c.w).alias("d"), c.p.alias("p"))))
        out = out.withColumn(f"__{level}", best.p)
        path = F.col(f"__{level}")
    return out.select(*[f"`{c}`" for c in keep], *[F.substring_index(f"__{level}", "/", -1).alias(level) for level in LEVELS])


def sql(table: str, key: str, tree: Tree = PRODUCTION) -> str:
    """DuckDB SQL for ``place`` on the key column."""
    nodes = ", ".join(f"('{parent}', '{p}', {w!r})" for parent, kids in children(tree).items() for p, w in kids)
    steps, last = [], "SELECT DISTINCT coalesce(CAST({0} AS VARCHAR), 'null') AS k, '' AS p FROM {1}".format(key, table)
    for i in range(len(LEVELS)):
        steps.append(f"l{i} AS ({last})")
        last = (
            f"SELECT k, arg_min(path, struct_pack(d := -ln((CAST('0x' || substr(md5(k || '|' || path), 1, 13) AS BIGINT) + 1)"
            f" / 4503599627370496.0::DOUBLE) / w, p := path)) AS p FROM l{i} JOIN nodes ON parent = p GROUP BY k"
        )
    steps.append(f"l{len(LEVELS)} AS ({last})")
    part = ", ".join(f"split_part(p, '/', {i + 2}) AS {c}" for i, c in enumerate(LEVELS))
    return (
        f"WITH nodes(parent, path, w) AS (VALUES {nodes}), {', '.join(steps)} "
        f"SELECT {key}, {part} FROM {table} JOIN l{len(LEVELS)} ON k = coalesce(CAST({key} AS VARCHAR), 'null')"
    )
