import copy
import hashlib
import math
from collections import Counter

import duckdb
import pytest
from quillgraph.llm import hashtree


def plain(key, tree, path=""):
    """The path of a key, level by level, in plain Python."""
    best = min(
        (-math.log((int(hashlib.md5(f"{key}|{path}/{n}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / w, f"{path}/{n}", below)
        for n, (w, below) in tree.items()
        if w > 0
    )
    return best[1] if best[2] is None else plain(key, best[2], best[1])


def places(spark, n, tree):
    return {r.id: f"/{r.region}/{r.rack}/{r.shard}" for r in hashtree.place(spark.range(n), "id", tree).collect()}


def test_equals_a_plain_descent_and_follows_the_weights(spark):
    got = places(spark, 6000, hashtree.PRODUCTION)
    assert all(got[k] == plain(k, hashtree.PRODUCTION) for k in range(0, 6000, 7))
    share = Counter(p.split("/")[1] for p in got.values())
    assert abs(share["east"] / 6000 - 0.5) < 0.03 and abs(share["north"] / 6000 - 1 / 6) < 0.03


def test_movement_stays_in_the_subtree(spark):
    before = places(spark, 4000, hashtree.PRODUCTION)
    tree = copy.deepcopy(hashtree.PRODUCTION)
    w, below = tree["east"]
    below["b"] = (3.0, below["b"][1])
    after = places(spark, 4000, tree)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(before[k].startswith("/east/") and after[k].startswith("/east/b/") for k in moved)


def test_sql_and_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "c")], "doc_id bigint, region string")
    got = hashtree.place(df)
    assert got.columns == ["doc_id", "region", "rack", "shard"] and got.count() == 4
    path = str(tmp_path / "d.parquet")
    df.select("doc_id").union(spark.range(500)).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(hashtree.sql("documents", "doc_id")).fetchall()
    mine = [tuple(r) for r in hashtree.place(spark.read.parquet(path)).collect()]
    assert Counter(mine) == Counter(want)
    assert hashtree.place(df.limit(0)).count() == 0
    for bad in ({}, {"r": (0.0, None)}, {"r": (-1.0, None)}):
        with pytest.raises(ValueError):
            hashtree.place(df, tree=bad)
