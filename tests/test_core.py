import pytest
from pyspark.sql import functions as F
from quillgraph.functions import chunk, text as T
from quillgraph.operators import dedup, graph, ppr, retrieval
from quillgraph.streaming import incremental

EDGES = [("p1", "apple", 1.0), ("p1", "revenue", 1.0), ("p1", "q4 2024", 1.0), ("p2", "microsoft", 1.0), ("p3", "apple", 1.0), ("p3", "microsoft", 1.0)]
SCHEMA = "passage_id string, concept_id string, weight double"


def test_pagerank_of_the_toy_graph_both_ways(spark):
    edges = spark.createDataFrame(EDGES, SCHEMA)
    start = spark.createDataFrame([(1, "apple", 0.4805167235), (1, "revenue", 0.5194832765)], "query_id int, concept_id string, weight double")
    want = {"p1": 0.299898104, "p3": 0.124387118, "p2": 0.035174033}
    assert ppr.steps(0.15, 1e-6, 1000) == 90
    got = {r.passage_id: r.score for r in ppr.ppr(edges, start).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    for alpha, most in ((0.15, 5), (0.15, 4), (0.0, 4), (0.0, 3), (1.0, 9), (0.5, 100)):
        both = [sorted((r.passage_id, round(r.score, 9)) for r in ppr.ppr(edges, start, alpha, max_iter=most, kernel_bytes=k).collect()) for k in (0, 10_000)]
        assert both[0] == both[1] and len(both[0]) == (0 if (alpha, most) in ((0.0, 4), (1.0, 9)) else 3), (alpha, most)
    assert ppr.ppr(edges.limit(0), start).count() == 0 and ppr.ppr(edges, start.limit(0)).count() == 0


def test_chunker_golden_and_guard():
    got = chunk.split_text("Alpha beta gamma. Delta epsilon zeta. Eta theta iota.\n\n\n\nKappa lambda mu.", 40, 8)
    assert got == [("Alpha beta gamma. Delta epsilon zeta.", 0, 37), ("on zeta. Eta theta iota.", 29, 55), ("iota.\n\nKappa lambda mu.", 47, 71)]
    with pytest.raises(ValueError):
        chunk.split_text("x", 10, 9)
    assert chunk.split_text(None) == [] == chunk.split_text("  ")


def test_string_similarity_golden(spark):
    pairs = [("Apple Inc", "apple inc "), ("Apple", "Apple Inc"), ("Microsoft", "Micro soft"), ("revenue", "venture")]
    got = spark.createDataFrame(pairs, "a string, b string").select(F.round(T.string_similarity(F.col("a"), F.col("b")), 6).alias("s")).collect()
    assert sorted(r.s for r in got) == [0.714286, 0.8, 0.9, 1.0]


def test_extraction_and_build(spark):
    rows = [
        ("passage_0", "Apple Inc announced strong revenue growth in Q4 2024.", 0),
        ("passage_1", "Microsoft Corporation also reported significant achievements.", 1),
        ("passage_2", "The technology sector competition increased.", 2),
        ("passage_3", None, 3),
    ]
    df = spark.createDataFrame(rows, "passage_id string, content string, chunk_index int")
    got = {r.passage_id: (set(r.e), set(r.c)) for r in df.select("passage_id", T.entities(F.col("content")).alias("e"), T.concepts(F.col("content")).alias("c")).collect()}
    assert got["passage_0"][1] == {"Apple Inc", "announced", "growth", "revenue", "strong"}
    assert got["passage_1"][0] >= {"Microsoft Corporation"} and got["passage_3"] == (set(), set())
    g = graph.build(df.where("content IS NOT NULL"), 1, 0.5)
    kept = {r.concept_id for r in g.concepts.collect()}
    assert "revenue" in kept and "apple inc" not in kept and "microsoft corporation" not in kept
    q = spark.createDataFrame([(1, "What about Apple's revenue?")], "query_id int, text string")
    matched = retrieval.match(retrieval.query_entities(q), g.concepts)
    ranked = retrieval.ppr_rank(g, matched, 2)
    first, second = retrieval.results(g, ranked, matched).orderBy("rank").collect()
    assert (first.passage_id, second.passage_id) == ("passage_0", "passage_1") and second.score == 0 and second.matched_concepts == []
    assert first.content.startswith("Apple Inc") and "revenue" in first.matched_concepts
    assert [r.passage_id for r in retrieval.ppr_rank(g, matched, 2, drop_zero=True).collect()] == ["passage_0"]
    with pytest.raises(ValueError):
        graph.build(df, 0)
    assert graph.build(df.limit(0)).edges.count() == 0


def test_merge_and_remap_keep_the_larger_weight(spark):
    edges = spark.createDataFrame([("p", "a", 0.2), ("p", "b", 0.9)], SCHEMA)
    assert graph.merge(edges, edges.withColumn("weight", F.lit(0.5))).agg(F.sum("weight")).first()[0] == 1.4
    mapping = spark.createDataFrame([("a", "b")], "duplicate string, canonical string")
    assert [tuple(r) for r in graph.remap(edges, mapping).collect()] == [("p", "b", 0.9)]
    assert dedup.canonical(spark.createDataFrame([("aa", "aab"), ("aab", "b")], "a string, b string")).count() == 2


def test_save_load_and_stream_equal_batch(spark, tmp_path):
    g = graph.Graph(*[spark.createDataFrame(EDGES, SCHEMA)] * 3)
    g.save(str(tmp_path / "g"))
    assert graph.Graph.load(spark, str(tmp_path / "g")).edges.count() == len(EDGES)
    docs = spark.createDataFrame([(i, f"passage about subject{'abcdefgh'[i % 4]} growth") for i in range(8)], "passage_id int, content string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out" / "passages")).drop("batch")
    assert first.count() == 4 == spark.read.parquet(str(tmp_path / "out" / "signatures")).count()
    streamed, built = incremental.graph(spark, str(tmp_path / "out"), 1, 1.0), graph.build(first, 1, 1.0)
    for name in ("concepts", "edges"):
        a, b = (sorted(map(tuple, getattr(g, name).collect())) for g in (streamed, built))
        assert a == b and a
    incremental.index_batch(docs, 99, str(tmp_path / "out"))  # all of it is known
    assert spark.read.parquet(str(tmp_path / "out" / "mentions")).where("batch = 99").count() == 0


def test_extraction_of_very_long_texts(spark):
    texts = ["Der " * 50_000, "the words of a long text " * 20_000 + "Acme Inc", "1" + ",000" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    got = df.select(T.entities(F.col("content")).alias("e"), T.concepts(F.col("content")).alias("c")).collect()
    assert got[1].e[-1] != "" and any("Acme Inc" in e for e in got[1].e) and all(r.c is not None for r in got)
