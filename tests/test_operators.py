"""Operators of the core against definitions, goldens and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgraph.functions import text as T
from quillgraph.operators import contain, dedup, evaluate, graph, ppr, query as Q, retrieval as R, vectors, weights
from quillgraph.sources import embeddings as E

EDGE = "passage_id string, concept_id string, weight double"


def strings(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_contained_equals_all_pairs(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))) for _ in range(150)} | {None, "", "é", "aé"}
    for prefix in (5, 2):
        got = {tuple(r) for r in contain.contained(strings(spark, words), strings(spark, words), prefix).collect()}
        assert got == {(a, b) for a in words for b in words if a and b and a in b}
    assert contain.contained(strings(spark, []), strings(spark, words)).count() == 0


def test_string_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["Ab", "ab ", "AB", "abcdefg", "gfedcba", None, ""]
    df = strings(spark, [*words, *words[:5]], "entity")
    one = sorted({w for w in words if w and w.strip()})
    rows = spark.createDataFrame([(a, b) for a in one for b in one if a < b], "a string, b string")
    for least in (0.5, 0.8, 0.95):
        want = {tuple(r) for r in rows.withColumn("s", F.round(T.string_similarity(F.col("a"), F.col("b")), 9)).where(F.col("s") >= least).collect()}
        assert {(r.a, r.b, round(r.similarity, 9)) for r in dedup.string_pairs(df, least).collect()} == want
        assert want
    with pytest.raises(ValueError):
        dedup.string_pairs(df, 0)


def table(rng, n, width=6):
    return {i: rng.normal(size=width).tolist() for i in range(n)}


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def test_vector_pairs_and_search_equal_brute_force(spark):
    v = table(np.random.default_rng(3), 60) | {60: [0.0] * 6}
    df = spark.createDataFrame(list(v.items()), "id bigint, embedding array<double>")
    want = {(a, b) for a in v for b in v if a < b and cos(v[a], v[b]) >= 0.6}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in vectors.pairs(df, 0.6, block).collect()} == want
    q, p = df.withColumnRenamed("id", "query_id"), df.select(F.concat(F.lit("p"), "id").alias("passage_id"), "embedding")
    for size in (64 << 20, 200):
        got = R.top_k(vectors.search(q, p, 3, 0.1, query_bytes=size), 3)
        best = {i: sorted(((-cos(v[i], v[j]), f"p{j}") for j in v if cos(v[i], v[j]) >= 0.1))[:3] for i in v}
        assert {(r.query_id, r.rank, r.passage_id) for r in got.collect()} == {(i, k, j) for i, rows in best.items() for k, (_, j) in enumerate(rows, 1)}
    assert vectors.search(q.limit(0), p, 3, 0.1).count() == 0 == vectors.search(q, p.limit(0), 3, 0.1).count()


def test_semantic_boosts_long_passages_before_the_threshold(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    p = spark.createDataFrame([("short", [0.49, 0.8717], "word " * 50), ("long", [0.49, 0.8717], "word " * 100), ("none", None, None)], "passage_id string, embedding array<double>, content string")
    got = R.semantic(q, p, 5, 0.5, normalise=False).collect()
    assert [(r.passage_id, round(r.score, 3)) for r in got] == [("long", 0.539)]
    assert R.semantic(q, p, 5, 0.5).first().score == 1.0


def test_meaning_matches_concepts(spark):
    known = {"cashflow": [1, 0, 0], "cash flow": [0.95, 0.3122, 0], "income": [0, 1, 0], "revenue": [0, 0.8, 0.6], "ai": [0, 0, 1], "artificial intelligence": [0, 0.3122, 0.95]}
    provider = E.FixedProvider(known)
    concepts = strings(spark, ["cash flow", "revenue", "artificial intelligence"], "concept_id")
    asked = spark.createDataFrame([(1, "cashflow"), (2, "ai"), (3, "income"), (4, "cash")], "query_id int, entity string")
    near = E.embed(asked.select("entity"), provider), E.embed(concepts, provider)
    match = lambda t: {tuple(r) for r in R.match(asked, concepts, semantic=near, threshold=t).collect()}
    assert match(0.7) == {(1, "cash flow"), (2, "artificial intelligence"), (3, "revenue"), (4, "cash flow")}
    assert match(0.85) == match(0.7) - {(3, "revenue")}
    assert {tuple(r) for r in R.match(asked, concepts).collect()} == {(4, "cash flow")}


def test_fusion(spark):
    side = lambda rows: spark.createDataFrame(rows, "query_id int, passage_id string, score double")
    p, s = side([(1, "a", 0.5), (1, "b", 0.2), (1, "z", 1e-7)]), side([(1, "a", 0.5), (1, "c", 1.0), (1, "y", 0.2)])
    got = lambda m: {r.passage_id: round(r.score, 6) for r in R.fuse(p, s, m).collect()}
    assert got("weighted_sum") == got("magic") == {"a": 0.5, "b": 0.12, "c": 0.4}
    assert got("max") == {"a": 0.3, "b": 0.12, "c": 0.4} and got("harmonic_mean") == {"a": 0.24, "b": 0.12, "c": 0.4}
    row = R.analyse(p, s).first()
    assert (row.ppr_only, row.semantic_only, row.combined, round(row.coverage_overlap, 6)) == (2, 2, 1, 0.2)
    sure = spark.range(1).select(R.confidence(F.lit(0.5), F.lit(1.0), F.lit(0.4)).alias("both"), R.confidence(F.lit(0.5), F.lit(0.0), F.lit(0.5)).alias("one"), R.confidence(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("none")).first()
    assert (sure.both, round(sure.one, 6), sure.none) == (1.0, 0.85, 0.0)
    text = spark.range(1).select(R.explanation(F.lit(0.5), F.lit(0.25), F.array(F.lit("x"), F.lit("y"))).alias("a"), R.explanation(F.lit(0.0), F.lit(0.0), F.array().cast("array<string>")).alias("b")).first()
    assert text.a == "Linked in the graph (0.500) and similar in meaning (0.250) | Mentions: x, y" and text.b == "Only weakly linked"


def plain_diverse(rows, k):
    rows = sorted(rows, key=lambda r: (-round(r[1], 12), r[0]))
    if len(rows) <= k:
        return [r[0] for r in rows]
    kept, seen = [], []
    for r in rows:
        mine = set((r[2] or "").lower().split()[:20])
        if not any(len(mine & o) / max(len(mine), 1) > 0.7 for o in seen):
            kept.append(r)
            seen.append(mine)
        if len(kept) == k:
            break
    return [r[0] for r in (kept + [r for r in rows if r not in kept])[:k]]


def test_diversification_equals_its_definition(spark):
    rng = random.Random(4)
    rows = [(q, f"p{i}", rng.choice([0.1, 0.5, rng.random()]), rng.choice([None, "", " ".join(rng.choice("abcdef") for _ in range(6))])) for q in range(4) for i in range(3 + 8 * q)]
    got = {}
    for r in R.diversify(spark.createDataFrame(rows, "query_id int, passage_id string, score double, content string"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.passage_id)
    assert got == {q: plain_diverse([r[1:] for r in rows if r[0] == q], 5) for q in range(4)}


def test_query_terms_and_entities(spark):
    df = strings(spark, ["What drives the Apple revenue growth", "of the", None])
    got = [r[0] for r in df.select(Q.terms(F.col("t"))).collect()]
    assert got[0] == ["drives", "apple", "revenue", "growth", "apple revenue", "revenue growth", "apple revenue growth"] and not got[1] and not got[2]
    q = spark.createDataFrame([(1, "Apple revenue growth in Europe"), (2, None)], "query_id int, text string")
    names = ["Apple", "revenue", "revenue growth rate", "growth of annual net revenue", "of in", "europe bank law", "Microsoft"]
    c = spark.createDataFrame([(n.lower(), n) for n in names], "concept_id string, concept_text string")
    want = {}
    for n in names:
        a, b = "apple revenue growth in europe", n.lower()
        share = len(set(a.split()) & set(b.split())) / len(set(b.split()))
        o = 1.0 if b in a or a in b else share if share >= 0.5 else 0
        if o:
            want[b] = round(0.8 + 0.2 * o, 9)
    assert {r.concept_id: round(r.score, 9) for r in Q.text_matches(q, c).collect()} == want and len(want) == 4
    rows = lambda *x: spark.createDataFrame(x, "query_id int, concept_id string, score double")
    merged = Q.merge_entities(rows((1, "a", 0.9), (1, "b", 0.8)), rows((1, "a", 0.7), (1, "b", 0.95), (1, "c", 0.6)), rows((1, "c", 0.99), (1, "d", 0.5)), 3)
    assert {(r.concept_id, r.score, r.rank) for r in merged.collect()} == {("b", 0.95, 1), ("a", 0.9, 2), ("c", 0.6, 3)}
    often = spark.createDataFrame([("a", 9), ("b", 1), ("c", 6)], "concept_id string, frequency int")
    sure = {r.query_id: round(r.confidence, 9) for r in Q.confidence(q, merged, often).collect()}
    assert sure == {1: 1.0, 2: 0.1}


def test_hybrid_retrieval_end_to_end(spark):
    texts = ["Apple revenue growth was strong", "Apple sells phones in Europe", "Microsoft cloud services", "Apple revenue growth was strong again", "weather report"]
    g = graph.build(spark.createDataFrame([(f"p{i}", t, i) for i, t in enumerate(texts)], "passage_id string, content string, chunk_index bigint"), 1, 1.0)
    q = spark.createDataFrame([(1, "Apple revenue growth"), (2, "ab")], "query_id int, text string")
    found, analysis = Q.hybrid(g, q, E.HashedProvider(), k=3)
    rows = found.orderBy("rank").collect()
    assert {r.query_id for r in rows} == {1} and len(rows) == 3 and rows[0].passage_id in ("p0", "p3") and "Apple" in rows[0].entity_matches
    assert all(0 < r.confidence <= 1 and r.explanation for r in rows) and analysis.count() == 1
    asked, _ = Q.process(q, g.concepts, E.HashedProvider())
    assert {r.query_id: (r.error is None, r.confidence == 0) for r in asked.collect()} == {1: (True, False), 2: (False, True)}


def test_edge_weights_golden(spark):
    passages = [
        "Tim Cook announced that Apple's Q4 2024 revenue growth exceeded expectations. The CEO stated that performance in California markets was strong.",
        "Microsoft reported strong results.", "Apple grew again.",
    ]
    types = {"Tim Cook": "PERSON", "Apple": "ORG", "Q4 2024": "DATE", "California": "LOC"}
    got = weights.passage_weights(spark, passages[0], list(types), ["CEO", "revenue growth", "absent"], passages, types)

    def plain(term):
        text, low = passages[0], passages[0].lower()
        at, starts = low.find(term.lower()), []
        while at >= 0:
            starts.append(at)
            at = low.find(term.lower(), at + len(term))
        if not starts:
            return 0.0
        tf = min(1, 10 * len(starts) / len(text.split()))
        idf = np.log(3 / sum(term.lower() in p.lower() for p in passages)) / np.log(3)
        u = lambda r: 0.9 if r < 0.2 or r > 0.8 else 0.7 if r < 0.4 or r > 0.6 else 0.5
        near = [text[max(0, s - 50) : s + len(term) + 50].lower() for s in starts]
        context = max(min(1, 5 * sum(k in n for k in weights.KEYWORDS) / len(n.split())) for n in near)
        w = 0.35 * tf * idf + 0.25 * max(u(s / len(text)) for s in starts) + 0.2 * weights.TYPE_WEIGHTS.get(types.get(term), 0.7) + 0.2 * context
        return min(1, w * (min(1.2, 1 + 0.1 * (len(starts) - 1)) if len(starts) > 1 else 1))

    assert got.keys() == {*types, "CEO", "revenue growth", "absent"}
    for term, w in got.items():
        assert abs(w - plain(term)) < 1e-9, term
    odd = spark.createDataFrame([("a.b a.b aXb", "a.b"), ("x\\Ey x\\Ey", "x\\Ey"), ("aaaa", "aa"), (None, "a"), ("abc", ""), ("Ab aB", "AB")], "t string, w string")
    assert [r[0] for r in odd.select(weights.mentions(F.col("t"), F.col("w"))).collect()] == [[0, 4], [0, 5], [0, 2], [], [], [0, 3]]


def test_graph_of_extractions(spark):
    rows = [
        ("h1", "Apple Inc grew. Apple Inc is strong", ["Apple Inc"], ["growth", "Apple Inc"], 0), ("h2", "APPLE INC and growth here", ["APPLE INC"], ["growth"], 1),
        (None, "nothing of note in here", [], ["note"], 2), ("h4", "short", ["x"], [], 3), ("h1", "Apple Inc grew again today", ["Apple Inc"], [], 4),
    ]
    df = spark.createDataFrame(rows, "passage_hash string, content string, entities array<string>, concepts array<string>, n bigint")
    g = graph.from_extractions(df, 1, 1.0)
    assert {r.passage_id: r.content for r in g.passages.collect()} == {"h1": rows[4][1], "h2": rows[1][1], "passage_2": rows[2][1]}
    kinds = {r.concept_id: (r.concept_text, r.concept_type, r.frequency) for r in g.concepts.collect()}
    assert kinds == {"apple inc": ("Apple Inc", "named_entity", 2), "growth": ("growth", "document_concept", 2), "note": ("note", "document_concept", 1)}
    edges = {(r.passage_id, r.concept_id): r.weight for r in g.edges.collect()}
    assert edges[("h2", "apple inc")] == 1.0 and 0 < edges[("h1", "apple inc")] < 1 and edges[("h1", "growth")] == 0.0
    assert graph.from_extractions(df, 1, 1.0, weighted=False, separate_types=False).concepts.where("concept_type = 'concept'").count() == 3


def test_structure_and_lookups(spark, tmp_path):
    edges = spark.createDataFrame([("p1", "a", 1.0), ("p1", "b", 0.5), ("p2", "c", 1.0)], EDGE)
    passages = spark.createDataFrame([(f"p{i}", "text " * 60, i, {"k": "v"}) for i in (1, 2, 3)], "passage_id string, content string, chunk_index bigint, metadata map<string,string>")
    concepts = spark.createDataFrame([(c, c.upper(), "concept", 1) for c in "abc"], "concept_id string, concept_text string, concept_type string, frequency bigint")
    row = graph.structure(edges, passages, concepts).first()
    assert (row.nodes, row.edges, row.components, row.is_connected, row.max_degree, row.min_degree, row.passage_nodes) == (6, 3, 3, False, 2, 0, 3)
    assert abs(row.density - 2 * 3 / 30) < 1e-12 and abs(row.bipartite_density - 3 / 9) < 1e-12
    vectors_ = spark.createDataFrame([("a", [1.0, 2.0])], graph.EMBEDDINGS)
    g = graph.Graph(passages, concepts, edges, vectors_)
    assert {r.concept_id: r.weight for r in g.neighbours(passage_id="p1").collect()} == {"a": 1.0, "b": 0.5} and g.neighbours(concept_id="c").count() == 1
    with pytest.raises(ValueError):
        g.neighbours()
    g.save(str(tmp_path / "g"))
    g.write_json(str(tmp_path / "j"))
    back, js = graph.Graph.load(spark, str(tmp_path / "g")), graph.Graph.read_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, edges.collect())) and back.embeddings.count() == js.embeddings.count() == 1
    assert {(r.passage_id, r.concept_id, r.weight) for r in js.edges.collect()} == {("p1", "a", 1.0), ("p1", "b", 1.0), ("p2", "c", 1.0)}
    assert js.passages.orderBy("chunk_index").first().metadata == {"k": "v"} and js.concepts.count() == 3
    (tmp_path / "one.json").write_text('{"passages": [{"passage_id": "p", "content": "c", "chunk_index": 0, "concepts": ["x"], "metadata": {"a": "b"}}],\n "concepts": [{"concept_id": "x", "concept_text": "X", "concept_type": "concept", "frequency": 1, "passage_ids": ["p"]}],\n "edges": {"p": ["x"]}, "concept_embeddings": {"x": [0.5, 1.0]}}')
    one = graph.Graph.read_json(spark, str(tmp_path / "one.json"))
    assert [tuple(r) for r in one.edges.collect()] == [("p", "x", 1.0)] and one.passages.first().content == "c" and one.embeddings.first().embedding == [0.5, 1.0]
    nodes = {r.id: r for r in g.nodes(flat=True).collect()}
    assert len(nodes["passage:p1"].content) == 203 and nodes["passage:p1"].metadata == {"passage_k": "v"} and nodes["concept:a"].num_passages == 1 and g.links().count() == 3
    assert graph.flatten({"a": {"b": 1, "c": None}, "d": ["x", "y"], "e": [1, 2], "f": {1: True}}) == {"a_b": 1, "a_c": "", "d": "x, y", "e": "[1, 2]", "f_1": True}


def test_merging_and_appending_graphs(spark):
    make = lambda ps, es: graph.Graph(
        spark.createDataFrame(ps, "passage_id string, content string, chunk_index bigint"), spark.createDataFrame(sorted({(c, c, "concept", 1) for _, c, _ in es}), graph.CONCEPTS), spark.createDataFrame(es, EDGE)
    )
    a = make([("passage_0", "a0", 0), ("passage_1", "a1", 1)], [("passage_0", "x", 0.5), ("passage_1", "y", 1.0)])
    b = make([("passage_0", "b0", 7), ("passage_9", "b9", 3)], [("passage_0", "x", 0.9), ("passage_9", "z", 0.1)])
    m = graph.merge_all(a, b)
    assert {r.passage_id: r.content for r in m.passages.collect()} == {"passage_0": "a0", "passage_1": "a1", "passage_9": "b9"}
    assert {tuple(r) for r in m.edges.collect()} == {("passage_0", "x", 0.9), ("passage_1", "y", 1.0), ("passage_9", "z", 0.1)}
    n = graph.append(a, b)
    assert {r.passage_id: r.content for r in n.passages.collect()} == {"passage_0": "a0", "passage_1": "a1", "passage_2": "b9", "passage_3": "b0"}
    assert ("passage_3", "x", 0.9) in {tuple(r) for r in n.edges.collect()} and {r.concept_id: r.frequency for r in n.concepts.collect()} == {"x": 2, "y": 1, "z": 1}


def test_dedup_phases(spark):
    names = ["Apple Inc", "Apple Incs", "Banana", "Bananas", "Cherry", "Kirsche", "apple inc"]
    concepts = spark.createDataFrame([(n.lower() + str(i), n, "named_entity", 1) for i, n in enumerate(names)], graph.CONCEPTS)
    edges = spark.createDataFrame([(p, n.lower() + str(i), 1.0) for i, n in enumerate(names) for p in ({"p1", "p2"} if i not in (3, 6) else {"p9"})], EDGE)
    found = {(r.a, r.b): r for r in dedup.candidates(concepts, edges).collect()}
    assert ("Apple Inc", "Apple Incs") in found and found["Apple Inc", "Apple Incs"].phase == "string+graph"
    assert ("Banana", "Bananas") not in found  # their passages differ, and they aren't certain
    assert found["Apple Inc", "apple inc"].phase == "string+certain"
    known = spark.createDataFrame([("Cherry", [1.0, 0.0]), ("Kirsche", [0.99, 0.1]), ("Apple Inc", [0.0, 1.0]), ("Apple Incs", [0.0, 1.0])], "text string, embedding array<double>")
    near = {(r.a, r.b): r.phase for r in dedup.candidates(concepts, edges, known).collect()}
    assert near == {("Apple Inc", "Apple Incs"): "string+embedding+graph", ("Cherry", "Kirsche"): "embedding+graph"}
    mapping = dedup.canonical(spark.createDataFrame([tuple(k) for k in found], "a string, b string"))
    assert {tuple(r) for r in mapping.collect()} == {("Apple Inc", "Apple Incs"), ("apple inc", "Apple Incs")}
    cluster = dedup.clusters(spark.createDataFrame([tuple(k) for k in found], "a string, b string")).first()
    assert (cluster.canonical, cluster.duplicates, cluster.size) == ("Apple Incs", ["Apple Inc", "apple inc"], 3)
    counts, top = dedup.report(concepts, mapping)
    assert counts.first().asDict() == {"before": 7, "after": 5, "reduction_percent": 200 / 7, "clusters": 1, "avg_cluster_size": 3.0, "max_cluster_size": 3} and top.count() == 1


def test_merging_concepts(spark):
    concepts = spark.createDataFrame([("a", "Ann", "named_entity", 1), ("b", "Anna", "concept", 1), ("c", "Anno", "concept", 1), ("d", "Dan", "concept", 1)], graph.CONCEPTS)
    edges = spark.createDataFrame([("p1", "a", 0.2), ("p1", "b", 0.7), ("p2", "c", 0.5), ("p3", "d", 1.0)], EDGE)
    out, moved = dedup.merge_concepts(concepts, edges, spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "e")], "duplicate string, canonical string"))
    assert {tuple(r) for r in out.collect()} == {("c", "Anna", "concept", 2, 3), ("e", "Dan", "concept", 1, 1)}
    assert {tuple(r) for r in moved.collect()} == {("p1", "c", 0.7), ("p2", "c", 0.5), ("p3", "e", 1.0)}


def test_samples_and_metrics(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["bridge", "comparison", None]), rng.choice("eh")) for i in range(97)]
    df = spark.createDataFrame(rows, "id int, type string, level string")
    for target in (10, 33, 97, 500):
        taken = {(r.type, r.level): (r.size, r.taken) for r in evaluate.allocation(df, ["type", "level"], target).collect()}
        assert sum(t for _, t in taken.values()) == min(target, 97) and all(abs(t - s * target / 97) < 1 or target > 97 for s, t in taken.values())
        got = evaluate.stratified(df, ["type", "level"], target, "id").collect()
        count = {}
        for r in got:
            count[r.type, r.level] = count.get((r.type, r.level), 0) + 1
        assert count == {k: t for k, (_, t) in taken.items() if t}
    values = [rng.random() for _ in range(40)] + [0.5] * 10
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.p: r.value for r in evaluate.percentiles(frame, "v", (0, 5, 50, 95, 100)).collect()}
    assert got == {float(p): sorted(values)[round(p / 100 * (len(values) - 1))] for p in (0, 5, 50, 95, 100)}
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "x", 1), (2, "c", 4), (3, "d", 1)], "query_id int, passage_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")], "query_id int, passage_id string")
    asked = spark.createDataFrame([(1, "x", None, 2), (2, "x", None, 0), (3, "y", "boom", 1), (4, "y", None, 3)], "query_id int, type string, error string, n_entities int")
    metrics, by_type, counts = evaluate.evaluate(ranked, gold, asked)
    m = {r.k: r for r in metrics.collect()}
    assert (m[1].hit, m[3].hit, m[5].hit) == (0.25, 0.25, 0.5) and (m[1].full_support, m[3].full_support, m[5].full_support) == (0.0, 0.25, 0.5)
    assert m[1].coverage == round(0.5 / 3, 6) and m[5].coverage == round(2 / 3, 6) and m[1].mrr == round((1 + 0.25) / 4, 6)
    assert {(r.type, r.k): r.hit for r in by_type.collect()}["x", 5] == 1.0 and counts.first().asDict() == {"queries": 4, "errors": 1, "without_entities": 1}
    assert "| 10 |" in evaluate.markdown("Run", metrics, counts)
    limits = {"metrics.mrr": {"min_delta": -0.03}, "runtime.avg": {"max_multiplier": 1.3}}
    told = evaluate.compare({"metrics": {"mrr": 0.9}, "runtime": {"avg": 2.0}}, {"metrics": {"mrr": 0.88}, "runtime": {"avg": 2.7}}, limits)
    assert [t["ok"] for t in told] == [True, False]
    ids = spark.createDataFrame([("7", "passage_3"), (None, "passage_3"), (None, "12"), (None, "x")], "m string, p string")
    assert [r[0] for r in ids.select(evaluate.result_id(F.col("m"), F.col("p"))).collect()] == [7, 3, 12, None]
    shown = evaluate.inspection(ranked.withColumn("score", F.lit(1 / 3)), gold, spark.createDataFrame([("a", "x  " * 200)], "passage_id string, content string")).where("passage_id = 'a'").first()
    assert shown.is_support and shown.score == 0.33333333 and shown.snippet.endswith("...") and len(shown.snippet) <= 200


def test_sample_corpus(spark):
    passages = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "passage_id int, content string")
    qa = spark.createDataFrame([("q1", [3, 17]), ("q2", [3])], "id string, supporting_passage_ids array<int>")
    kept, asked = evaluate.corpus(passages, qa, 6)
    rows = {r.passage_id: r.original_passage_id for r in kept.collect()}
    assert len(rows) == 6 and sorted(rows) == list(range(6)) and [rows[i] for i in range(6)] == sorted(rows.values())
    assert {r.id: [rows[i] for i in r.supporting_passage_ids] for r in asked.collect()} == {"q1": [3, 17], "q2": [3]}
    assert evaluate.manifest("s", 42, kept, asked)["manifest_sha256"] == evaluate.manifest("s", 42, kept, asked)["manifest_sha256"]
    for bad in ([("q", [99])], [("q", [])]):
        with pytest.raises(ValueError):
            evaluate.corpus(passages, spark.createDataFrame(bad, "id string, supporting_passage_ids array<int>"), 6)


def test_trace_ends_at_the_scores(spark):
    edges = spark.createDataFrame([("p1", "a", 1.0), ("p1", "b", 1.0), ("p2", "b", 1.0)], EDGE)
    start = spark.createDataFrame([(1, "a", 1.0)], "query_id int, concept_id string, weight double")
    rows = ppr.trace(edges, start, max_iter=6).collect()
    assert {r.iteration for r in rows} == set(range(1, 7))
    last = {r.node: r.score for r in rows if r.iteration == 6 and r.side == "passage"}
    want = {r.passage_id: r.score for r in ppr.ppr(edges, start, max_iter=6).collect()}
    assert last.keys() == want.keys() and all(abs(last[k] - want[k]) < 1e-12 for k in want)
    for r in rows:
        assert abs(r.diff - 2 * 0.85**r.iteration) < 1e-12


def test_walks_over_stored_blocks_equal_joins(spark, monkeypatch):
    """Either side the smaller, blocks of a few edges, hubs, restarts outside of the graph and of weight 0."""
    import random

    monkeypatch.setattr(ppr, "RUN", 8)
    rng = random.Random(5)
    for passages, concepts in ((60, 15), (15, 60)):
        monkeypatch.setattr(ppr, "DIRECT", 0 if passages > concepts else 1 << 17)
        rows = [(f"p{int(passages * rng.random() ** 2)}", f"c{int(concepts * rng.random() ** 2)}", 1.0) for _ in range(200)] + [("x1", "y1", 1.0), ("x1", "y2", 1.0)]
        edges = spark.createDataFrame(rows, EDGE).repartition(3)
        asked = [(q, f"c{rng.randrange(concepts)}", rng.random()) for q in range(7) for _ in range(3)] + [(7, "y1", 1.0), (7, "nowhere", 1.0), (8, "c0", 0.0), (8, "y2", 2.0), (9, "nowhere", 1.0), (10, "c1", 0.0)]
        start = spark.createDataFrame(asked, "query_id int, concept_id string, weight double")
        stored = ppr.store(ppr._pairs(edges))
        assert stored.by_concept == (passages > concepts) and stored.nodes == edges.select("concept_id" if stored.by_concept else "passage_id").distinct().count()
        for alpha, most in ((0.15, 4),):
            got, want = ({(r.query_id, r.passage_id): r.score for r in ppr.ppr(edges, start, alpha, max_iter=most, kernel_bytes=k).collect()} for k in (1 << 20, 0))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), (alpha, most)
        best = {(r.query_id, r.passage_id, r.rank) for r in R.top_k(ppr.ppr(edges, start, max_iter=9, top=3), 3).collect()}
        assert best == {(r.query_id, r.passage_id, r.rank) for r in R.top_k(ppr.ppr(edges, start, max_iter=9), 3).collect()}
        for alpha in (0.15, 1.0) if stored.by_concept else (0.15,):
            got, want = ({(r.query_id, r.iteration, r.rank, r.converged, r.side, r.node): (r.score, r.diff) for r in ppr.trace(edges, start, alpha, max_iter=2, kernel_bytes=k).collect()} for k in (1 << 20, 0))
            assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k])), alpha


def test_an_even_last_step_is_not_walked_by_joins(spark, monkeypatch):
    edges = spark.createDataFrame([("p1", "a", 1.0), ("p1", "b", 1.0), ("p2", "b", 1.0)], EDGE)
    made = []
    monkeypatch.setattr(ppr, "cut", lambda df: made.append(1) or df)
    ppr.relational(ppr._pairs(edges), spark.createDataFrame([(1, "a", 1.0)], "query_id int, concept_id string, mass double"), 0.15, 4)
    assert len(made) == 2 + 3


def test_terms_met_in_long_texts_by_id(spark, monkeypatch):
    """Both ways, sent to every task and joined; ids come instead of texts, so that no text moves with a term."""
    texts = [(0, "the harbour report \U0001f600 on networks"), (1, "networks"), (2, "x" * 30 + "harbour"), (3, ""), (4, "étude harbou")]
    terms = ["harbour", "networks", "étude", "\U0001f600 on", "absent", "ha"]
    inner, outer = spark.createDataFrame([(t,) for t in terms], "t string"), spark.createDataFrame([(t, i) for i, t in texts], "c string, h bigint")
    want = {(t, i) for t in terms for i, text in texts if t in text}
    for most in (contain.KEYS_BYTES, 0):
        monkeypatch.setattr(contain, "KEYS_BYTES", most)
        for prefix in (5, 12):
            assert sorted((r.inner, r.h) for r in contain.contained(inner, outer, prefix, long=True).collect()) == sorted(want)


def test_a_product_takes_memory_of_its_slab_only():
    import tracemalloc

    rng = np.random.default_rng(1)
    x, q, boost = rng.normal(size=(1500, 4)), rng.normal(size=(4, 30_000)), np.linspace(1, 1.1, 1500)
    tracemalloc.start()
    found = sum(len(i) for i, _, _ in vectors.products(x, q, boost, 12.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == ((x[:700] @ q * boost[:700, None]) >= 12.0).sum() + ((x[700:] @ q * boost[700:, None]) >= 12.0).sum() > 0
    assert peak < 100e6  # all queries at once took 1024 * 30000 * 8 bytes, twice


def test_tasks_of_components_and_pairs_do_not_grow_with_the_rows(spark, monkeypatch):
    from quillgraph import session
    from quillgraph.operators import components

    seen, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "PART_ROWS", 10)
    for module in (components, dedup):
        monkeypatch.setattr(module, "cut", lambda df: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or session.cut(df))
    edges = spark.createDataFrame([(f"p{i // 3}", f"c{i % 3}") for i in range(90)], "passage_id string, concept_id string")
    assert components.connected_components(edges, "passage_id", "concept_id").select("component").distinct().count() == 1
    assert min(seen) == 9 and max(seen) == 18
    seen.clear()
    assert [(r.a, r.b, r.jaccard) for r in dedup.jaccard_pairs(edges, 0.5).orderBy("a", "b").collect()] == [("c0", "c1", 1.0), ("c0", "c2", 1.0), ("c1", "c2", 1.0)]
    assert seen == [9, 9] and spark.conf.get("spark.sql.shuffle.partitions") == was
