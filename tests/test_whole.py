"""Queries over whole tables, held against brute force on small fixtures."""

import random

from quillgraph.plans.catalogue import QUERIES


def walked(edges, start, alpha=0.15, tol=1e-6, most=100):
    """Power iteration on dictionaries, as long as a step changes more than ``tol``."""
    near = {}
    for p, c in edges:
        near.setdefault(("p", p), set()).add(("c", c))
        near.setdefault(("c", c), set()).add(("p", p))
    r = {("c", c): 1 / len(start) for c in start}
    v = dict(r)
    for _ in range(most):
        new = {n: alpha * r.get(n, 0.0) for n in near}
        for n, mass in v.items():
            for m in near[n]:
                new[m] += (1 - alpha) * mass / len(near[n])
        change = sum(abs(new[n] - v.get(n, 0.0)) for n in near)
        v = new
        if change < tol:
            break
    return {n[1]: s for n, s in v.items() if n[0] == "p" and s > 0}


def test_pagerank_of_every_size_runs_to_its_tolerance(spark, tmp_path):
    rng = random.Random(3)
    parts = [(k, rng.choice([1, 3, 7, 20, 50])) for k in range(1, 25)]
    lines = [(rng.randint(1, 30), rng.randint(1, 22)) for _ in range(70)]
    spark.createDataFrame(parts, "p_partkey int, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey int, l_partkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {}
    for r in QUERIES["ppr_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.passage_id, r.score))
    held = {c for _, c in lines}
    sizes = {s for k, s in parts if k in held}
    assert got.keys() == sizes and max(sizes) > 4
    for size in sizes:
        want = walked(set(lines), [k for k, s in parts if s == size and k in held])
        best = sorted(want.values(), reverse=True)[:10]
        rows = sorted(got[size])
        assert len(rows) == len(best)
        assert all(abs(score - b) < 2e-6 and abs(score - want[p]) < 2e-6 for (_, p, score), b in zip(rows, best))


def test_flagship_matches_concepts_in_part(spark, tmp_path):
    texts = ["Rebuilding networks slowly", "networks of Rebuilding teams", "plain harbour report", "the harbour report again", "distant mountain village", "mountain village school"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(1, "network"), (2, "harbourside"), (3, "mountain"), (4, "nothing")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = lambda name: {(r.query_id, r.concept_id) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    concepts = {"rebuilding", "networks", "harbour", "report", "mountain", "village"}
    assert pairs("match_exact") == {(i, q) for i, q in asked if q in concepts} == {(3, "mountain")}
    assert pairs("match_partial") == {(i, c) for i, q in asked for c in concepts if q in c or c in q}
    got = {}
    for r in QUERIES["flagship_retrieval"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.passage_id, r.score > 0, r.content == texts[r.passage_id], r.matched_concepts))
    assert {q: {p for _, p, some, *_ in rows if some} for q, rows in got.items()} == {1: {0, 1}, 2: {2, 3}, 3: {4, 5}}
    # the other passages fill the ranking with score 0, in their order
    assert [p for _, p, *_ in sorted(got[2])][2:] == [0, 1, 4, 5] and all(same for rows in got.values() for *_, same, _ in rows)
    assert {tuple(m) for _, p, *_, m in got[2] if p == 2} == {("harbour",)}


def test_mention_band_counts_every_kind(spark, tmp_path):
    texts = [
        "In 2024 the Acme Corporation paid $5 million, up 12 percent.", "Acme Corporation and IBM in 2024", "user-friendly camelCase of IBM", "a user-friendly camelCase would should",
        "Revenue revenue networks", "networks of harbour", "plain", "paid $5 million and 12 percent", "nothing here", "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.concept_id: r.n for r in QUERIES["concept_frequency_band"](spark, str(tmp_path)).collect()}
    # Counted by hand: entity and concept rows add up ("acme corporation" is both, and the capitalised phrase an entity of the same surface);
    # "revenue" is one entity row and one concept row. Stop words among the long words are left out.
    assert got == {"2024": 2, "acme corporation": 4, "corporation": 2, "$5 million": 2, "million": 2, "12 percent": 2, "percent": 2, "user-friendly": 2, "friendly": 2, "camelcase": 4, "revenue": 2, "networks": 2}
