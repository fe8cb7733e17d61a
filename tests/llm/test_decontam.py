import math
import random

import numpy as np
from quillgraph.llm import decontam

from . import corpus


def items(rng, n=30):
    return [(i, corpus.text(rng, rng.choice(["en", "de"]), rng.randint(3, 60))) for i in range(n)]


def plain_scores(pairs, passage):
    """BM25 of a passage's distinct terms for each item, as a part of the item's own score."""
    toks = [decontam.tokens_of([t])[0].tolist() for _, t in pairs]
    mean = sum(map(len, toks)) / len(toks)
    out = []
    for t in toks:
        w = {}
        for x in set(t):
            d = sum(x in set(u) for u in toks)
            tf = t.count(x)
            w[x] = math.log(1 + (len(toks) - d + 0.5) / (d + 0.5)) * tf * (decontam.K1 + 1) / (
                tf + decontam.K1 * (1 - decontam.B + decontam.B * len(t) / mean)
            )
        out.append(sum(v for x, v in w.items() if x in passage) / sum(w.values()))
    return out


def test_wand_returns_exactly_the_items_above_the_threshold():
    rng = random.Random(2)
    pairs = items(rng)
    (index,) = decontam.build(pairs)
    found = 0
    for _ in range(150):
        parts = rng.sample(pairs, 3)
        ws = sum((t.split()[: rng.randint(1, 60)] for _, t in parts), corpus.words(rng, "en", 20))
        passage = set(decontam.tokens_of([" ".join(ws)])[0].tolist())
        _, terms = index._find(index.terms, np.array(sorted(passage), np.uint64))
        got = dict(index.wand(np.unique(terms)))
        want = {i: s for i, s in enumerate(plain_scores(pairs, passage)) if s >= decontam.MIN_SCORE - 1e-9}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
        found += len(got)
    assert found > 100


def documents(rng, pairs):
    docs, truth = [], set()
    for d in range(40):
        ws = corpus.words(rng, "en", rng.randint(0, 500))
        for i, t in rng.sample(pairs, rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(ws))
            ws[at:at] = t.split()
            truth.add((d, i))
        t = " ".join(ws)
        docs.append((d, t, "en", "s", len(t)))
    return docs, truth


def test_quotes_are_found_anywhere_in_a_text(spark):
    rng = random.Random(6)
    pairs = [(i, corpus.text(rng, "de", rng.choice([6, 20, 60, 90, 300]))) for i in range(20)]
    docs, truth = documents(rng, pairs)
    df, bench = corpus.frame(spark, docs), spark.createDataFrame(pairs, "item_id bigint, text string")
    got = decontam.hits(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= truth
    plain = {d: set(decontam.tokens_of([t])[0].tolist()) for d, t, *_ in docs}
    for r in got:  # anything else must share most of the item too
        item = set(decontam.tokens_of([dict(pairs)[r.item_id]])[0].tolist())
        assert len(item & plain[r.doc_id]) / len(item) > 0.4
    sharded = decontam.hits(df, bench, per_index=7).collect()
    assert {(r.doc_id, r.item_id) for r in sharded} == {(r.doc_id, r.item_id) for r in got}
    kept = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert kept == {d for d, *_ in docs} - {r.doc_id for r in got}


def test_edges_of_the_input(spark):
    bench = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon"), (3, "solo"), (4, "eta theta iota kappa"), (4, "eta theta iota kappa")]
    long = "filler words " * 30000 + "eta theta iota kappa"
    docs = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "Alpha, beta gamma: delta epsilon!", None, None, None),
        (3, "nothing here", "en", "a", 1), (4, long, "en", "a", 1), (4, long, "en", "a", 1), (5, "Solo", "en", "a", 1),
    ]
    df = corpus.frame(spark, docs).withColumn("score", decontam.F.lit(0)).withColumn("item_id", decontam.F.lit("x"))
    b = spark.createDataFrame(bench, "item_id bigint, text string").withColumn("doc_id", decontam.F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontam.hits(df, b).collect()}
    assert got == {(None, None), (4, 4), (5, 3)}
    kept = decontam.clean(df, b)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert decontam.hits(df, b.limit(0)).count() == 0 == decontam.hits(df.limit(0), b).count()
    assert decontam.clean(df, b.limit(0)).count() == 7


def test_runs_of_passages_of_any_size_find_the_same(monkeypatch):
    rng = random.Random(9)
    pairs = [(i, corpus.text(rng, "en", rng.randint(5, 50))) for i in range(400)]
    docs, truth = documents(rng, pairs)
    found = []
    for cells in (1 << 19, 300):
        monkeypatch.setattr(decontam, "CELLS", cells)
        got = set()
        for index in decontam.build(pairs):
            for w in decontam.kernel.words([t for _, t, *_ in docs]):
                got |= {(w.lo + d, index.ids[i], round(s, 9)) for d, i, s, _, _ in index.search(w)}
        found.append(got)
    assert found[0] == found[1] and {x[:2] for x in found[0]} >= truth
