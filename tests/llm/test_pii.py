import itertools

import numpy as np
from quillgraph.llm import pii

from . import corpus


def test_held_out_entities():
    docs = pii.labelled_documents(300, seed=909)
    got = {(d, s, e, k) for d, s, e, k, _ in pii.find([t for t, _ in docs], pii.field())}
    want = {(d, *x) for d, (_, found) in enumerate(docs) for x in found}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_marginals_equal_brute_force_on_a_tree():
    rng = np.random.default_rng(3)
    f = pii.Field(rng.normal(size=(pii.ROWS, pii._L)), rng.normal(size=(3, pii._L, pii._L)))
    g = pii.Nodes([0] * 4, [(i, i + 1) for i in range(4)], [[i, 7] for i in range(4)], [[(0, 1), (1, 2)], [(1, 3)], []])
    p = f.marginals(g, 60)[0]
    theta, want = f.potentials(g.feats), np.zeros((4, pii._L))
    for y in itertools.product(range(pii._L), repeat=4):
        w = np.exp(sum(theta[i, y[i]] for i in range(4)) + f.pair[0][y[0], y[1]] + f.pair[0][y[1], y[2]] + f.pair[1][y[1], y[3]])
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(p, want / want.sum(1, keepdims=True), atol=1e-6)


def test_repeats_and_similar_tokens_are_linked():
    g = pii.nodes(["call 555-1234 the er 555-1234 of 555-9999", "555-1234"])
    assert g.edges[1] == [(0, 1)] and g.edges[2] == [(1, 2)] and g.edges[0] == []


def test_one_clear_mention_among_fifty_decides_all():
    """The clear one comes last; the others are bare numbers far from each other."""
    bare = " ".join("555-123-4567 " + "st er " * 20 for _ in range(50))
    alone = pii.find([bare], pii.field())
    found = pii.find([bare + " tel 555-123-4567"], pii.field())
    assert [k for *_, k, _ in found] == ["PHONE"] * 51
    assert not alone or min(p for *_, p in found) >= min(p for *_, p in alone)


def test_beliefs_on_a_loop_settle_near_the_exact_marginals():
    rng = np.random.default_rng(5)
    f = pii.Field(rng.normal(size=(pii.ROWS, pii._L)), 0.3 * rng.normal(size=(3, pii._L, pii._L)))
    g = pii.Nodes([0] * 3, [(i, i + 1) for i in range(3)], [[i] for i in range(3)], [[(0, 1), (1, 2)], [(0, 2)], []])
    theta, want = f.potentials(g.feats), np.zeros((3, pii._L))
    for y in itertools.product(range(pii._L), repeat=3):
        w = np.exp(sum(theta[i, y[i]] for i in range(3)) + f.pair[0][y[0], y[1]] + f.pair[0][y[1], y[2]] + f.pair[1][y[0], y[2]])
        for i in range(3):
            want[i, y[i]] += w
    assert np.abs(f.marginals(g)[0] - want / want.sum(1, keepdims=True)).max() < 0.02


def test_skip_edges_carry_a_clear_mention():
    m = pii.Field(pii.field().unary.copy(), pii.field().pair.copy())
    text = "tel 555-123-4567 er " + "st " * 500 + " 555-123-4567"
    assert [k for *_, k, _ in pii.find([text], m)] == ["PHONE", "PHONE"]
    assert m.pair[1].diagonal().mean() > (m.pair[1].sum() - m.pair[1].trace()) / (pii._L**2 - pii._L)


def test_clean_text_has_no_entity():
    for t in ("version 2.1 of 2021-11-05", "commit 0641917ea4e9feb9cda83477b57ac2654884f485", "the er 42 st 7", "chapter 12.4. page 310"):
        assert pii.find([t], pii.field()) == [], t


def test_edges_of_the_input(spark):
    mail = "die.55@mail4.example.com"
    long = "the words " * 30000 + mail
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (None, f"x {mail}. y", "en", None, 24), (3, long, "en", "a", len(long)), (5, f"é {mail}", "en", "a", 22), (5, f"é {mail}", "en", "a", 22)]
    df = corpus.frame(spark, rows).withColumn("kind", pii.F.lit(1)).withColumn("start", pii.F.lit("s"))
    got = sorted((r.doc_id or 0, r.start, r.end, r.kind) for r in pii.entities(df).collect())
    assert got == [(0, 2, 26, "EMAIL"), (3, 300000, 300024, "EMAIL"), (5, 2, 26, "EMAIL"), (5, 2, 26, "EMAIL")]
    assert pii.entities(df.limit(0)).count() == 0


def test_whole_documents_equal_any_batching():
    docs = [t for t, _ in pii.labelled_documents(40, seed=5)]
    one = [x for d, t in enumerate(docs) for x in [(d, *y[1:4]) for y in pii.find([t], pii.field())]]
    assert sorted(one) == sorted(x[:4] for x in pii.find(docs, pii.field()))
