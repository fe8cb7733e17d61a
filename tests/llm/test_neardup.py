import random

import numpy as np
from quillgraph.llm import kernel, neardup, pairs

from . import corpus


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    groups = {}
    for i in set(ids):
        groups.setdefault(find(i), []).append(i)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def brute(sigs, t):
    """Rows of ``near`` from all pairs of documents with at least t equal coordinates."""
    alike = lambda a, b: sum(x == y for x, y in zip(a, b)) >= t
    near = [(i, j) for i, s in sigs for j, r in sigs if i != j and alike(s, r)]
    classes = {}
    for i, s in sigs:
        classes.setdefault(tuple(s), []).append(i)
    out = set()
    for group in components([i for i, _ in sigs], near):
        for i in group:
            s = tuple(dict(sigs)[i])
            links = sum(1 for r in classes if r != s and alike(r, s))
            out.add((i, group[0], min(classes[s]), len(group), links))
    return out


def rows(df):
    return {(r.doc_id, r.group_id, r.class_id, r.n_docs, r.n_links) for r in df.collect()}


def data():
    rng = random.Random(3)
    rows = corpus.rows(3, 40)
    n = 100
    for base in rows[:6]:
        for _ in range(rng.randint(1, 12)):
            t = corpus.edited(rng, base[1], rng.choice([0, 0.01, 0.03, 0.1]))
            rows.append((n, t, base[2], "src0", len(t)))
            n += 1
    return rows


def test_rows_equal_brute_force(spark):
    df = corpus.frame(spark, data())
    sigs = [(r.doc_id, r.sig) for r in neardup.signatures(df).collect()]
    for t, block in ((20, 1024), (32, 3), (60, 1024)):
        got = rows(neardup.near(df, matches=t, block=block))
        assert got == brute(sigs, t)
        assert got


def test_a_list_of_any_length_is_compared_whole(spark):
    """One long list in one block, and in many."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 30, 64)
    sigs = []
    for i in range(120):
        s = base.copy()
        s[1 + rng.choice(63, rng.integers(0, 60), replace=False)] = rng.integers(0, 1 << 30)
        sigs.append((i, s.tolist()))
    one = spark.createDataFrame(sigs, "node bigint, sig array<int>")
    want = {}
    for a, s in sigs:
        for b, r in sigs:
            if a != b and sum(x == y for x, y in zip(s, r)) >= 32:
                want[a] = want.get(a, 0) + 1
    for block in (5, 16, 1000):
        edges, links = pairs.collide(neardup.merged(one, 32), 64, 32, block)
        assert {r.node: r.n_links for r in links.collect()} == want
        linked = [(r.src, r.dst) for r in edges.collect()]
        assert components(range(120), linked) == components(range(120), [(a, b) for a in want for b in want if a < b and sum(x == y for x, y in zip(sigs[a][1], sigs[b][1])) >= 32])


def test_edges_of_the_input(spark):
    long = corpus.text(random.Random(1), "en", 30000)
    data = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "!!!", None, None, None), (None, "one two three four", "en", "a", 1),
        (4, "Word", "en", "a", 4), (5, "word", "en", "a", 4), (6, long, "en", "a", 9), (7, long + " end", "en", "a", 9),
        (8, "same row here now", "en", "a", 3), (8, "same row here now", "en", "a", 3),
    ]
    df = corpus.frame(spark, data)
    for c in ("sig", "key", "node", "n", "side", "group_id"):
        df = df.withColumn(c, neardup.F.lit(1))
    assert rows(neardup.near(df)) == {(4, 4, 4, 2, 0), (5, 4, 4, 2, 0), (6, 6, 6, 2, 0), (7, 6, 6, 2, 0)}  # one shingle in 30,000 changes no coordinate
    for limit in (1000, 1):
        kept = neardup.drop_near(df, broadcast_ids=limit)
        assert kept.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, x) for x in (1, 2, 3, 4, 6, 8, 8)]
        assert kept.where("doc_id IS NULL").count() == 1
    assert neardup.near(df.limit(0)).count() == 0


def test_signature_estimates_jaccard():
    rng = random.Random(5)
    a = corpus.words(rng, "en", 400)
    b = a[:300] + corpus.words(rng, "de", 100)
    sets, sigs = [], []
    for w in kernel.words([" ".join(a), " ".join(b)]):
        sh, first = kernel.shingles(w, 3)
        sets = [set(sh[first[i] : first[i + 1]].tolist()) for i in range(2)]
        sigs = kernel.minhash(sh, first, 512, 1)
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((sigs[0] == sigs[1]).mean() - true) < 0.08


def test_words_equal_a_plain_split():
    import re

    texts = ["Hello, wörld 42!", None, "", "  a\tb c ", "É" * 50]
    want = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    for w in kernel.words(texts):
        got = [[w.buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
        assert got == want
        by = {}
        for t, h in zip(sum(got, []), w.hash):
            assert by.setdefault(t, h) == h
        assert len(set(by.values())) == len(by)
    assert np.array_equal(kernel.runs(np.array([1, 1, 3])), [0, 2, 3])
