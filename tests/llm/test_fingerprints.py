import random

import numpy as np
from quillgraph.llm import fingerprints, kernel

from . import corpus
from .test_neardup import components, data, rows


def shingle_sets(rows):
    sets, order = {}, {}
    for d, t, *_ in rows:
        for w in kernel.words([t]):
            sh, _ = kernel.shingles(w, fingerprints.SHINGLE)
            sets[d], order[d] = set((sh >> np.uint64(32)).tolist()), tuple(w.hash.tolist())
    return sets, order


def brute(data, least):
    """Rows of ``near`` from the Jaccard of all pairs."""
    sets, order = shingle_sets(data)
    alike = lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0
    near = [(a, b) for a in sets for b in sets if a != b and (order[a] == order[b] or alike(a, b))]
    out = set()
    for group in components(list(sets), near):
        for i in group:
            same = [j for j in sets if order[j] == order[i]]
            links = {order[j] for j in sets if order[j] != order[i] and alike(i, j)}
            out.add((i, group[0], min(same), len(group), len(links)))
    return out


def test_rows_equal_brute_force(spark):
    docs = data()
    want = brute(docs, fingerprints.JACCARD)
    got = rows(fingerprints.near(corpus.frame(spark, docs)))
    assert got == want  # of pairs at the threshold one in a hundred may share no band; these don't
    assert rows(fingerprints.near(corpus.frame(spark, docs), broadcast_ids=3)) == got
    assert rows(fingerprints.near(corpus.frame(spark, docs), block=3, block_bytes=4000)) == got


def test_intersections_are_exact():
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 300, n).astype(np.uint32)) for n in rng.integers(1, 200, 30)] for _ in range(2))
    got = fingerprints.intersections(a, b, 50)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_edges_of_the_input(spark):
    long = corpus.text(random.Random(1), "en", 30000)
    data = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "one two three", "en", "a", 1), (3, "Word", None, None, None), (4, "word", "en", "a", 4),
        (5, long, "en", "a", 9), (6, long + " end", "en", "a", 9), (7, "same row here now", "en", "a", 3), (7, "same row here now", "en", "a", 3),
    ]
    df = corpus.frame(spark, data)
    for c in ("sig", "component", "node", "key", "n"):
        df = df.withColumn(c, fingerprints.F.lit(1))
    assert rows(fingerprints.near(df)) == {(3, 3, 3, 2, 0), (4, 3, 3, 2, 0), (5, 5, 5, 2, 1), (6, 5, 6, 2, 1)}
    assert fingerprints.near(df.limit(0)).count() == 0
