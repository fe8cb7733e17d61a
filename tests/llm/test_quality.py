import math
import random
from collections import Counter, defaultdict

import numpy as np
from quillgraph.llm import quality

from . import corpus


def brute(texts):
    """Interpolated modified Kneser-Ney of order 5 over characters, by the formulas."""
    grams = Counter()
    for t in texts:
        s = "\0" * 4 + t
        grams.update(s[i : i + 5] for i in range(len(t)))
    tables = {5: grams}
    for k in range(4, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    info = {}
    for k, t in tables.items():
        n = [sum(c == x for c in t.values()) for x in (1, 2, 3, 4)]
        d = quality.discounts(n)
        total, off = defaultdict(int), defaultdict(float)
        for g, c in t.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        info[k] = (t, d, total, off)

    def p(g):
        if not g:
            return 2.0**-21
        t, d, total, off = info[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        c = t.get(g, 0)
        seen = c - d[min(c, 3) - 1] if c else 0
        return seen / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * p(g[1:])

    return lambda text: -sum(math.log(p(("\0" * 4 + text)[i : i + 5])) for i in range(len(text)))


def fixture(spark, n=60):
    data = corpus.rows(3, n)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in data if r[0] % 3], "doc_id bigint, quality int, toxic int")
    return data, corpus.frame(spark, data), labels


def test_scores_equal_brute_force_whatever_the_shards(spark):
    data, docs, labels = fixture(spark)
    counts = quality.count(docs, quality.trusted_ids(labels))
    joined = quality.count(docs, quality.trusted_ids(labels), limit=1)
    assert sorted(counts.collect()) == sorted(joined.collect())
    grams, contexts = quality.levels(counts)
    model = brute([r[1] for r in data if r[0] % 3])
    for rows in (1 << 20, 700):
        stored = quality.store(grams, contexts, rows)
        assert stored.of > 1 or rows > 700
        got = {r.doc_id: r.nll for r in quality.score(docs.repartition(3), stored).collect()}
        for i, t, *_ in data:
            assert abs(got[i] - model(t)) < 1e-3 * len(t), (rows, i)


def test_probabilities_sum_to_one(spark):
    _, docs, labels = fixture(spark, 20)
    model = quality.store(*quality.levels(quality.count(docs, quality.trusted_ids(labels))))
    for context in ("the ", "qqqq", "\0\0\0t"):
        a, b, c, d = map(ord, context)
        last = np.arange(1 << quality.BITS)
        p = model.log_p(np.full(len(last), a << 21 | b), (c << 42 | d << 21) + last)
        assert abs(np.exp(p).sum() - 1) < 1e-4


def test_parts_of_long_texts_give_the_same_ngrams():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab 日語😀") for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None, ""]
    grams = lambda size: sorted(
        (i, int(h), int(x)) for p in quality.parts(texts, size) for hi, lo, at in [quality.codes(p)] for (i, *_), a, b in zip(p, at, at[1:]) for h, x in zip(hi[a:b], lo[a:b])
    )
    want = []
    for i, t in enumerate(texts):
        s = [0] * 4 + [ord(c) for c in t or ""]
        want += [(i, s[j] << 21 | s[j + 1], s[j + 2] << 42 | s[j + 3] << 21 | s[j + 4]) for j in range(len(t or ""))]
    assert grams(5) == grams(17) == grams(1 << 20) == sorted(want)


def test_every_character_counts_whatever_its_script(spark):
    """Trusted Chinese text tells its own characters from others."""
    rng = random.Random(4)
    write = lambda letters: "".join(rng.choice(letters) for _ in range(300))
    data = [(i, write("的一是不了人我在有他"), "zh", "a", 300) for i in range(60)] + [(100 + i, write("鑫森淼焱垚犇猋骉羴鱻"), "zh", "a", 300) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep(corpus.frame(spark, data), labels).collect()}
    assert len(kept & set(range(60))) >= 58 and not kept & set(range(100, 110))


def test_junk_goes_and_clean_stays(spark):
    data = corpus.rows(7, 400)
    rng = random.Random(1)
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "%%%", "$$"]) for w in corpus.words(rng, r[2], 60)), r[2], "x", 9) for i, r in enumerate(data[:30])]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in data if r[0] % 2], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep(corpus.frame(spark, data + junk), labels).collect()}
    assert len(kept & {r[0] for r in data}) >= 0.97 * len(data) and not kept & {r[0] for r in junk}


def test_edges_of_the_input(spark):
    long = "the words " * 30000
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (None, "some text", "en", None, 9), (3, long, "en", "a", 1), (5, "日本語 text", None, "a", 8), (5, "日本語 text", None, "a", 8)]
    df = corpus.frame(spark, rows).withColumn("quality", quality.F.lit("x")).withColumn("n", quality.F.lit(1))
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert [r.doc_id for r in quality.trusted_ids(labels).collect()] == [3]
    for of in (labels, labels.limit(0)):
        assert sorted(r.doc_id or 0 for r in quality.keep(df, of).collect()) == [0, 3, 5, 5]
    assert quality.keep(df.limit(0), labels).count() == 0
    several = quality.keep(df, labels, shard_rows=5)
    assert sorted(r.doc_id or 0 for r in several.collect()) == [0, 3, 5, 5]
