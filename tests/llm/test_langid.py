import random

import numpy as np
from quillgraph.llm import langid

from . import corpus


def fitted(seed=0, n=40):
    rng = random.Random(seed)
    pairs = [(corpus.text(rng, lang, 60), lang) for lang in corpus.SYLLABLES for _ in range(n)]
    return langid.train([t for t, _ in pairs], [x for _, x in pairs], landmarks_per_language=10)


def test_held_out_accuracy():
    model, rng = fitted(), random.Random(99)
    truth = [lang for lang in corpus.SYLLABLES for _ in range(50)]
    scores = model.scores([corpus.text(rng, lang, 30) for lang in truth])
    assert (np.array(model.languages)[scores.argmax(1)] == truth).mean() >= 0.98


def test_scores_equal_explicit_kernels():
    """The product with folded weights equals kernels with every landmark times the regression's weights."""
    rng = random.Random(4)
    texts = [corpus.text(rng, lang, 40) for lang in corpus.SYLLABLES for _ in range(8)]
    labels = [lang for lang in corpus.SYLLABLES for _ in range(8)]
    model = langid.train(texts, labels, landmarks_per_language=8)

    def grams(t, n):
        s = model.symbols(langid.fold(t))
        return {tuple(s[i : i + n]) for i in range(len(s) - n + 1)}

    def k(a, b):
        return np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2, 3)])

    gram = np.array([[k(a, b) for b in texts] for a in texts])
    y = (np.array(labels)[:, None] == np.array(model.languages)).astype(float)
    value, vector = np.linalg.eigh(gram)
    root = vector / np.sqrt(value)
    z = gram @ root
    beta = root @ np.linalg.solve(z.T @ z + 1e-2 * len(texts) / 100 * np.eye(len(texts)), z.T @ y)
    new = [corpus.text(rng, lang, 25) for lang in corpus.SYLLABLES]
    want = np.array([[k(a, b) for b in texts] for a in new]) @ beta
    assert np.allclose(model.scores(new), want, atol=1e-3)


def test_landmarks_are_a_cut_of_the_kernel():
    """With few landmarks the scores equal regression on the explicit Nystrom features of the kernel over the landmarks' n-grams."""
    rng = random.Random(6)
    texts = [corpus.text(rng, lang, 30) for lang in corpus.SYLLABLES for _ in range(12)]
    labels = [lang for lang in corpus.SYLLABLES for _ in range(12)]
    model = langid.train(texts, labels, landmarks_per_language=3)
    grams = lambda t, n: {c for c in model.presence(langid.fold(t))[n].tolist()}
    known = [set(v.tolist()) for v in model.vocabulary]

    def k(a, b):
        return np.mean([len(grams(a, n) & grams(b, n) & known[n]) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in range(3)])

    land = [t for lang in corpus.SYLLABLES for t in texts[labels.index(lang) :][:3]]
    value, vector = np.linalg.eigh(np.array([[k(a, b) for b in land] for a in land]))
    root = vector / np.sqrt(value)
    z = np.array([[k(a, b) for b in land] for a in texts]) @ root
    y = (np.array(labels)[:, None] == np.array(model.languages)).astype(float)
    beta = root @ np.linalg.solve(z.T @ z + 1e-2 * len(texts) / 100 * np.eye(z.shape[1]), z.T @ y)
    new = [corpus.text(rng, lang, 25) for lang in corpus.SYLLABLES]
    assert np.allclose(model.scores(new), np.array([[k(a, b) for b in land] for a in new]) @ beta, atol=1e-3)


def test_rows_of_keep_and_accept_are_the_same_and_right(spark):
    data = corpus.rows(5, 120)
    wrong = [(1000 + i, corpus.text(random.Random(i), "es", 80), "de", "x", 9) for i in range(10)]
    df = corpus.frame(spark, data + wrong)
    for c in ("language", "score", "margin"):
        df = df.withColumn(c, langid.F.lit("mine"))
    model = langid.fit(corpus.frame(spark, data))
    kept = langid.keep(df, model)
    assert kept.columns == df.columns and kept.where("language = 'mine' AND score = 'mine' AND margin = 'mine'").count() == kept.count()
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in langid.accept(df, model).collect()} == {r[0] for r in data}
    found = langid.identify(df, model, carry=["doc_id"]).collect()
    truth = {r[0]: r[2] for r in data} | {r[0]: "es" for r in wrong}
    assert sum(r.language == truth[r.doc_id] for r in found) >= 0.98 * len(truth)


def test_edges_of_the_input(spark):
    model, rng = fitted(), random.Random(8)
    long = corpus.text(rng, "de", 40000)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "!!! ###", None, None, None), (None, corpus.text(rng, "es", 50), None, "a", 1),
        (4, long, "de", "a", 9), (5, corpus.text(rng, "en", 50), "de", "a", 1), (6, "the and", "xx", "a", 1), (6, "the and", "xx", "a", 1),
    ]
    df = corpus.frame(spark, rows).withColumn("score", langid.F.lit("mine"))
    got = langid.identify(df, model).collect()
    assert [r.language for r in sorted(got, key=lambda r: r.doc_id or 0)][:3] == ["es", None, None]
    kept = langid.accept(df, model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 6, 6]  # 5 says de and is en
    assert sorted(r.doc_id or 0 for r in langid.keep(df, model).collect()) == [0, 4, 6, 6]
    assert langid.accept(df.limit(0)).count() == 0 == langid.keep(df.limit(0)).count()
    assert langid.accept(df.where("doc_id = 1")).count() == 0  # nothing to learn from
