"""The pipeline against a composition of plain stages on a small table."""

import random

import corpus_pipeline
import pytest
from quillgraph.llm import kernel, langid, neardup, packing, secretscan

from . import corpus
from .test_neardup import components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(12), tmp_path_factory.mktemp("sf")
    rows = corpus.rows(8, 80)
    items = [(i, corpus.text(rng, "en", 30)) for i in range(5)]
    n = 200
    for base in rows[:10]:
        for share in (0, 0.01):
            t = corpus.edited(rng, base[1], share)
            rows.append((n, t, base[2], "hot", len(t)))
            n += 1
    rows += [(300 + i, f"{corpus.text(rng, 'en', 50)} {items[i % 5][1]} {corpus.text(rng, 'en', 20)}", "en", "hot", 0) for i in range(8)]
    secret = "AKIA" + "ABCDEFGHIJKLMNOP"[::-1]
    rows += [(400 + i, f"{corpus.text(rng, 'de', 40)} {secret[:-1]}{i} {corpus.text(rng, 'de', 9)}", "de", "hot", 0) for i in range(5)]
    rows += [(500, None, "en", "hot", 0), (501, "", "en", "hot", 0), (502, "!!!", None, None, None), (503, corpus.text(rng, "es", 60), "de", "hot", 1), (None, corpus.text(rng, "es", 60), None, "hot", 1)]
    rows += [(504, rows[-2][1], "es", "hot", 1)] * 2
    df = corpus.frame(spark, rows).withColumn("score", corpus_pipeline.langid.F.lit("mine")).withColumn("language", corpus_pipeline.langid.F.lit("mine"))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def plain(rows, items, model, forest):
    """What each stage keeps, by definition."""
    scores = model.scores([r[1] for r in rows])
    kept = []
    for r, s in zip(rows, scores):
        order = sorted(range(len(s)), key=lambda k: (-s[k], k))
        name, margin = model.languages[order[0]], s[order[0]] - s[order[1]]
        contradicted = r[2] in model.languages and r[2] != name and margin >= langid.MIN_MARGIN
        if s.any() and s[order[0]] >= langid.MIN_SCORE and not contradicted:
            kept.append(r)
    stages = [kept]
    sig = {}
    for r in kept:
        for w in kernel.words([r[1]]) if r[0] is not None else []:
            sh, first = kernel.shingles(w, neardup.SHINGLE)
            sig[r[0]] = kernel.minhash(sh, first, neardup.COORDINATES, neardup.SEED)[0]
    near = [(a, b) for a in sig for b in sig if a < b and (sig[a] == sig[b]).sum() >= neardup.MATCHES]
    lost = {d for g in components(list(sig), near) for d in g[1:]}
    kept = [r for r in kept if r[0] not in lost]
    stages.append(kept)
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    kept = [r for r in kept if not any(words(t) in words(r[1]) for _, t in items)]
    stages.append(kept)
    clean = []
    for r in kept:
        t = r[1]
        for s, e, _ in reversed(secretscan.scan(t, forest)):
            t = t[:s] + "[SECRET]" + t[e:]
        clean.append((r[0], t, *r[2:4], len(t) if t != r[1] else r[4]))
    return [*stages, clean]


def test_stages_equal_their_definitions(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs)
    want = plain(rows, items, model, secretscan.forest())
    key = lambda r: repr(tuple(r[:5]))
    for (name, stage), rows_ in zip(corpus_pipeline.STAGES, want):
        columns = docs.columns
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        got = docs.collect()
        assert sorted(map(key, got)) == sorted(map(key, rows_)), name
        assert all(r.score == r.language == "mine" for r in got), name
        docs = spark.createDataFrame(got, docs.schema)
    assert len(want[0]) > len(want[1]) > len(want[2]) and want[2] != want[3] and len(want[3]) > 60
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    size = sum(len(r[1].encode()) + 1 for r in want[-1])
    assert sum(b.used for b in bins) == size and all(b.used <= packing.CAPACITY for b in bins)
    assert sorted(d or -1 for b in bins for d in b.doc_ids) == sorted(r[0] or -1 for r in want[-1])


def test_run_is_the_composition_of_the_stages(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        docs = spark.createDataFrame(out.collect(), out.schema)
    plain = lambda df: sorted((r.used, sorted(x or -1 for x in r.doc_ids)) for r in df.collect())
    assert plain(corpus_pipeline.run(spark, path)) == plain(docs)


def test_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
