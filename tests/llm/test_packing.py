import random

from quillgraph.llm import packing

from . import corpus


def naive(sizes, capacity):
    left, bins = [], []
    for i, s in enumerate(sizes):
        fit = [(r, b) for b, r in enumerate(left) if r >= s]
        if fit:
            _, b = min(fit)
            bins[b].append(i)
            left[b] -= s
        else:
            left.append(capacity - s)
            bins.append([i])
    return bins


def test_best_fit_opens_as_many_bins_as_a_scan_of_all_bins():
    rng = random.Random(0)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
        got, want = packing.best_fit(sizes, 100), naive(sizes, 100)
        fill = lambda bins: sorted(sum(sizes[i] for i in b) for b in bins)
        assert fill(got) == fill(want)
        assert sorted(i for b in got for i in b) == list(range(200))


def check(rows, docs, capacity):
    """Every byte of every document is in exactly one bin, once for each row of the table."""
    need = {}
    for d, t, *_ in docs:
        if t is not None:
            need.setdefault(d, []).append(len(t.encode()) + 1)
    got = {}
    for r in rows:
        assert r.used == sum(r.lengths) <= capacity and r.n_pieces == len(r.doc_ids) == len(r.starts)
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            got.setdefault(d, []).append((s, n))
    assert got.keys() == need.keys()
    for d, spans in got.items():
        assert sorted(n for s in need[d] for n in [min(capacity, s - at) for at in range(0, s, capacity)]) == sorted(n for _, n in spans)
        assert sorted(at for s in need[d] for at in range(0, s, capacity)) == sorted(s for s, _ in spans)
    assert len({r.bin_id for r in rows}) == len(rows)


def test_round_trip_and_fill_over_several_levels(spark):
    docs = corpus.rows(4, 400)
    df = corpus.frame(spark, docs)
    rows = packing.pack(df, capacity=2000, per_part=30, fan_in=3).collect()
    check(rows, docs, 2000)
    assert max(int(r.bin_id.split("-")[0]) for r in rows) >= 2
    least = sum(len(d[1].encode()) + 1 for d in docs) / 2000
    assert len(rows) <= 1.1 * least + 1
    again = packing.pack(df.repartition(7), capacity=2000, per_part=30, fan_in=3).collect()
    assert sorted(rows) == sorted(again)


def test_edges_of_the_input(spark):
    docs = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "x", None, None, None), (3, "é" * 5000, "en", "a", 1), (4, "ab", "en", "a", 2), (4, "ab", "en", "a", 2)]
    df = corpus.frame(spark, docs).withColumn("part", packing.F.lit("p")).withColumn("used", packing.F.lit("u"))
    check(packing.pack(df).collect(), docs, packing.CAPACITY)
    assert packing.pack(df.limit(0)).count() == 0
