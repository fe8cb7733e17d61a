"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters, of order 5, and is counted on all trusted text:
the documents that every label row calls good, but for a fifth of them
(chosen by a hash of the id) that sets the thresholds. Every code point is a
character of its own: an n-gram is a pair of integers, ``hi`` of its first two
characters and ``lo`` of its last three, 21 bits each; each text begins with
four zeros.

* Counts: each partition counts its n-grams in numpy and sends one row for
  each of them; Spark adds them up. Continuation counts of the lower orders
  are counts of the distinct longer n-grams.
* Each order has three discounts, from its counts of counts. Probabilities are
  joined up order by order in Spark: an n-gram with the sum of its context and
  with its suffix.
* The model is written to the shared folder in shards of about ``SHARD_ROWS``
  rows. The shard of an n-gram follows from the two characters before its last
  one, which also decide all contexts and suffixes that are looked up for it
  (those of one or two characters are in a shard that all use), so a shard is
  enough for the n-grams that it owns.
* Scoring is one pass over the documents. A task counts the distinct n-grams
  of a block of about ``BLOCK_CHARS`` characters and joins them with one shard
  after the other, read from the shared folder; a worker keeps as many shards
  as fit into ``CACHE_BYTES``. Nothing of the model is on the driver.
* A document is kept if its perplexity is at most the threshold of its
  language: the ``QUANTILE`` of its held-out trusted documents, times ``SLACK``.
  Perplexities are shrunk towards the language's mean by ``PRIOR``
  characters, so that a few words don't decide.

Long texts are worked on in parts of ``PART_CHARS`` characters, each with the
four before it; the sums are the same.

Defined results: null and empty texts have no perplexity and are not kept; a
null id is kept as null and never trusted; a null language is a language of
its own; a language without held-out trusted text, and every language if
nothing is trusted, has no threshold (null) and keeps all. Repeated rows stay
repeated. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, shared_dir, written
from . import ids as idset
from .kernel import mix

ORDER, BITS = 5, 21
HELD_OUT, QUANTILE, SLACK, PRIOR = 5, 0.99, 1.1, 60
#: Most rows of a shard of the model, for n-grams and for contexts.
SHARD_ROWS = 4_000_000
#: Characters of a part of a text, characters whose n-grams a task scores at once, and bytes of shards that a worker keeps.
PART_CHARS, BLOCK_CHARS, CACHE_BYTES = 1 << 18, 1 << 22, 128 << 20
_LOOKED_UP, _ROWS = 1 << 17, 512  # n-grams looked up, and texts unpacked, at once
_HELD: int = 1 << 20  # entries that a counting task holds before it adds them up
_ONE, _TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1


def parts(texts: list[str | None], size: int = PART_CHARS) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of ``(text number, piece, characters of it that are context only)``, about ``size`` characters each."""
    out, n = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, len(t or ""), size):
            before = min(lo, ORDER - 1)
            out.append((i, t[lo - before : lo + size], before))
            n += len(out[-1][1])
            if n >= size:
                yield out
                out, n = [], 0
    if out:
        yield out


def codes(pieces: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hi`` and ``lo`` of the n-gram that ends at each character of some pieces, and where each piece begins."""
    raw = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for _, t, _ in pieces]
    before = np.array([b for *_, b in pieces], np.int64)
    size = np.array([len(r) for r in raw], np.int64)
    pad = ORDER - 1
    end = np.cumsum(size + pad)
    chars = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    start = end - size  # of the pieces in chars
    flat = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    chars[np.arange(len(flat)) + np.repeat((np.arange(len(raw)) + 1) * pad, size)] = flat
    kept = size - before
    at = np.concatenate(([0], np.cumsum(kept)))
    place = np.arange(at[-1]) + np.repeat(start + before - at[:-1], kept)
    hi = chars[place - 4] << BITS | chars[place - 3]
    return hi, chars[place - 2] << 2 * BITS | chars[place - 1] << BITS | chars[place], at


def part_of(hi, lo, k: int):
    """The last ``k`` characters of n-grams; for numbers of numpy and columns of Spark."""
    mask = lambda x, bits: x.bitwiseAND((1 << bits) - 1) if isinstance(x, Column) else x & (1 << bits) - 1
    return mask(hi, max(k - 3, 0) * BITS), mask(lo, min(k, 3) * BITS)


def key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each n-gram, by which tables are sorted."""
    return mix(mix(hi.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + lo.view(np.uint64)).view(np.int64)


def owner(pair: np.ndarray, shards: int) -> np.ndarray:
    """Shard of two characters."""
    return (mix(pair.view(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64) * shards >> 32


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that all their label rows call good."""
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").alias("q"))
        .where("q = 1")
        .select("doc_id")
    )


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT)) == 0


def count(docs: DataFrame, ids: DataFrame, limit: int = idset.BROADCAST_IDS) -> DataFrame:
    """``hi, lo, c``: counts of the n-grams of the documents with these ids."""
    few = idset.small_ids(ids, limit)
    source = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if few is None:
        source = source.join(ids, "doc_id", "left_semi")

    def add(held: list) -> list[np.ndarray]:
        k, hi, lo, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(k, kind="stable")
        k, hi, lo, n = k[order], hi[order], lo[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return [k[at], hi[at], lo[at], np.add.reduceat(n, at)]

    def rows(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[1:]], names=["hi", "lo", "c"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if few is not None:
                batch = batch.filter(pa.array(idset.member(few, batch.column(0).to_numpy())))
            for pieces in parts(batch.column(1).to_pylist()):
                hi, lo, _ = codes(pieces)
                k, first, n = np.unique(key(hi, lo), return_index=True, return_counts=True)
                held.append([k, hi[first], lo[first], n])
                size += len(k)
                if size > _HELD:
                    held = [add(held)]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield rows(held[0])
                        held, size = [], 0
        if size:
            yield rows(add(held))

    return source.mapInArrow(tally, "hi bigint, lo bigint, c bigint").groupBy("hi", "lo").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that are seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else y
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def levels(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k, hi, lo, p`` of all n-grams seen, and ``k, hi, lo, g`` of the contexts of k characters."""
    tables, lower = [counts], counts
    for k in range(ORDER - 1, 0, -1):
        hi, lo = part_of(F.col("hi"), F.col("lo"), k)
        lower = cut(lower.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c")))
        tables.insert(0, lower)
    below, grams, contexts = None, [], []
    for k, t in enumerate(tables, 1):
        seen = t.agg(*[F.sum((F.col("c") == x).cast("bigint")) for x in (1, 2, 3, 4)]).first()
        d = [F.lit(x) for x in discounts([x or 0 for x in seen])]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        shi, slo = part_of(F.col("hi"), F.col("lo"), k - 1)
        clo = F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(_ONE), 2 * BITS))
        t = t.select("hi", "lo", "c", off.alias("off"), F.shiftright("hi", BITS).alias("chi"), clo.alias("clo"), shi.alias("shi"), slo.alias("slo"))
        ctx = cut(t.groupBy("chi", "clo").agg(F.sum("c").alias("all"), (F.sum("off") / F.sum("c")).alias("g")))
        t = t.join(ctx, ["chi", "clo"])
        prior = F.lit(2.0**-BITS)
        if below is not None:
            t, prior = t.join(below.select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("lower")), ["shi", "slo"]), F.col("lower")
        below = cut(t.select("hi", "lo", ((F.col("c") - F.col("off")) / F.col("all") + F.col("g") * prior).alias("p")))
        grams.append(below.select(F.lit(k).alias("k"), "hi", "lo", "p"))
        contexts.append(ctx.select(F.lit(k - 1).alias("k"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), "g"))
    both = []
    for tables in (grams, contexts):
        out = tables[0]
        for part in tables[1:]:
            out = out.unionByName(part)
        both.append(out)
    return both[0], both[1]


#: Tables of a shard: (context?, characters) -> sorted keys and their values.
Tables = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
_KEPT: OrderedDict[tuple[str, int], tuple[Tables, int]] = OrderedDict()


class Model:
    """A model in files: ``path/shard=s`` for each shard, and ``shard=-1`` of what all shards use."""

    def __init__(self, path: str, of: int):
        self.path, self.of = path, of

    def shard(self, number: int) -> Tables:
        if (self.path, number) in _KEPT:
            _KEPT.move_to_end((self.path, number))
            return _KEPT[self.path, number][0]
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}/shard={number}", allow_not_found=True))
        read = [pq.ParquetFile(system.open_input_file(f.path)).read() for f in found if f.base_name.endswith(".parquet")]
        out: Tables = {}
        if read:
            t = pa.concat_tables(read)
            kinds, keys, values = (t.column(c).to_numpy() for c in ("kind", "key", "v"))
            for x in np.unique(kinds).tolist():
                mine = np.flatnonzero(kinds == x)
                order = mine[np.argsort(keys[mine])]
                out[x % 2, x // 2] = keys[order], values[order]
        size = sum(a.nbytes + b.nbytes for a, b in out.values())
        while _KEPT and sum(n for _, n in _KEPT.values()) + size > CACHE_BYTES:
            _KEPT.popitem(last=False)
        _KEPT[self.path, number] = out, size
        return out

    def log_p(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram of the full order, one shard after the other."""
        out, own = np.zeros(len(hi)), owner(lo >> BITS & _TWO, self.of)
        base = self.shard(-1)
        for s in range(self.of):
            mine = np.flatnonzero(own == s)
            if not len(mine):
                continue
            tables = base | self.shard(s)
            for begin in range(0, len(mine), _LOOKED_UP):
                left = mine[begin : begin + _LOOKED_UP]
                for k in range(ORDER, 0, -1):
                    h, x = part_of(hi[left], lo[left], k)
                    hit, p = _get(tables.get((0, k)), key(h, x))
                    out[left] += np.where(hit, p, _get(tables.get((1, k - 1)), key(h >> BITS, x >> BITS | (h & _ONE) << 2 * BITS))[1])
                    left = left[~hit]
                out[left] -= BITS * np.log(2.0)
        return out


def _get(table: tuple[np.ndarray, np.ndarray] | None, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if table is None:
        return np.zeros(len(at), bool), np.zeros(len(at))
    keys, values = table
    i = np.searchsorted(keys, at)
    i[i == len(keys)] = 0
    hit = keys[i] == at
    return hit, np.where(hit, values[i], 0.0)


def store(grams: DataFrame, contexts: DataFrame, rows: int = SHARD_ROWS) -> Model:
    """The model written to the shared folder."""
    of = max(1, -(-max(grams.count(), contexts.count()) // rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, k, hi, lo = (b.column(c).to_numpy() for c in range(4))
            shard = np.where(k >= 3 - kind, owner(np.where(kind == 1, lo, lo >> BITS) & _TWO, of), -1)
            columns = [pa.array(shard.astype(np.int32)), pa.array((2 * k + kind).astype(np.int8)), pa.array(key(hi, lo)), b.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "kind", "key", "v"])

    both = [t.select(F.lit(kind).alias("kind"), "k", "hi", "lo", F.ln(v).cast("float").alias("v")) for kind, t, v in ((0, grams, "p"), (1, contexts, "g"))]
    placed = both[0].unionByName(both[1]).mapInArrow(place, "shard int, kind tinyint, key bigint, v float")
    path = f"{shared_dir(grams.sparkSession)}/quillgraph/model-{uuid.uuid4().hex}"
    placed.repartition("shard").sortWithinPartitions("shard", "kind", "key").write.partitionBy("shard").parquet(path)
    written(path)
    return Model(path, of)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang, n, nll`` of each row: characters, and the sum of their negative log probabilities."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")

    def settle(held: list[tuple], nll: np.ndarray) -> None:
        """Add what the n-grams of a block of pieces cost to the sums of their texts."""
        keys, hi, lo = (np.concatenate([h[c] for h in held]) for c in range(3))
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        p, at = model.log_p(hi[first], lo[first])[which], 0
        for k, _, _, inverse, begin, of in held:
            np.add.at(nll, of, -np.add.reduceat(p[at : at + len(k)][inverse], begin))
            at += len(k)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nll = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            held: list[tuple] = []
            size = 0
            for row in range(0, batch.num_rows, _ROWS):
                texts = batch.column(2).slice(row, _ROWS).to_pylist()
                n[row : row + len(texts)] = [len(t or "") for t in texts]
                for pieces in parts(texts):
                    hi, lo, at = codes(pieces)
                    k, first, inverse = np.unique(key(hi, lo), return_index=True, return_inverse=True)
                    held.append((k, hi[first], lo[first], inverse.astype(np.int32), at[:-1], row + np.array([i for i, *_ in pieces])))
                    size += len(hi)
                    if size >= BLOCK_CHARS:
                        settle(held, nll)
                        held, size = [], 0
            if held:
                settle(held, nll)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(nll)], names=["doc_id", "lang", "n", "nll"])

    return source.mapInArrow(walk, "doc_id bigint, lang string, n bigint, nll double")


def keep(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    slack: float = SLACK,
    shard_rows: int = SHARD_ROWS,
    broadcast_ids: int = idset.BROADCAST_IDS,
) -> DataFrame:
    """``doc_id, lang, perplexity, threshold`` of the documents that are kept."""
    good = cut(trusted_ids(labels))
    counts = cut(count(docs, good.where(~held_out(F.col("doc_id"))), broadcast_ids))
    grams, contexts = levels(counts)
    scored = cut(score(docs, store(grams, contexts, shard_rows)).where("n > 0"))
    sample = scored.join(good.where(held_out(F.col("doc_id"))), "doc_id", "left_semi")
    mean = sample.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    shrunk = F.round((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR), 3)
    same = lambda a, b: a.join(b.withColumnRenamed("lang", "__l"), F.col("lang").eqNullSafe(F.col("__l")), "left").drop("__l")
    # means are rounded, so a language has a few thousand values and its exact quantile little state
    limit = same(sample, mean).groupBy("lang").agg(F.percentile(shrunk, F.lit(quantile)).alias("q"), F.first("mean").alias("mean"))
    limit = cut(limit)
    judged = same(scored, limit)
    return judged.where(F.col("q").isNull() | (shrunk <= F.col("q") + F.ln(F.lit(slack)))).select(
        "doc_id", "lang", F.exp(F.col("nll") / F.col("n")).alias("perplexity"), (F.exp("q") * slack).alias("threshold")
    )
