"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The index holds the test items; every passage of every document is a query.
Passages are windows of 2L tokens at every multiple of L, L being at least the
longest item of the index's length class, so each item that a document quotes
lies whole in one of them. Scores are BM25 divided by the item's score against
itself, so one threshold serves items of all lengths, and a term's largest
normalised weight bounds what it can add.

Frequent terms from which no item draws ``OPTIONAL`` of the threshold aren't
looked up at first; what they could add is subtracted from the threshold. A
passage is pruned if in no block of items the maxima of its other terms reach
the rest (block maxima added up for a run of passages at a time, so that what
is held is bounded by ``CELLS``, however many items or passages there are);
then by the maxima of all its terms; what is left runs block-max WAND, which is exact: it returns every item at or above the threshold. A hit counts
if enough of the item's question and of its answer is found in the passage,
measured by token 3-grams. Items have one text; its last quarter of tokens
(three at least) is the answer and the rest the question.

The index is broadcast in shards of at most ``ITEMS_PER_INDEX`` items and about
``INDEX_BYTES`` of text; a larger benchmark is searched shard by shard, with
document frequencies of the whole.

Defined results: null or empty items are left out, null or empty texts have
no hit, a null id is kept as null. Repeated documents or items are reported
once for each pair of ids, with the best score; ties keep the larger
overlaps. Extra columns are ignored by ``hits`` and kept by ``clean``. Empty
tables give empty hits.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel

K1, B = 1.2, 0.75
#: Part of an item's own score that a passage must reach, and parts of its question and answer.
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.5, 0.5, 0.3
GRAM, BLOCK = 3, 2
#: Part of the threshold that frequent terms may add without being looked up for every passage.
OPTIONAL = 0.3
ITEMS_PER_INDEX, INDEX_BYTES = 50_000, 64 << 20
#: Cells (passages x blocks) and entries of block maxima that are added up at once.
CELLS = 1 << 19


def _grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Distinct hashes of the n-grams of some tokens."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + len(out)]
    return np.unique(kernel.mix(out))


def _part(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The n-grams of a part of an item, n less than 3 only if it is shorter."""
    n = min(GRAM, len(h))
    return n, _grams(h, n)


def _overlap(part: tuple[int, np.ndarray], passage: np.ndarray) -> float:
    """Portion of a part's n-grams in a passage; 1 for an empty part."""
    n, grams = part
    return float(np.isin(grams, _grams(passage, n)).mean()) if n else 1.0


class Index:
    """Items of one length class, with postings in item order."""

    def __init__(self, ids: list, tokens: list[np.ndarray], df: dict[int, int], total: int, mean: float, stride: int):
        self.ids, self.stride = ids, stride
        self.threshold = MIN_SCORE
        items = [np.unique(t, return_counts=True) for t in tokens]
        self.terms = np.unique(np.concatenate([u for u, _ in items]))
        weight = []
        for (u, tf), t in zip(items, tokens):
            d = np.array([df[int(x)] for x in u], float)
            idf = np.log1p((total - d + 0.5) / (d + 0.5))
            s = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            weight.append(s / s.sum())
        term = np.concatenate([np.searchsorted(self.terms, u) for u, _ in items])
        item = np.repeat(np.arange(len(items)), [len(u) for u, _ in items])
        order = np.lexsort((item, term))
        self.post_item, self.post_weight = item[order], np.concatenate(weight)[order]
        self.post_at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.blocks = (len(items) + BLOCK - 1) // BLOCK
        self.bound = np.maximum.reduceat(self.post_weight, self.post_at[:-1])
        #: block maxima as rows (term, block), sparse over blocks
        key = term[order] * self.blocks + self.post_item // BLOCK
        at = kernel.runs(key)[:-1]
        self.block_max = np.maximum.reduceat(self.post_weight, at)
        self.block_no = key[at] % self.blocks
        self.block_at = np.searchsorted(key[at] // self.blocks, np.arange(len(self.terms) + 1))
        cut = [max(len(t) - max(len(t) // 4, GRAM), 0) for t in tokens]
        self.question = [_part(t[:c]) for t, c in zip(tokens, cut)]
        self.answer = [_part(t[c:]) for t, c in zip(tokens, cut)]
        # The most frequent terms are optional while no item draws OPTIONAL of the threshold from them: a passage
        # that reaches the threshold for an item draws the rest, at least `need` of its block, from other terms.
        sizes = np.diff(self.post_at)
        needed, optional = np.ones(len(self.terms), bool), np.zeros(len(items))
        for d in np.unique(sizes)[::-1]:
            mine = np.repeat(sizes == d, sizes)
            more = optional + np.bincount(self.post_item[mine], self.post_weight[mine], minlength=len(items))
            if more.max() > self.threshold * OPTIONAL:
                break
            optional, needed = more, needed & (sizes != d)
        self.need = self.threshold - np.maximum.reduceat(optional, np.arange(0, len(items), BLOCK)) - 1e-9
        self.rare = np.flatnonzero(needed)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms[self.rare] >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _find(among: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of members of the sorted ``among``, and which."""
        i = np.searchsorted(among, h)
        i[i == len(among)] = 0
        ok = np.flatnonzero(among[i] == h)
        return ok, i[ok]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens that are needed terms, and the terms."""
        pos = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        ok, i = self._find(self.terms[self.rare], h[pos])
        return pos[ok], self.rare[i]

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score with these distinct terms is at least the threshold.

        Lists move on to the next block of items in which the terms' block maxima reach it.
        """
        out: list[tuple[int, float]] = []
        least = self.threshold - 1e-9
        at, _ = self._maxima(terms)
        good = np.flatnonzero(np.bincount(self.block_no[at], self.block_max[at]) >= least).tolist() if len(at) else []
        if not good:
            return out
        lists = [[int(self.post_item[self.post_at[t]]), int(self.post_at[t]), int(t)] for t in terms]
        block_end = lambda item: (item // BLOCK + 1) * BLOCK

        def seek(x: list[int], item: int) -> bool:
            end = self.post_at[x[2] + 1]
            x[1] += int(np.searchsorted(self.post_item[x[1] : end], item))
            if x[1] == end:
                return False
            x[0] = int(self.post_item[x[1]])
            return True

        lists = [x for x in lists if seek(x, good[0] * BLOCK)]
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += self.bound[x[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            if good[(k := bisect.bisect_left(good, item // BLOCK)) : k + 1] != [item // BLOCK]:
                if k == len(good):
                    break
                lists = [x for x in lists if x[0] >= good[k] * BLOCK or seek(x, good[k] * BLOCK)]
                continue
            inside = 0.0
            for x in lists[: pivot + 1]:
                a, b = self.block_at[x[2]], self.block_at[x[2] + 1]
                j = a + np.searchsorted(self.block_no[a:b], item // BLOCK)
                if j < b and self.block_no[j] == item // BLOCK:
                    inside += self.block_max[j]
            if inside < least:  # no item of this block before the next list begins can reach it
                goal = block_end(item)
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
                goal = max(goal, item + 1)
                lists = [x for x in lists[: pivot + 1] if seek(x, goal)] + lists[pivot + 1 :]
            elif lists[0][0] == item:
                score = sum(self.post_weight[x[1]] for x in lists[: pivot + 1])
                if score >= least:
                    out.append((item, float(score)))
                lists = [x for x in lists[: pivot + 1] if seek(x, item + 1)] + lists[pivot + 1 :]
            else:
                lists = [x for x in lists[:pivot] if seek(x, item)] + lists[pivot:]
        return out

    def search(self, w: kernel.Words) -> list[tuple[int, int, float, float, float]]:
        """(document, item, score, question and answer overlap) of every verified hit."""
        pos, term = self.lookup(w.hash)
        if not len(pos):
            return []
        doc = w.doc[pos]
        # window j of a document has its tokens from j - 1 to j + 1 strides; windows are numbered on over documents
        first = np.concatenate(([0], np.cumsum(np.diff(w.first) // self.stride + 2)))
        window = first[doc] + (pos - w.first[doc]) // self.stride
        key = np.unique(np.concatenate((window, window + 1)) * len(self.terms) + np.concatenate((term, term)))
        window, term = key // len(self.terms), key % len(self.terms)
        out = {}
        for j in self._promising(window, term):
            d = int(np.searchsorted(first, j, "right")) - 1
            a = w.first[d] + (j - first[d]) * self.stride
            passage = w.hash[max(a - self.stride, w.first[d]) : min(a + self.stride, w.first[d + 1])]
            terms = np.unique(self._find(self.terms, passage)[1])
            got = self.wand(terms)
            if not got:
                continue
            for item, score in got:
                q, r = (_overlap(x, passage) for x in (self.question[item], self.answer[item]))
                if q >= MIN_QUESTION and r >= MIN_ANSWER:
                    out[d, item] = max(out.get((d, item), (0, 0, 0)), (score, q, r))
        return [(d, i, *s) for (d, i), s in out.items()]

    def _promising(self, window: np.ndarray, term: np.ndarray) -> Iterator[int]:
        """The windows (ascending) in which the block maxima of the needed terms reach what some block needs."""
        at = kernel.runs(window)
        n = self.block_at[term + 1] - self.block_at[term]
        entries = np.concatenate(([0], np.cumsum(n)))
        lo, step = 0, max(1, CELLS // self.blocks)
        while lo < len(at) - 1:
            hi = min(lo + step, len(at) - 1)
            hi = max(lo + 1, min(hi, int(np.searchsorted(entries[at], entries[at[lo]] + CELLS, "right")) - 1))
            part = slice(at[lo], at[hi])
            i, m = self._maxima(term[part])
            row = np.repeat(np.arange(hi - lo), np.add.reduceat(m, at[lo:hi] - at[lo]))
            sums = np.bincount(row * self.blocks + self.block_no[i], self.block_max[i], minlength=(hi - lo) * self.blocks)
            for r in np.flatnonzero((sums.reshape(-1, self.blocks) >= self.need).any(1)):
                yield int(window[at[lo + r]])
            lo = hi

    def _maxima(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the block maxima of some terms are, and how many each has."""
        a, n = self.block_at[terms], self.block_at[terms + 1] - self.block_at[terms]
        return np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()), n


def tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    return [w.hash[a:b] for w in kernel.words(texts) for a, b in zip(w.first, w.first[1:])]


def build(items: list[tuple], df: dict[int, int] | None = None, total: int | None = None, mean: float | None = None) -> list[Index]:
    """Indexes of ``(item_id, text)`` pairs by length class; statistics of the whole benchmark if this is a shard."""
    pairs = [(i, t) for (i, _), t in zip(items, tokens_of([x for _, x in items])) if len(t)]
    if not pairs:
        return []
    if df is None:
        u, c = np.unique(np.concatenate([np.unique(t) for _, t in pairs]), return_counts=True)
        df, total, mean = dict(zip(u.tolist(), c.tolist())), len(pairs), float(np.mean([len(t) for _, t in pairs]))
    groups: dict[int, list[tuple]] = {}
    for i, t in pairs:
        stride = 64
        while stride < len(t):
            stride *= 4
        groups.setdefault(stride, []).append((i, t))
    return [
        Index([i for i, _ in g], [t for _, t in g], df, total, mean, min(stride, max(len(t) for _, t in g)))
        for stride, g in sorted(groups.items())
    ]


def indexes(items: DataFrame, per_index: int = ITEMS_PER_INDEX) -> Iterator[list[Index]]:
    """One list of indexes for each shard of ``items(item_id, text)``."""
    items = items.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    n, text_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n <= per_index and text_bytes <= INDEX_BYTES:
        yield build([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])
        return

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [t for t in tokens_of(b.column(0).to_pylist()) if len(t)]
            h = np.concatenate([np.unique(t) for t in tokens] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.zeros(len(h), np.int64)), pa.array(np.zeros(len(h), np.int64))], names=["h", "items", "size"]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([sum(map(len, tokens))], pa.int64())],
                names=["h", "items", "size"],
            )

    counted = items.select("text").mapInArrow(count, "h bigint, items bigint, size bigint")
    total, size = counted.agg(F.sum("items"), F.sum("size")).first()
    shards = max(-(-n // per_index), -(-text_bytes // INDEX_BYTES))
    by = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    for k in range(shards):
        rows = by.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        terms = {int(h) for t in tokens_of([r.text for r in rows]) for h in t.view(np.int64)}
        mine = items.sparkSession.createDataFrame(pa.table({"h": pa.array(sorted(terms), pa.int64())}))
        df = counted.where("items = 0").join(mine, "h").groupBy("h").count().collect()
        yield build([(r.item_id, r.text) for r in rows], {r.h % (1 << 64): r["count"] for r in df}, total, size / max(total, 1))


def hits(docs: DataFrame, items: DataFrame, per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of each document that quotes an item."""
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    source = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for shard in indexes(items, per_index):

        def search(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for w in kernel.words(batch.column(1).to_pylist()):
                    for index in shard:
                        rows += [(ids[w.lo + d], index.ids[i], s, q, r) for d, i, s, q, r in index.search(w)]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                )

        part = source.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame, per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """The rows of ``docs`` that quote no item, with their columns; decided row by row, without a join."""
    for shard in indexes(items, per_index):

        def keep(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard, at: int = docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for w in kernel.words(batch.column(at).to_pylist()):
                    for index in shard:
                        ok[[w.lo + d for d, *_ in index.search(w)]] = False
                yield batch.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
