"""Document fingerprints: MinHash signatures, bands joined in Spark, Jaccard verified.

A document's fingerprint is the least value of each of ``bands * rows``
multiply-add hash functions over its token shingles, worked out in numpy.
Documents of the same tokens in the same order are one node from the start.
Nodes that share a band meet in one posting list; lists are compared block by
block (see ``pairs``) and linked where the signatures (a byte of each
coordinate) agree well enough to be worth a look, at ``SLACK`` below the
wanted Jaccard. Each connected set of candidates gets the shingle sets of its
nodes, cut into blocks of about ``BLOCK_BYTES`` and ``BLOCK`` nodes; each pair
of blocks is a group, whose exact intersections are one batched matrix
product. Every pair at or above the threshold is a link; groups are the
connected components of the links.

Shingle sets, as 32-bit hashes, are made again for candidates only, one for
each node. The candidates' ids are broadcast if there are few; else the texts
are joined with them.

Defined results: as for near duplicates by coordinates; null ids, null and
empty texts and texts without a token have no fingerprint and no partner; a
repeated id is one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import cut
from . import ids as idset
from . import kernel, pairs

BANDS, ROWS, SHINGLE, JACCARD, SLACK, SEED = 24, 5, 3, 0.7, 0.15, 4099
#: Bytes of shingle sets and nodes in a block of candidates, and shingles of a matrix product.
BLOCK_BYTES, BLOCK, COLUMNS = 8 << 20, 1024, 4096


def digests(w: kernel.Words) -> np.ndarray:
    """A hash of the token sequence of each document of a slice; 0 without a token."""
    full = np.flatnonzero(np.diff(w.first) > 0)
    out = np.zeros(w.hi - w.lo, np.uint64)
    if len(full):
        place = np.arange(len(w.hash), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
        out[full] = kernel.mix(np.add.reduceat(kernel.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), w.first[full]))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``node`` (the digest of the token sequence), ``size`` (shingles), ``bands`` (a hash of each) and ``sig`` (the low byte of each coordinate)."""
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for w in kernel.words(texts):
                sh, first = kernel.shingles(w, shingle)
                has = np.diff(first) > 0
                sig = kernel.minhash(sh, first, k, SEED)[has]
                key = np.zeros((len(sig), bands), np.uint64)
                for r in range(rows):
                    key = kernel.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64))
                key = kernel.mix(key + np.arange(bands, dtype=np.uint64))
                n = len(sig)
                columns = [
                    pa.array(ids[w.lo : w.hi][has], pa.int64()),
                    pa.array(digests(w)[has]),
                    pa.array(np.diff(first)[has].astype(np.int64)),
                    kernel.lists(key.view(np.int64).reshape(-1), np.full(n, bands), pa.int64()),
                    kernel.lists(sig.astype(np.uint8).view(np.int8).reshape(-1), np.full(n, k), pa.int8()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "bands", "sig"])

    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInArrow(sign, "doc_id bigint, node bigint, size bigint, bands array<bigint>, sig array<tinyint>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, limit: int) -> DataFrame:
    """``node`` and the sorted distinct ``shingles`` of the wanted ``doc_id, node``; repeated rows may repeat."""
    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    few = None
    if wanted.limit(limit + 1).count() <= limit:
        few = idset.small_ids(wanted.select("doc_id"), limit)
    else:
        source = source.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if few is not None:
                batch = batch.filter(pa.array(idset.member(few, batch.column(0).to_numpy())))
            for w in kernel.words(batch.column(1).to_pylist()):
                sh, first = kernel.shingles(w, shingle)
                node, one = np.unique(digests(w), return_index=True)  # equal texts of a slice are made once
                sets = [np.unique((sh[first[d] : first[d + 1]] >> np.uint64(32)).astype(np.uint32)) for d in one]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), kernel.lists(flat.view(np.int32), np.array([len(s) for s in sets]), pa.int32())], names=["node", "shingles"]
                )

    return source.mapInArrow(make, "node bigint, shingles array<int>")


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``, by products of 0/1 matrices over blocks of shingles."""
    out = np.zeros((len(a), len(b)), np.float64)
    known = np.intersect1d(*[np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint32) for x in (a, b)], assume_unique=True)
    places = []
    for sets in (a, b):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((row[hit][order], at[hit][order]))
    for lo in range(0, len(known), columns):
        both = []
        for (row, at), sets in zip(places, (a, b)):
            s, e = np.searchsorted(at, (lo, lo + columns))
            x = np.zeros((len(sets), min(columns, len(known) - lo)), np.float32)
            x[row[s:e], at[s:e] - lo] = 1
            both.append(x)
        out += both[0] @ both[1].T
    return out


def verify(grouped: DataFrame, least: float) -> DataFrame:
    """Edges ``src, dst`` (n 0) and links of nodes (``src = dst``, n) of the rows ``key, i, j, side, node, shingles``, group by group."""

    def links(rows: list[tuple]) -> tuple[list, list]:
        """Rows of one group are ``node, side, i = j, set``."""
        rows = list({r[:2]: r for r in rows}.values())
        inside = rows[0][2]
        left = rows if inside else [r for r in rows if r[1] == 0]
        right = rows if inside else [r for r in rows if r[1] == 1]
        if not left or not right:
            return [], []
        both = intersections([r[3] for r in left], [r[3] for r in right])
        a, b = (np.array([len(r[3]) for r in x], float) for x in (left, right))
        union = a[:, None] + b[None] - both
        hit = (both >= least * union) & (union > 0)
        if inside:
            hit = np.triu(hit, 1)
        x, y = np.nonzero(hit)
        node = np.array([r[0] for r in (left if inside else [*left, *right])])
        y = y if inside else y + len(left)
        n = np.bincount(x, minlength=len(node)) + np.bincount(y, minlength=len(node))
        parent = np.arange(len(node))
        pairs.unite(parent, x, y)
        edge = np.flatnonzero(parent != np.arange(len(node)))
        some = np.flatnonzero(n)
        return list(zip(node[edge], node[parent[edge]], [0] * len(edge))), list(zip(node[some], node[some], n[some]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out: list[tuple] = []
            flat, at = batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy()
            at = at - at[0]
            for r, (key, i, j, side, node) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(5)])):
                if (key, i, j) != now:
                    if len(held) > 1:
                        out += sum(links(held), [])
                    now, held = (key, i, j), []
                held.append((node, side, i == j, flat[at[r] : at[r + 1]].view(np.uint32)))
            yield _edges(out)
        if len(held) > 1:
            yield _edges(sum(links(held), []))

    return grouped.mapInArrow(walk, "src bigint, dst bigint, n bigint")


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], names=["src", "dst", "n"])


def near(
    docs: DataFrame,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
    jaccard: float = JACCARD,
    broadcast_ids: int = idset.BROADCAST_IDS,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, group_id, class_id, n_docs, n_links`` of each document that has a copy or a near copy.

    ``class_id`` is the least id with the same token sequence, ``n_links`` the
    number of other sequences with at least that Jaccard.
    """
    signed = cut(fingerprints(docs, bands, rows, shingle))
    first = lambda c: F.first(c).alias(c)
    one = cut(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), first("size"), first("bands"), first("sig")))
    posted = one.select("node", F.explode("bands").alias("key"))
    lists = posted.join(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    k = bands * rows
    candidates, _ = pairs.collide(lists.join(one.select("node", "sig"), "node"), k, int((jaccard - SLACK) * k), block)
    label = connected_components(candidates).withColumnRenamed("component", "key")
    wanted = cut(label.join(one.select("node", "doc_id", "size"), "node"))
    # blocks of a component by its bytes and nodes, as pairs.blocked cuts a list of n nodes into blocks of `block`
    sizes = wanted.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") * 4 * block / block_bytes)).alias("n"))
    sets = _sets(docs, wanted, shingle, broadcast_ids)
    held = wanted.select("node", "key").join(sizes, "key")
    if held.limit(broadcast_ids // 4 + 1).count() <= broadcast_ids // 4:
        held = F.broadcast(held)
    grouped = pairs.blocked(sets.join(held, "node").select("key", "n", "node", "shingles"), block)
    grouped = grouped.select("key", "i", "j", "side", "node", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(verify(grouped, jaccard))
    edges = found.where("n = 0").select("src", "dst").distinct()
    links = found.where("n > 0").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n_links"))
    return pairs.memberships(signed.select("doc_id", "node"), edges, links)
