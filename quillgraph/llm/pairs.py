"""Pairs of signatures that meet in posting lists, and the groups that they make.

A posting list may hold any number of nodes. It is cut into blocks of about
``BLOCK`` nodes by a hash, and each pair of blocks is a group of its own, so
no task holds or compares more than two blocks at once, however long the list
is; every pair is compared. A group gives the links of each node as a count
and, as edges, a spanning forest of the pairs found, so that what leaves it is
linear in its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import cut
from . import kernel

#: Nodes in a block of a posting list, and bytes of a comparison made at once.
BLOCK, CHUNK = 1024, 1 << 22


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; ``parent`` holds every row's root before and after."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def blocked(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``postings(key, node, n, ...)``, n at least the list's length, with the groups ``i, j`` and the ``side`` that each row takes."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.col("node"), blocks).cast("int")
    rest = [c for c in postings.columns if c != "n"]
    spread = postings.select(*rest, own.alias("__b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__j"))
    return spread.select(*rest, F.least("__b", "__j").alias("i"), F.greatest("__b", "__j").alias("j"), (F.col("__b") > F.col("__j")).cast("int").alias("side"))


class _Groups:
    """Whole groups of rows, sorted by group."""

    def __init__(self, key, i, j, side, node, mask, sig, need: int):
        self.node, self.sig, self.need, self.mask, self.side = node, sig, need, mask, side
        self.within = i == j
        self.bit = None if mask is None else np.left_shift(np.uint64(1), (key >> 32).astype(np.uint64))
        self.at = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(key)]))
        self.parent, self.count = np.arange(len(key)), np.zeros(len(key), np.int64)

    def take(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> None:
        """Rows a and b whose coordinates agree where ``same`` says so; a pair counts in one list only, that of its first merged coordinate."""
        hit = np.flatnonzero(same.sum(1) >= self.need)
        a, b = a[hit], b[hit]
        if self.mask is not None and len(hit):
            both = np.packbits(same[hit], axis=1, bitorder="little")
            both = np.pad(both, ((0, 0), (0, 8 - both.shape[1]))).copy().view(np.uint64)[:, 0] & self.mask[a] & self.mask[b]
            first = (both & (~both + np.uint64(1))) == self.bit[a]
            a, b = a[first], b[first]
        other = self.node[a] != self.node[b]
        a, b = a[other], b[other]
        unite(self.parent, a, b)
        self.count += np.bincount(a, minlength=len(self.count)) + np.bincount(b, minlength=len(self.count))

    def compare(self) -> None:
        size, k = np.diff(self.at), self.sig.shape[1]
        for n in np.unique(size[(size > 1) & (size <= 32)]):
            x, y = np.triu_indices(n, 1)
            rows = self.at[:-1][size == n][:, None]
            a, b = (rows + x).ravel(), (rows + y).ravel()
            ok = self.within[a] | (self.side[a] != self.side[b])
            a, b = a[ok], b[ok]
            for lo in range(0, len(a), CHUNK // k):
                s = slice(lo, lo + CHUNK // k)
                self.take(a[s], b[s], self.sig[a[s]] == self.sig[b[s]])
        for g in np.flatnonzero(size > 32):
            rows = np.arange(self.at[g], self.at[g + 1])
            inside = self.within[rows[0]]
            left = rows if inside else rows[self.side[rows] == 0]
            right = rows if inside else rows[self.side[rows] == 1]
            if not len(left) or not len(right):
                continue
            step, held = max(1, CHUNK // (k * len(right))), self.sig[right]
            for lo in range(0, len(left), step):
                mine = left[lo : lo + step]
                same = self.sig[mine][:, None, :] == held[None]
                x, y = np.nonzero(same.sum(2) >= self.need)
                if inside:
                    x, y = x[y > x + lo], y[y > x + lo]
                self.take(mine[x], right[y], same[x, y])

    def out(self) -> pa.RecordBatch:
        self.compare()
        row = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        edge = np.unique(np.stack((self.node[row], self.node[self.parent[row]]), 1), axis=0)
        some = np.flatnonzero(self.count)
        node, which = np.unique(self.node[some], return_inverse=True)
        n = np.bincount(which, self.count[some], minlength=len(node)).astype(np.int64)
        columns = [
            pa.array(np.concatenate((edge[:, 0], node)), pa.int64()),
            pa.array(np.concatenate((edge[:, 1], node)), pa.int64()),
            pa.array(np.concatenate((np.zeros(len(edge), np.int64), n)), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "n"])


def collide(postings: DataFrame, k: int, need: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst`` and links ``node, n_links`` of the nodes of ``postings(key, n, node, sig)`` that agree in ``need`` of ``k`` coordinates.

    ``n`` is at least the number of rows of a key. With a column ``mask``, the
    coordinates whose lists a node is posted in, and keys that begin with
    their coordinate, a pair is linked once however many lists it meets in;
    without one the links are not counted exactly and only edges are of use.
    """
    masked = "mask" in postings.columns
    rows = postings.select("key", "n", "node", "sig", F.col("mask") if masked else F.lit(0).cast("bigint").alias("mask"))
    kind = np.int8 if "tinyint" in rows.schema["sig"].dataType.simpleString() else np.int32

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, i, j, side, node, mask, sig = (np.concatenate(x) for x in zip(*held))
            if len(key):
                yield _Groups(key, i, j, side, node, mask.view(np.uint64) if masked else None, sig, need).out()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(c).to_numpy() for c in range(6)] + [batch.column(6).flatten().to_numpy().astype(kind, copy=False).reshape(-1, k)]
            group = [part[c] for c in range(3)]
            last = int(np.flatnonzero((group[0] == group[0][-1]) & (group[1] == group[1][-1]) & (group[2] == group[2][-1]))[0])
            if last == 0 and held and all(h[-1] == g[0] for h, g in zip(held[-1], group)):
                held.append(part)  # the group goes on
                continue
            held.append([x[:last] for x in part])
            yield from flush()
            held = [[x[last:] for x in part]]
        if held:
            yield from flush()

    grouped = blocked(rows, block).select("key", "i", "j", "side", "node", "mask", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(grouped.mapInArrow(walk, "src bigint, dst bigint, n bigint"))
    edges = found.where("n = 0").select("src", "dst").distinct()
    links = found.where("n > 0").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n_links"))
    return edges, links


def memberships(members: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, group_id, class_id, n_docs, n_links``: one row for each document of ``members(doc_id, node)`` whose group has another.

    A group is a connected component of nodes, named by its least document; a
    class is a node, named likewise; the links are those of the document's node.
    """
    label = connected_components(edges)
    one = members.distinct()
    nodes = one.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    held = (
        nodes.join(label, "node", "left")
        .where("copies > 1 OR component IS NOT NULL")
        .join(links, "node", "left")
        .select("node", "class_id", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    rows = cut(one.join(held, "node").groupBy("doc_id", "component").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links")))
    sizes = rows.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs")).where("n_docs > 1")
    return rows.join(sizes, "component").select("doc_id", "group_id", "class_id", "n_docs", "n_links")


def identity(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of unsigned integers."""
    h = np.full(len(sig), sig.shape[1], np.uint64)
    for c in range(sig.shape[1]):
        h = kernel.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c].astype(np.uint64))
    return h
