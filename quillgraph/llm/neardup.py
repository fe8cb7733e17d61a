"""Near duplicates by an inverted join on signature coordinates.

Every document posts its MinHash signature under each (coordinate, value)
pair. Two documents are near copies if they collide in at least ``matches`` of
the ``k`` coordinates. The join never forms all pairs of equal texts, nor
holds a posting list:

* equal signatures are one node, named by a 64-bit hash of the signature;
* lists are counted by an aggregate that is combined before its shuffle; a
  list of one node is dropped, and with it every node with fewer than
  ``matches`` shared pairs left (it can't reach the threshold);
* the shared pairs of a node are ordered by list length; of its m pairs only
  the m - matches + 1 shortest lists are merged (prefix), the long lists are
  skipped, and collisions are counted on the signatures themselves, so that
  the count is exact;
* a merged list is cut into blocks and compared pair of blocks by pair of
  blocks (see ``pairs``), so that a list of any length is work for many tasks.
  A pair that meets in several lists is taken in the first of them only.

No link between different signatures is lost: each document comes with the
number of other signatures that its own is linked with. Groups are the
connected components of the links.

Defined results: null ids, null and empty texts and texts without a token
have no signature and no partner. Documents of fewer than ``shingle`` tokens
are one shingle. A repeated id is one document and never its own partner; if
its texts differ it has the links of all of them. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from . import ids as idset
from . import kernel, pairs

#: Coordinates (64 at most), collisions that make a near copy, tokens in a shingle, and the seed of the permutations.
COORDINATES, MATCHES, SHINGLE, SEED = 64, 32, 3, 20177


def signatures(docs: DataFrame, k: int = COORDINATES, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``node`` (a hash of the signature) and ``sig`` (k ints) of the documents that have a token."""
    if not 1 <= k <= 64:
        raise ValueError("k must be 1 to 64")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for w in kernel.words(texts):
                sh, first = kernel.shingles(w, shingle)
                has = np.diff(first) > 0
                sig = kernel.minhash(sh, first, k, seed)[has]
                columns = [
                    pa.array(ids[w.lo : w.hi][has], pa.int64()),
                    pa.array(pairs.identity(sig).view(np.int64)),
                    kernel.lists(sig.view(np.int32).reshape(-1), np.full(len(sig), k), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "sig"])

    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInArrow(sign, "doc_id bigint, node bigint, sig array<int>")


def merged(one: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Postings ``key, n, node, sig, mask`` of the lists that are merged, of ``one(node, sig)``."""
    posted = one.select("node", F.posexplode("sig")).select(
        "node", F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.col("col").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("key")
    )
    shared = posted.join(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    lists = (
        shared.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))
        .where(F.size("lists") >= matches)
        .select("node", F.slice(F.col("lists"), 1, F.size("lists") - (matches - 1)).alias("lists"))
    )
    mask = F.expr("aggregate(lists, 0L, (m, x) -> m | shiftleft(1L, cast(shiftrightunsigned(x.key, 32) AS int)))")
    return lists.withColumn("mask", mask).join(one, "node").select("node", "sig", "mask", F.inline("lists"))


def near(docs: DataFrame, k: int = COORDINATES, matches: int = MATCHES, shingle: int = SHINGLE, block: int = pairs.BLOCK) -> DataFrame:
    """``doc_id, group_id, class_id, n_docs, n_links`` of each document that has a near copy.

    ``group_id`` is the least id of its group, ``n_docs`` the group's size,
    ``class_id`` the least id with the same signature and ``n_links`` the
    number of other signatures with at least ``matches`` collisions.
    """
    signed = cut(signatures(docs, k, shingle))
    one = cut(signed.groupBy("node").agg(F.first("sig").alias("sig")))
    edges, links = pairs.collide(merged(one, matches), k, matches, block)
    return pairs.memberships(signed.select("doc_id", "node"), edges, links)


def drop_near(docs: DataFrame, k: int = COORDINATES, matches: int = MATCHES, shingle: int = SHINGLE, broadcast_ids: int = idset.BROADCAST_IDS) -> DataFrame:
    """``docs`` without the documents of a group other than its least id; rows with a null id stay.

    The ids that go are broadcast if they are at most ``broadcast_ids``, and joined beyond; the rows are the same.
    """
    lost = cut(near(docs, k, matches, shingle).where("doc_id <> group_id").select(F.col("doc_id").alias("__lost")).distinct())
    if lost.limit(broadcast_ids + 1).count() <= broadcast_ids:
        lost = F.broadcast(lost)
    return docs.join(lost, F.col("doc_id").cast("bigint") == F.col("__lost"), "left_anti")
