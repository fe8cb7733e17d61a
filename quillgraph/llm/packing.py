"""Best-fit packing by hierarchical residual merging.

Documents are measured in bytes of UTF-8 plus one end mark (the length of a
byte-level tokenisation). Longer ones are cut into pieces of a full bin and a
rest. Every partition packs its pieces by best fit, longest first; bins that
are nearly full are final. The other bins of ``FAN_IN`` partitions meet in one
partition of the next level, where each is an item that holds its pieces, and
are packed again; so on up to one partition, whose bins are all final. Text
never moves: only lengths and ids do, and from level to level only what is
underfull.

Everything is ordered by length, id and start before it is packed and
partitions are chosen by a hash of the id, so the result is deterministic and
a lost task is recomputed to the same bins.

Defined results: null texts are not packed; an empty text is one end mark. A
null id is kept as null. Repeated rows are packed once each. Extra columns are
ignored. An empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Bytes in a bin, the part of a bin that makes it nearly full, pieces in a partition, and partitions that meet.
CAPACITY, FULL, PIECES, FAN_IN = 8192, 0.99, 20_000, 8

SCHEMA = "level int, part bigint, bin bigint, used bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, final boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, in the given order, goes to the open bin with the least room that takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what is left in them, oldest last
    open_ = 0  # bit r: some bin has r left
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= size
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length`` of the pieces of each text with its end mark."""
    size = F.octet_length("text").cast("bigint") + 1
    long = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"))
    cut_at = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(capacity).cast("bigint"))
    return long.select("doc_id", "size", F.explode(cut_at).alias("start")).select(
        "doc_id", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity).cast("bigint")).alias("length")
    )


def _pack_level(items: DataFrame, level: int, capacity: int, least: int, last: bool) -> DataFrame:
    """One round; items have ``part, used, doc_ids, starts, lengths``."""

    def run(part: int, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (-r[0], [(-1 if d is None else 0, d or 0) for d in r[1]], r[2]))
        out = []
        for n, members in enumerate(best_fit([r[0] for r in rows], capacity)):
            used = sum(rows[i][0] for i in members)
            joined = [[x for i in members for x in rows[i][c]] for c in (1, 2, 3)]
            out.append((level, part, n, used, *joined, last or used >= least))
        return out

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.bool_()]
    names = ["level", "part", "bin", "used", "doc_ids", "starts", "lengths", "final"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                columns = zip(*run(now, held))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for part, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if part != now:
                    yield from close()
                    held, now = [], part
                held.append(tuple(row))
        yield from close()

    by_part = items.select("part", "used", "doc_ids", "starts", "lengths").repartition("part").sortWithinPartitions("part")
    return by_part.mapInArrow(pack, SCHEMA)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, per_part: int = PIECES, fan_in: int = FAN_IN
) -> DataFrame:
    """One row for each bin: ``bin_id, used, n_pieces, doc_ids, starts, lengths`` (parallel lists)."""
    flat = cut(pieces(docs, capacity))
    parts = max(1, -(-flat.count() // per_part))
    one = lambda c: F.array(c).alias(c + "s")
    items = flat.select(
        F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("bigint").alias("part"),
        F.col("length").alias("used"),
        one("doc_id"),
        one("start"),
        one("length"),
    )
    done, level = None, 0
    while True:
        last = parts == 1
        bins = cut(_pack_level(items, level, capacity, int(capacity * full), last))
        done = bins.where("final") if done is None else done.unionByName(bins.where("final"))
        if last:
            break
        level, parts = level + 1, -(-parts // fan_in)
        items = bins.where("NOT final").withColumn("part", F.expr(f"part div {fan_in}"))
    return done.select(
        F.format_string("%d-%d-%d", "level", "part", "bin").alias("bin_id"),
        "used",
        F.size("doc_ids").cast("bigint").alias("n_pieces"),
        "doc_ids",
        "starts",
        "lengths",
    )
