"""Deterministic sharded WARC writer.

Records are sorted by URL, id and content. Shards are ranges of that order,
about ``SHARD_BYTES`` of content each, at any size of the input. Their bounds
are every so many bytes of a sorted sample that a hash of the record chooses,
so they depend on the records and not on how the input is partitioned; sample
and running sums stay distributed, and only the bounds (one key of a hundred
bytes or so for each shard) come to the driver and go to the tasks. Shard n is
partition n, written by one task: one gzip member for each record, rolling to
the next file when the compressed size would pass ``FILE_BYTES``. Headers are
made anew: record ids are name-based UUIDs of the content and of the record's
place among equal ones, digests are SHA-1, the date is a parameter, so equal
inputs give equal bytes.

Records that are equal in all columns can't be told apart, so however many
there are no bound parts them. If they are more than a shard, they are counted
instead of moved, and written by shards of their own, each of a share of them.

Files are written under a name of the attempt in ``_temporary`` and renamed
when complete; a repeated task finds the name taken by the same bytes, and
drops its own. When all tasks are done the manifest is written in the same way
and renamed last. A reader takes the files of the manifest only, so output
without a manifest is not there.

Defined results: a null URL has no target header and sorts first; a null
page is an empty one; a null id has no id header; repeated rows are written
once each, with record ids of their own; CR, LF and blanks of URLs are
percent-encoded. An empty table gives a manifest without files. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut

#: Bytes of content in a shard, compressed bytes of a file, sampled records of a shard.
SHARD_BYTES, FILE_BYTES, SAMPLED = 32 << 20, 8 << 20, 64
DATE = "2000-01-01T00:00:00Z"

INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_bytes bigint, digest string"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member, without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def encoded(url: str) -> str:
    return "".join(c if c not in "\r\n\t " else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE, place: int = 0) -> tuple[bytes, int, str]:
    """A record, the bytes of its payload, and the payload's digest; ``place`` is its number among equal records."""
    body = (html or "").encode("utf-8", "replace")
    digest = sha1(body)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}" + (f"|{place}" if place else ""))
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {encoded(url)}"] if url is not None else []),
        *([f"Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n", len(body), digest


def info(file: str, date: str = DATE) -> bytes:
    body = b"software: quillgraph\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>",
        f"WARC-Date: {date}",
        f"WARC-Filename: {file}",
        f"WARC-Block-Digest: {sha1(body)}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def key(url: str | None, page_id: int | None, digest: str) -> bytes:
    """Bytes that sort as the records do."""
    return (url or "").encode("utf-8", "replace") + b"\0" + (0 if page_id is None else page_id + (1 << 63)).to_bytes(8) + digest.encode()


def bounds(keyed: DataFrame, shard_bytes: int) -> list[bytes]:
    """Upper keys of all shards but the last: of each run of ``shard_bytes`` in the sorted sample, by prefix sums over its partitions."""
    total, n = keyed.agg(F.sum("size"), F.count("*")).first()
    shards = -(-(total or 0) // shard_bytes)
    if shards <= 1:
        return []
    every = max(1, n // (shards * SAMPLED))
    sample = keyed.where(F.pmod("pick", F.lit(every)) == 0).select(F.coalesce("url", F.lit("")).alias("u"), "page_id", "digest", "size")
    sample = cut(sample.orderBy("u", "page_id", "digest").withColumn("part", F.spark_partition_id()))
    sums = {r.part: r.s for r in sample.groupBy("part").agg(F.sum("size").alias("s")).collect()}
    before, done = {}, 0
    for part in sorted(sums):
        before[part] = done
        done += sums[part]
    step = done / shards

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for b in batches:
            out = []
            for u, i, d, size, part in zip(*[c.to_pylist() for c in b.columns]):
                old = at.get(part, before[part])
                at[part] = old + size
                if int((old + size) / step) > int(old / step) and old + size < done:
                    out.append(key(u, i, d))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["k"])

    # each part was sorted when it was written; sorting it again makes the sums independent of how its file is read
    placed = sample.select("u", "page_id", "digest", "size", "part").repartition("part").sortWithinPartitions("part", "u", "page_id", "digest")
    return sorted({bytes(r.k) for r in placed.mapInArrow(pick, "k binary").collect()})


def write(
    pages: DataFrame,
    path: str,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to the folder ``path``; the index, one row for each record."""
    spark = pages.sparkSession
    records = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.md5(F.coalesce("html", F.lit("")))
    keyed = records.select(
        "url", "page_id", digest.alias("digest"), (F.octet_length(F.coalesce("html", F.lit(""))) + 500).cast("bigint").alias("size")
    ).withColumn("pick", F.xxhash64("url", "page_id", "digest"))
    # of equal records that fill a shard there are no more kinds than shards
    alike = keyed.groupBy("url", "page_id", "digest").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    heavy = [(r.url, r.page_id, r.digest, r.copies, r.size) for r in alike.where(F.col("copies") * F.col("size") > 2 * shard_bytes).collect()]
    if heavy:
        gone = spark.createDataFrame(heavy, "url string, page_id bigint, digest string, copies bigint, size bigint")
        same = lambda a: F.col(f"g.{a}").eqNullSafe(F.col(f"k.{a}"))
        keyed = keyed.alias("k").join(F.broadcast(gone.alias("g")), same("digest") & same("url") & same("page_id"), "left_anti")
    upper = bounds(keyed, shard_bytes)
    extra = {(u, i, d): (n, max(1, shard_bytes // size)) for u, i, d, n, size in heavy}
    first_extra, at = {}, len(upper) + 1
    for k in sorted(extra, key=lambda k: key(*k)):
        first_extra[k] = at
        at += -(-extra[k][0] // extra[k][1])
    shards = at

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keep, shard, low, high = [], [], [], []
            for row, k in enumerate(zip(*[b.column(c).to_pylist() for c in ("url", "page_id", "digest")])):
                if k not in extra:
                    keep.append(row), shard.append(bisect.bisect_left(upper, key(*k))), low.append(0), high.append(0)
                elif k not in seen:  # each task sends one row for each of the shards; the writer takes the first
                    seen.add(k)
                    n, each = extra[k]
                    for j, lo in enumerate(range(0, n, each)):
                        keep.append(row), shard.append(first_extra[k] + j), low.append(lo), high.append(min(n, lo + each))
            columns = [b.column(c).take(pa.array(keep, pa.int64())) for c in ("page_id", "url", "html", "digest")]
            columns += [pa.array(shard, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "html", "digest", "shard", "low", "high"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        attempt = f"{root}/_temporary/{uuid.uuid4().hex}"
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["page_id", "url", "file", "offset", "length", "payload_bytes", "digest"]
        rows: list[tuple] = []
        held: list[bytes] = []
        size = number = 0
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, size, number
            if rows:
                system.create_dir(attempt)
                name = rows[0][2]
                with system.open_output_stream(f"{attempt}/{name}", compression=None) as out:
                    for data in held:
                        out.write(data)
                rename(system, f"{attempt}/{name}", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows, held, size = [], [], 0
            number += 1

        last, again = None, 0
        for b in batches:
            for shard, url, page_id, html, digest, low, high in zip(*[b.column(c).to_pylist() for c in ("shard", "url", "page_id", "html", "digest", "low", "high")]):
                if shard != now:
                    yield from close()
                    now, number, last = shard, 0, None
                same = (url, page_id, digest) == last
                if high and same:
                    continue
                last, again = (url, page_id, digest), again + 1 if same else 0
                for count in range(low, high) if high else (again,):
                    data, payload, sha = record(page_id, url, html, date, count)
                    data = member(data)
                    if rows and size + len(data) > file_bytes:
                        yield from close()
                    file = f"part-{shard:06d}-{number:05d}.warc.gz"
                    if not rows:
                        held = [member(info(file, date))]
                        size = len(held[0])
                    rows.append((page_id, url, file, size, len(data), payload, sha))
                    held.append(data)
                    size += len(data)
        yield from close()
        if system.get_file_info(attempt).type != fs.FileType.NotFound:
            system.delete_dir(attempt)

    placed = records.withColumn("digest", digest).mapInArrow(place, "page_id bigint, url string, html string, digest string, shard int, low bigint, high bigint")
    ranged = placed.repartitionById(shards, "shard").sortWithinPartitions("shard", F.coalesce("url", F.lit("")), "page_id", "digest", "url")
    fs_root(spark, path, True)
    index = cut(ranged.mapInArrow(save, INDEX))
    manifest = index.groupBy("file").agg(
        F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes"), F.min(F.struct("url", "page_id")).alias("first")
    )
    manifest.write.json(f"{path}/_manifest.tmp")
    system, root = fs_root(spark, path)
    system.rename(root.suffix("/_manifest.tmp"), root.suffix("/_manifest"))
    return index


def rename(system, source: str, target: str) -> None:
    """Give a complete file its name, unless another attempt has done so with the same bytes."""
    taken = lambda: system.get_file_info(target).type != fs.FileType.NotFound
    if not taken():
        try:
            system.move(source, target)
            return
        except OSError:  # some file systems refuse a name that another attempt took just now
            if not taken():
                raise
    system.delete_file(source)


def fs_root(spark: SparkSession, path: str, make: bool = False):
    """The Hadoop file system of a path and the path; raises if ``make`` and output is already there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    if make:
        if system.exists(root.suffix("/_manifest")):
            raise FileExistsError(path)
        system.mkdirs(root)
    return system, root


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html, digest_ok`` of the records in the files of the manifest."""
    listed = spark.read.schema("file string").json(f"{path}/_manifest").select("file")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for file in b.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    data = gzip.decompress(stream.read())
                rows, at = [], 0
                while at < len(data):
                    split = data.index(b"\r\n\r\n", at)
                    head = dict(line.split(": ", 1) for line in data[at:split].decode("utf-8", "replace").split("\r\n")[1:])
                    body = data[split + 4 : split + 4 + int(head["Content-Length"])]
                    at = split + 8 + len(body)
                    if head["WARC-Type"] == "resource":
                        i = head.get("Page-ID")
                        ok = sha1(body) == head["WARC-Payload-Digest"]
                        rows.append((None if i is None else int(i), head.get("WARC-Target-URI"), body.decode("utf-8", "replace"), ok))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "html", "digest_ok"])

    return listed.mapInArrow(load, "page_id bigint, url string, html string, digest_ok boolean")
