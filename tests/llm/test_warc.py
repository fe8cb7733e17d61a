import gzip
import os
import random

from quillgraph.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def pages(n=300, seed=2):
    rng = random.Random(seed)
    return [(i, f"http://h{rng.randint(0, 40)}.example.com/{rng.randint(0, 9)}", "<p>" + "".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 900))) + "</p>") for i in range(n)]


def files(path):
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".gz")}


def test_round_trip_order_and_rolling(spark, tmp_path):
    data, path = pages(), f"file://{tmp_path}/a"
    index = warc.write(spark.createDataFrame(data, SCHEMA).repartition(5), path, shard_bytes=40_000, file_bytes=9_000).collect()
    back = warc.read(spark, path).collect()
    assert sorted((r.page_id, r.url, r.html) for r in back) == sorted(data) and all(r.digest_ok for r in back)
    written = files(f"{tmp_path}/a")
    assert len({f.split("-")[1] for f in written}) > 3 and all(len(b) <= 9_000 for b in written.values())
    order = [r.url for r in sorted(index, key=lambda r: (r.file, r.offset))]
    assert order == sorted(order)
    for r in index:
        text = gzip.decompress(written[r.file][r.offset : r.offset + r.length]).decode()
        assert f"Page-ID: {r.page_id}\r\n" in text and f"WARC-Payload-Digest: {r.digest}\r\n" in text
    ends = {f: max(r.offset + r.length for r in index if r.file == f) for f in written}
    assert ends == {f: len(b) for f, b in written.items()}
    assert os.listdir(f"{tmp_path}/a/_temporary") == []


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    for k, n in enumerate((1, 7)):
        warc.write(df.repartition(n), f"file://{tmp_path}/{k}", shard_bytes=40_000, file_bytes=9_000)
    assert files(f"{tmp_path}/0") == files(f"{tmp_path}/1")


def ids(path):
    out = []
    for data in files(path).values():
        out += [line for line in gzip.decompress(data).decode("utf-8", "replace").split("\r\n") if line.startswith("WARC-Record-ID")]
    return out


def test_equal_records_of_any_number(spark, tmp_path):
    """A third of all rows are one record: it fills shards of its own, whatever the partitions, and every copy has an id."""
    data = pages(200) + [(7, "http://hot.example.com", "hot " * 100)] * 100 + [(8, "http://twice.example.com", "x")] * 2
    df = spark.createDataFrame(data, SCHEMA)
    for k, n in enumerate((1, 6)):
        index = warc.write(df.repartition(n), f"file://{tmp_path}/{k}", shard_bytes=15_000, file_bytes=9_000).collect()
        assert sorted((r.page_id, r.url, r.html) for r in warc.read(spark, f"file://{tmp_path}/{k}").collect()) == sorted(data)
        assert len({r.file.split("-")[1] for r in index if r.page_id == 7 and "hot" in r.url}) > 3
    assert files(f"{tmp_path}/0") == files(f"{tmp_path}/1")
    found = ids(f"{tmp_path}/0")
    assert len(found) == len(set(found)) == len(data) + len(files(f"{tmp_path}/0"))


def test_shards_are_about_equal(spark, tmp_path):
    index = warc.write(spark.createDataFrame(pages(3000), SCHEMA), f"file://{tmp_path}/b", shard_bytes=100_000).collect()
    size = {}
    for r in index:
        shard = r.file.split("-")[1]
        size[shard] = size.get(shard, 0) + r.payload_bytes + 500
    assert len(size) >= 15 and max(size.values()) < 250_000


def test_a_repeated_task_keeps_the_name(tmp_path):
    system = warc.fs.LocalFileSystem()
    for text in ("one", "one"):
        (tmp_path / "a").write_text(text)
        warc.rename(system, f"{tmp_path}/a", f"{tmp_path}/b")
        assert not (tmp_path / "a").exists() and (tmp_path / "b").read_text() == "one"


def test_edges_of_the_input(spark, tmp_path):
    rows = [(None, "u", "x"), (1, None, "y"), (2, "a b\r\nc", None), (3, "", ""), (4, "u", "z" * 3_000_000), (4, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("file", warc.F.lit(1)).withColumn("shard", warc.F.lit("s"))
    path = f"file://{tmp_path}/e"
    assert warc.write(df, path).count() == 6
    got = sorted((r.page_id or 0, r.url, len(r.html)) for r in warc.read(spark, path).collect())
    assert got == [(0, "u", 1), (1, None, 1), (2, "a%20b%0D%0Ac", 0), (3, "", 0), (4, "u", 3_000_000), (4, "u", 3_000_000)]
    assert warc.write(df.limit(0), f"file://{tmp_path}/0").count() == 0
    assert warc.read(spark, f"file://{tmp_path}/0").count() == 0
