"""Session helpers: session building, the shared folder, and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
PART_ROWS = 250_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session with UTC, AQE and Arrow on; extra ``conf`` keys are passed through."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quillgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent a private folder is made, but only for a
    ``local`` master: on a cluster a machine-local folder would be lost with
    its machine, so that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillgraph-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table in the shared folder and reread.

    A lost executor costs nothing that was written; the plan behind the
    returned DataFrame is one Parquet scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def parted(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is written meanwhile have a partition for each ``PART_ROWS`` of ``rows``, so that a task's share doesn't grow with them; never fewer than set."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(int(was), -(-rows // PART_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small file is often one partition, which leaves one core with all the work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def written(path: str) -> None:
    """Note a table or folder for :func:`drop_written`."""
    _WRITTEN.append(path)


def drop_written(spark: SparkSession) -> None:
    """Delete what :func:`cut` wrote and what :func:`written` noted; its readers end with it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _WRITTEN:
            drop_written(spark)
    except Exception:  # the JVM may be gone by now
        pass


atexit.register(_at_exit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
