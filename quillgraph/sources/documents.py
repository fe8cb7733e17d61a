"""Documents from files: discovery, texts, PDF, JSON of chunks, and the chunk table of all of them.

Files are found by extension, below folders at any depth, each once, and are
read in the tasks. Text is UTF-8, bytes that aren't are left out. A JSON file
that is a list of texts or of records with a content gives these as chunks;
any other JSON file is a text. PDF needs the optional library ``pypdf``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.chunk import split_text

EXTENSIONS = (".txt", ".md", ".rst", ".json")
CHUNKS = "content string, metadata map<string,string>, source string, signature string, chunk_index bigint"


def slug(name: Column, fallback: str = "graph") -> Column:
    """A name of letters, digits, dots, dashes and underscores, of 80 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", fallback).otherwise(clean), 1, 80)


def files(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``source, file_name, extension, size, modified, data`` of the files with these extensions, in any case."""
    allowed = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    found = raw.select(F.col("path").alias("source"), name.alias("file_name"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("data"))
    return found.where(F.col("extension").isin(allowed)).dropDuplicates(["source"])


def signature(size: int, overlap: int) -> Column:
    """A hash of a file's name, length and bytes, and of how it is cut."""
    return F.sha2(F.to_json(F.struct("file_name", "size", F.sha2("data", 256).alias("sha256"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"))), 256)


def pdf_text(data: bytes) -> str:
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the library pypdf") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    return "".join(f"\n\n[page {n}]\n{t}" for n, t in enumerate(pages, 1) if t.strip()).strip()


def json_chunks(text: str) -> list[tuple[str, dict]] | None:
    """Contents and metadata of a JSON list of texts or records with ``content`` or ``text``; None for anything else."""
    try:
        data = json.loads(text)
    except ValueError:
        return None
    out = []
    for i, item in enumerate(data if isinstance(data, list) else []):
        if isinstance(item, str):
            out.append((item, {"chunk_index": i}))
        elif isinstance(item, dict) and {"text", "content"} & item.keys():
            more = item.get("metadata")
            out.append((item["content"] if "content" in item else item["text"], {"chunk_index": i} | (more if isinstance(more, dict) else {})))
    return out or None


def _plain(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def chunk_files(found: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """``content, metadata, source, signature, chunk_index``: the chunks of :func:`files`, numbered in each file."""
    split_text("", size, overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, name, ext, data, sign in zip(*[c.to_pylist() for c in b.columns]):
                text = pdf_text(data) if ext == ".pdf" else data.decode("utf-8", "ignore")
                given = json_chunks(text) if ext == ".json" else None
                if given is not None:
                    rows += [(c, {"source": source} | m, source, sign, i) for i, (c, m) in enumerate(given) if c is not None]
                    continue
                about = {"source": source, "file_name": name, "extension": ext}
                rows += [(c, about | {"local_chunk_index": i, "start_char": s, "end_char": e}, source, sign, i) for i, (c, s, e) in enumerate(split_text(text, size, overlap))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int64()]
            columns[1] = [[(k, _plain(v)) for k, v in m.items()] for m in columns[1]]
            columns[0] = [_plain(c) for c in columns[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["content", "metadata", "source", "signature", "chunk_index"])

    return found.select("source", "file_name", "extension", "data", signature(size, overlap).alias("signature")).mapInArrow(cut, CHUNKS)


def load(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] = EXTENSIONS, size: int = 1200, overlap: int = 150) -> DataFrame:
    return chunk_files(files(spark, paths, extensions), size, overlap)


def coerce(document: object, index: int) -> dict:
    """A chunk ``{content, metadata}`` of a text, a dict with ``content`` or ``text``, or an object with ``page_content``."""
    if isinstance(document, str):
        return dict(metadata={"document_index": index}, content=document)
    if isinstance(document, dict):
        for key in ("content", "text"):
            if key in document:
                return {"content": document[key], "metadata": document.get("metadata") or {}}
        raise ValueError("a document dict needs 'content' or 'text'")
    content = getattr(document, "page_content", None)
    if content is None:
        raise TypeError("a document is a text, a dict with 'content' or 'text', or an object with 'page_content'")
    return {"content": content, "metadata": getattr(document, "metadata", None) or {}}


def frame(spark: SparkSession, chunks: list[dict]) -> DataFrame:
    """``content, metadata, chunk_index`` of chunk dicts; metadata as texts, nested ones as JSON."""
    rows = [(c.get("content", ""), {str(k): _plain(v) for k, v in (c.get("metadata") or {}).items()}, i) for i, c in enumerate(chunks)]
    return spark.createDataFrame(rows, "content string, metadata map<string,string>, chunk_index bigint")


Progress = Callable[[str, int, int], None]
