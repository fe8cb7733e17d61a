"""Sequential text chunking; each chunk's start depends on the last one's end, so it is an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_MANY_BREAKS = re.compile(r"\n{3,}")


def split_text(text: str | None, size: int = 1200, overlap: int = 150) -> list[tuple[str, int, int]]:
    """``(chunk, start, end)``; a chunk ends at a paragraph, sentence or line if one lies beyond 45 % of it.

    ``overlap`` must be smaller than 45 % of ``size``, so that every chunk makes progress.
    """
    if size <= 0 or overlap < 0 or overlap >= 0.45 * size:
        raise ValueError("overlap must be at least 0 and below 45 % of size")
    text = _MANY_BREAKS.sub("\n\n", text or "").strip()
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            window = text[at:end]
            best = max(window.rfind(mark) for mark in ("\n\n", ". ", "\n"))
            if best > 0.45 * size:
                end = at + best + 1
        piece = text[at:end]
        if piece.strip():
            out.append((piece.strip(), at, end))
        if end >= len(text):
            break
        at = max(end - overlap, 0)
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """``id, chunk_index, content, start, end`` of all chunks of all texts; null and blank texts have none."""
    split_text("", size, overlap)
    names = [id_col, "chunk_index", "content", "start", "end"]
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [split_text(t, size, overlap) for t in b.column(1).to_pylist()]
            pick = [i for i, f in enumerate(found) for _ in f]
            flat = [c for f in found for c in f]
            place = [k for f in found for k in range(len(f))]
            columns = [b.column(0).take(pa.array(pick, pa.int64())), pa.array(place, pa.int32()), pa.array([c[0] for c in flat], pa.string())]
            columns += [pa.array([c[k] for c in flat], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), text_col).mapInArrow(cut, f"`{id_col}` {kind}, chunk_index int, content string, start bigint, end bigint")
