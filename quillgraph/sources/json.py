"""JSON ingestion: structure sniffing, rules, composition of contents, metadata.

A rule names the fields that hold content, how they are put together, where
metadata lie and how they are renamed. Files are read whole, one record for
each, and items are worked on as VARIANT-like JSON texts, so files of
different shapes can be read by one job. A file that isn't JSON gives no
passage; an item without any content field or with too short a content gives
none; a field that is null is the text ``None`` in a content, as in the
format. Each row has its own metadata, the item's winning over the file's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CONTENT_FIELDS = ("content", "text", "body", "message")
PASSAGE = "content string, content_hash string, rule string, item bigint, document_metadata map<string,string>, passage_metadata map<string,string>, original string"


@dataclass(frozen=True)
class Rule:
    content_fields: tuple[str, ...]
    metadata_fields: dict[str, str] = field(default_factory=dict)
    document_path: str | None = None
    passage_path: str | None = None
    combine: bool = True
    separator: str = "\n\n"
    min_length: int = 10


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


RULES = {
    "chunk_array": Rule(("content",), _same("chunk_id", "chunk_type", "token_count", "artifact_type", "document_position"), document_path="document_metadata", min_length=30),
    "qa_format": Rule(
        ("question", "answer", "text"), {f"{x}_name": x for x in ("speaker", "answerer", "questioner")} | {"type": "interaction_type"}, separator="\n\nQ: ", min_length=30
    ),
    "simple_content": Rule(CONTENT_FIELDS, _same("id", "title", "author", "timestamp", "source"), min_length=30),
    "nested_chunks": Rule(("content",), {"type": "content_type", "id": "chunk_id"}, document_path="metadata.document", passage_path="metadata.passage", min_length=30),
}


def sniff(data: object) -> str:
    """The name of the rule that fits some JSON, by its first item."""
    if isinstance(data, list):
        first = data[0] if data else None
        if not isinstance(first, dict):
            return "simple_content"
        if {"content", "document_metadata"} <= first.keys():
            return "chunk_array"
        return "qa_format" if first.keys() & {"question", "answer"} else "simple_content"
    if isinstance(data, dict):
        if "chunks" in data:
            chunks = data["chunks"]
            if isinstance(chunks, list) and chunks:
                return "qa_format" if any(k in chunks[0] for k in ("question", "answer", "type")) else "chunk_array"
        elif data.keys() & {"metadata", "document_info"}:
            return "nested_chunks"
    return "simple_content"


def at_path(data: object, path: str) -> object:
    """What lies at a dot path; None where it breaks off."""
    for key in path.split("."):
        if not isinstance(data, dict) or key not in data:
            return None
        data = data[key]
    return data


def compose(parts: list[str], rule: Rule, item: dict) -> str:
    """The content of an item, with those who speak.

    Question and answer, if the rule has both and two parts are there; one
    part of a rule with ``text`` said by ``speaker_name``; several parts
    joined; or one part. The last two are headed by a speaker if one is named.
    """
    if rule.combine and len(parts) > 1 and {"question", "answer"} <= set(rule.content_fields):
        return f"{item.get('questioner_name', 'Unknown')} asked: {parts[0]}\n\n{item.get('answerer_name', 'Unknown')} answered: {parts[1]}"
    if "speaker_name" in item and "text" in rule.content_fields and len(parts) == 1:
        return f"{item['speaker_name']} said: {parts[0]}"
    joined = rule.combine and len(parts) > 1
    text = rule.separator.join(parts) if joined else parts[0]
    names = ("speaker_name", "author", "answerer_name") if joined else ("speaker_name", "author", "answerer_name", "questioner_name")
    who = next((item[n] for n in names if item.get(n)), None)
    return f"{who}: {text}" if who and (joined or not text.startswith(str(who))) else text


def items_of(data: object) -> list:
    if isinstance(data, dict):
        return data["chunks"] if isinstance(data.get("chunks"), list) else [] if "chunks" in data else [data]
    return data if isinstance(data, list) else []


def _flat(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def passages_of(data: object, rule: Rule, document: dict | None = None) -> list[tuple[str, int, dict, dict, dict]]:
    """``(content, item number, document metadata, passage metadata, item)`` of the items of some JSON."""
    out = []
    for i, item in enumerate(items_of(data)):
        parts = [str(item[f]) for f in rule.content_fields if f in item] if isinstance(item, dict) else []
        if not parts:
            continue
        content = compose(parts, rule, item)
        if len(content.strip()) < rule.min_length:
            continue
        doc, own = dict(document or {}), {"original_index": i}
        for path, into in ((rule.document_path, doc), (rule.passage_path, own)):
            found = at_path(item, path) if path else None
            if isinstance(found, dict):
                into.update(found)
        own.update({to: item[f] for f, to in rule.metadata_fields.items() if f in item})
        if "source_file" not in doc and "source" not in doc:
            doc["source"] = "unknown"
        out.append((content, i, doc, own, item))
    return out


def ingest(documents: DataFrame, rule: str | Rule | None = None, batch: bool = False) -> DataFrame:
    """Passages of ``documents(value[, source_file, source_path, file_size])``, each a whole JSON text: a given rule, a named one, or the one that fits."""
    if isinstance(rule, str):
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule!r}; there are {sorted(RULES)}")
        rule = RULES[rule]
    about = [c for c in ("source_file", "source_path", "file_size") if c in documents.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, *about_ in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    data = json.loads(text)
                except (TypeError, ValueError):
                    continue
                name = sniff(data) if rule is None else next((n for n, r in RULES.items() if r == rule), "custom")
                doc = dict(zip(about, about_)) | ({"batch_processing": True} if batch else {})
                for content, i, d, own, item in passages_of(data, rule or RULES[name], doc):
                    rows.append((content, None, name, i, *[[(str(k), _flat(v)) for k, v in m.items()] for m in (d, own)], _flat(item)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["content", "content_hash", "rule", "item", "document_metadata", "passage_metadata", "original"])

    return documents.select("value", *about).mapInArrow(run, PASSAGE).withColumn("content_hash", F.md5("content"))


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value, source_file, source_path, file_size`` of whole JSON files."""
    many = [paths] if isinstance(paths, str) else paths
    raw = spark.read.text(many, wholetext=True)
    meta = F.col("_metadata")
    return raw.select("value", meta["file_name"].alias("source_file"), meta["file_path"].alias("source_path"), meta["file_size"].cast("string").alias("file_size"))


def ingest_files(spark: SparkSession, paths: str | list[str], rule: str | Rule | None = None) -> DataFrame:
    """Passages of JSON files, those of several files marked so."""
    return ingest(read_json(spark, paths), rule, batch=not isinstance(paths, str) and len(paths) > 1)


def custom_rule(content_fields: list[str], metadata_fields: dict[str, str] | None = None, **more) -> Rule:
    return replace(Rule(tuple(content_fields), dict(metadata_fields or {})), **more)


def estimate(data: object) -> int:
    """How many passages some JSON may have: its items; 1 for any other."""
    return len(data) if isinstance(data, list) else len(data["chunks"]) if isinstance(data, dict) and isinstance(data.get("chunks"), list) else 1


def preview(documents: DataFrame, most: int = 3) -> dict:
    """The structure of the first of some JSON texts: rule, number of items, fields, scalar metadata fields and the first items."""
    row = documents.select("value").first()
    try:
        data = json.loads(row[0]) if row else None
    except ValueError as e:
        return {"error": str(e)}
    items = [i for i in items_of(data) if isinstance(i, dict)]
    scalar = sorted({k for i in items for k, v in i.items() if k not in ("content", "text", "body") and isinstance(v, (str, int, float, bool))})
    return {"rule": sniff(data), "items": estimate(data) if row else 0, "fields": sorted({k for i in items for k in i}), "metadata_fields": scalar, "sample": items[:most]}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``content, metadata`` (JSON text) of the records of JSON files, whatever content field they use.

    A record's own ``metadata`` comes first, then all other fields that aren't content.
    """
    df = spark.read.option("multiLine", True).json(path)
    present = [c for c in CONTENT_FIELDS if c in df.columns]
    if not present:
        raise ValueError(f"no content field among {df.columns}")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in present and c != "metadata"]
    metadata = F.to_json("metadata") if "metadata" in df.columns and not rest else F.to_json(F.struct(*rest, *([F.col("metadata")] if "metadata" in df.columns else []))) if rest else F.lit("{}")
    return df.select(F.coalesce(*[F.col(c).cast("string") for c in present]).alias("content"), F.coalesce(metadata, F.lit("{}")).alias("metadata"))


def min_length(docs: DataFrame, column: str = "content", least: int = 10) -> DataFrame:
    """Rows whose text, without blanks at the ends, has at least so many characters; null texts have none."""
    return docs.where(F.length(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")) >= least)


def json_path(docs: DataFrame, column: str, **paths: str) -> DataFrame:
    """``docs`` with a column for each dot path into a JSON text; null where it is missing."""
    return docs.withColumns({name: F.get_json_object(column, f"$.{p}") for name, p in paths.items()})


def rename_metadata(metadata, names: dict[str, str]):
    """The entries of a map column whose keys are renamed, under their new names; others go."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(F.map_filter(metadata, lambda k, v: k.isin(list(names))), lambda k, v: known[k])


def compose_qa(turns: DataFrame) -> DataFrame:
    """One content for each conversation turn of a user that an assistant answers next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.where("role <> 'system'").withColumns({"answer": F.lead("text").over(w), "by": F.lead("role").over(w)})
    asked = nxt.where("role = 'user' AND `by` = 'assistant' AND text IS NOT NULL AND answer IS NOT NULL")
    return asked.select("conv_id", "turn", F.concat(F.lit("User asked: "), "text", F.lit("\n\nAssistant answered: "), "answer").alias("content"))
