"""Edge weights of terms in passages: frequency, position, type and context of their mentions.

A term's weight is ``.35 tf idf + .25 position + .20 type + .20 context``,
raised by a tenth for each further mention (a fifth at most) and capped at 1;
a term that isn't in its passage has weight 0. Mentions are found without
overlap, whatever the case. Nulls have no weight; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import cut
from .contain import PREFIX, contained

TYPE_WEIGHTS = {"CONCEPT": 0.75, "DATE": 0.8, "LOC": 0.85, "LOCATION": 0.85, "MONEY": 0.85, "ORG": 0.9, "ORGANIZATION": 0.9, "PERCENT": 0.8, "PERSON": 0.95}
OTHER_TYPE = 0.7
#: Words that make a mention's surroundings telling; they are sought in lower case, so the one in capitals is never found.
KEYWORDS = (
    "CEO acquired announced chairman created declared decrease developed director founder growth increase initiative introduced launched leader"
    " partnership performance plan president profit project reported revenue said stated strategy"
).split()
WINDOW = 50
#: Characters by which terms meet texts, if all terms have so many.
KEY = 12
#: Runs of blanks, as the JVM has them in Unicode.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def mentions(text: Column, term: Column) -> Column:
    """Starts (from 0) of the mentions of a term, left to right, none overlapping: ends of the pieces between them."""
    pieces = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.replace(F.lower(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    step = F.length(F.lower(term))
    heads = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    place = F.aggregate(
        heads,
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + F.length(x) + step).cast("int").alias("at"), F.concat(a["starts"], F.array((a["at"] + F.length(x)).cast("int"))).alias("starts")),
    )
    return F.when((F.length(term) > 0) & text.isNotNull(), place["starts"]).otherwise(F.array().cast("array<int>"))


def _starts(low: str, term: str) -> list[int]:
    """The same of a text and a term in lower case."""
    out, at = [], low.find(term) if term else -1
    while at >= 0:
        out.append(at)
        at = low.find(term, at + len(term))
    return out


def term_frequency(n: Column, words: Column) -> Column:
    return F.when(words == 0, 0.0).otherwise(F.least(F.lit(1.0), 10.0 * n / words))


def inverse_frequency(df: Column, passages: Column) -> Column:
    return F.when((passages <= 1) | F.coalesce(df == 0, F.lit(True)), 1.0).otherwise(F.ln(passages / df) / F.ln(passages.cast("double")))


def position(start: int, length: int) -> float:
    """High at both ends of the text, low in the middle."""
    r = start / length
    return 0.9 if r < 0.2 or r > 0.8 else 0.7 if r < 0.4 or r > 0.6 else 0.5


def context(text: str, start: int, term: str) -> float:
    """Portion of telling words among those around a mention, five-fold, capped at 1."""
    around = text[max(start - WINDOW, 0) : min(len(text), start + len(term) + WINDOW)].lower()
    return min(1.0, 5.0 * sum(k in around for k in KEYWORDS) / max(1, sum(w != "" for w in BLANK.split(around))))


def type_weight(kind: Column) -> Column:
    out = F.lit(OTHER_TYPE)
    for name, w in TYPE_WEIGHTS.items():
        out = F.when(kind == name, w).otherwise(out)
    return out


def document_frequency(terms: DataFrame, passages: DataFrame) -> DataFrame:
    """``term, df``: passages whose text contains each distinct term, whatever the case; met by an equality join, never all with all."""
    t = cut(terms.select("term", F.lower("term").alias("t")).where("t <> ''").distinct())
    # a text's passages are counted before it is cut up, so equal texts are one
    p = cut(passages.where("content IS NOT NULL").groupBy(F.lower("content").alias("c")).agg(F.countDistinct("passage_id").alias("n")).withColumn("h", F.monotonically_increasing_id()))
    least = t.agg(F.min(F.length("t"))).first()[0]
    met = contained(t.select("t"), p.select("c", "h"), max(PREFIX, min(least or 0, KEY)), long=True)
    return met.withColumnRenamed("inner", "t").join(p.select("h", "n"), "h").groupBy("t").agg(F.sum("n").alias("df")).join(t, "t").select("term", "df")


def edge_weights(passages: DataFrame, terms: DataFrame) -> DataFrame:
    """``passage_id, term, mentions, tf, idf, position, type, context, weight`` of ``terms(passage_id, term, kind)`` in ``passages(passage_id, content)``."""
    n = passages.count()
    one = terms.where("term IS NOT NULL").groupBy("passage_id", "term").agg(F.max("kind").alias("kind"))
    df = document_frequency(one.select("term"), passages)
    # what a text has for all of its terms is taken from it once, and a text moves once
    asked = one.join(df, "term", "left").groupBy("passage_id").agg(F.collect_list(F.struct("term", F.lower("term").alias("t"), "kind", "df")).alias("terms"))
    texts = passages.select("passage_id", "content", F.lower("content").alias("low"), F.size(T.words(F.col("content"))).alias("words"))
    kind = passages.schema["passage_id"].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                at, rows = [], []
                for i, (text, low, terms) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 4)))):
                    for x in terms:
                        starts = _starts(low, x["t"]) if low is not None else []
                        at.append(i)
                        rows.append((x["term"], x["kind"], x["df"], len(starts), max((position(s, len(text)) for s in starts), default=0.0), max((context(text, s, x["t"]) for s in starts), default=0.0)))
                took, columns = pa.array(at, pa.int64()), list(zip(*rows)) or [()] * 6
                values = [part.column(0).take(took), part.column(3).take(took), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]]
                yield pa.RecordBatch.from_arrays(values, names=["passage_id", "words", "term", "kind", "df", "mentions", "position", "context"])

    found = texts.join(asked, "passage_id").select("passage_id", "content", "low", "words", "terms").mapInArrow(find, f"passage_id {kind.simpleString()}, words int, term string, kind string, df bigint, mentions bigint, position double, context double")
    parts = found.select(
        "passage_id", "term", "mentions", term_frequency(F.col("mentions"), F.col("words")).alias("tf"), inverse_frequency(F.col("df"), F.lit(n)).alias("idf"), "position", type_weight(F.col("kind")).alias("type"), "context"
    )
    # in decimals, since 0.2 * 0.7 is less than 0.14 in doubles and would push sums that end in a 5 below it
    kind = (F.col("type").cast("decimal(3,2)") * F.lit(Decimal("0.2"))).cast("double")
    plain = 0.35 * F.col("tf") * F.col("idf") + 0.25 * F.col("position") + kind + 0.2 * F.col("context")
    many = F.when(F.col("mentions") > 1, F.least(F.lit(1.2), 1 + 0.1 * (F.col("mentions") - 1))).otherwise(1.0)
    return parts.withColumn("weight", F.when(F.col("mentions") == 0, 0.0).otherwise(F.least(F.lit(1.0), plain * many)))


def passage_weights(spark, text: str, entities: list[str], concepts: list[str], all_passages: list[str] | None = None, types: dict[str, str] | None = None) -> dict[str, float]:
    """Weights of the terms of one passage, among ``all_passages`` if given."""
    others = [t for t in (all_passages if all_passages is not None else [text])]
    rows = [(i, t) for i, t in enumerate(others)]
    mine = next((i for i, t in rows if t == text), len(rows))
    passages = spark.createDataFrame(rows if mine < len(rows) else [*rows, (mine, text)], "passage_id bigint, content string")
    terms = spark.createDataFrame([(mine, t, (types or {}).get(t, "UNKNOWN")) for t in [*entities, *concepts]], "passage_id bigint, term string, kind string")
    return {r.term: r.weight for r in edge_weights(passages, terms).collect()}
