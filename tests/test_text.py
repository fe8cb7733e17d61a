"""Extraction against the reference's patterns in Python's re."""

import random
import re

from pyspark.sql import functions as F
from quillgraph.functions import text as T

ORG = [r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|Corporation|Company|Ltd|Limited|LLC)\b", r"\b(?:the\s+)?[A-Z][a-z]+\s+(?:Bank|Group|Association|Foundation|Institute)\b"]
MONEY = [r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?(?:\s*(?:million|billion|trillion|M|B|T))?\b", r"\b\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:dollars|USD|INR|rupees)\b"]
SEVERAL = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"


def test_long_runs_are_the_entities_of_the_reference(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["words", "of", "Prose", "inc"]) for _ in range(n)) + " company then a list" for n in (1, 9, 10, 11, 100, 1000)]
    texts += ["Big " * n + "end" for n in (2, 401, 402, 1000)] + ["$1" + ",000" * n + tail for n in (1, 40, 41, 200) for tail in ("", "m", "m5", "5 usd", " usd", ".50 billion", "_", ",00")]
    bits = ["acme", "Foo", "Bar1", "a", "inc", "Inc.", "corp", "corporation", "incorporated", "company,", "the", "bank", "LLC2", "ltd-", "$", "$1", ",000", ",000", "12", ".50", "m", " million", "usd", "dollars", "_", "BazQux", "\n", "-"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(2, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    t = F.col("t")
    for r in df.select("id", T.pattern_entities(t, "ORG").alias("o"), T.pattern_entities(t, "MONEY").alias("m"), T.matches(t, T.SEVERAL_CAPITALISED).alias("s")).collect():
        want = lambda patterns: [e for e in dict.fromkeys(m.group() for p in patterns for m in re.finditer(p, texts[r.id], re.I)) if len(e) > 1]  # noqa: B023, E731
        assert (r.o, r.m, r.s) == (want(ORG), want(MONEY), re.findall(SEVERAL, texts[r.id])), texts[r.id][:200]
