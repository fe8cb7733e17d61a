"""Text expressions: normalisation, extraction of entities and concepts, overlaps. All of them stay in the JVM.

Nulls give nulls for scalars and empty arrays for extractions. The JVM's matcher
recurses once for each repeat of a group, unless the repeat is possessive; so
the reference's unbounded groups are written as possessive ones that match the
same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STOP = (
    "a an and are as at be been but by can could did do does for from had has have he her hers him his in is it its may might must of on or she should"
    " that the their them these they they'd they'll they're they've this those to was were what which who whom whose will with would"
).split()
QUERY_STOP = "a about an and are at but by find for from how in is me of on or show tell the to was were what when where who why with".split()
TERM_STOP = (
    "a about an and are as at be been but by can could did do does for from had has have how in is may me might must of on or should tell the to was"
    " were what when where which who why will with would"
).split()
_MONTHS = "january february march april may june july august september october november december".split()
_M = "|".join(m.capitalize() for m in _MONTHS)

#: Patterns of each entity type; case does not matter in any of them. They and the lists above are constants of the format. Extraction puts UNBOUNDED in the place of some.
PATTERNS: dict[str, list[str]] = {
    "DATE": [r"\b\d{4}\b", rf"\b(?:{_M})\s+\d{{1,2}},?\s+\d{{4}}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\bq[1-4]\s+\d{4}\b", r"\b(?:fiscal year|fy)\s*\d{4}\b"],
    "ORG": [r"\b[a-z]{2,}(?:\s+[a-z]{2,})*\s+(?:llc|ltd|limited|inc|corporation|corp|company)\b", r"\b(?:the\s+)?[a-z]{2,}\s+(?:institute|foundation|association|group|bank)\b"],
    "MONEY": [r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?(?:\s*(?:trillion|billion|million|t|b|m))?\b", r"\b\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:rupees|inr|usd|dollars)\b"],
    "PERCENT": [r"\b\d+(?:\.\d+)?%\b", r"\b\d+(?:\.\d+)?\s*percent\b"],
}
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b"
SEVERAL_CAPITALISED = r"\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++"
#: A run of two or more words, and its part up to the last word that names a form of company: the longest match of the reference's pattern.
_RUN, _TO_FORM = r"(?i)\b[a-z]{2,}+(?:\s++[a-z]{2,}+\b)++", r"(?is)^.*\s(?:llc|ltd|limited|inc|corporation|corp|company)\b"
_TAIL = r"(?:\.\d{2})?(?:\s*(?:trillion|billion|million|t|b|m))?\b"
#: What stands for some of PATTERNS, by kind and place. A thousands group is taken only where the rest can follow it.
UNBOUNDED: dict[tuple[str, int], str] = {
    ("MONEY", 0): rf"\$\s*\d+(?:,\d{{3}}(?={_TAIL}))*+{_TAIL}",
    ("MONEY", 1): r"\b\d+(?:,\d{3})*+(?:\.\d{2})?\s*(?:rupees|inr|usd|dollars)\b",
}
TECHNICAL = r"\b[A-Z]{2,}\b|\b[a-z]+[A-Z][a-zA-Z]*\b|\b[a-z]+-[a-z]+\b"
LONG_WORD = r"\b[a-zA-Z]{6,}\b"


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def normalize(text: Column) -> Column:
    """Lower case, one blank for each run of (Unicode) blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_query(text: Column) -> Column:
    return normalize(F.regexp_replace(text, r"(?U)[^\w\s\-'.]", " "))


def _not_all_stop(phrase: Column) -> Column:
    return F.exists(F.split(F.lower(phrase), r"\s+"), lambda w: ~w.isin(STOP))


def capitalised(text: Column) -> Column:
    return F.array_distinct(F.filter(matches(text, CAPITALISED), _not_all_stop))


def _found(text: Column, kind: str, place: int) -> Column:
    if (kind, place) == ("ORG", 0):
        return F.filter(F.transform(matches(text, _RUN), lambda run: F.regexp_extract(run, _TO_FORM, 0)), lambda e: e != "")
    return matches(text, "(?i)" + UNBOUNDED.get((kind, place), PATTERNS[kind][place]))


def pattern_entities(text: Column, kind: str) -> Column:
    found = F.array_union(_found(text, kind, 0), F.array().cast("array<string>"))
    for place in range(1, len(PATTERNS[kind])):
        found = F.array_union(found, _found(text, kind, place))
    return F.filter(found, lambda e: F.length(e) > 1)


def entities(text: Column) -> Column:
    """Distinct entity texts: patterns of all types, then capitalised phrases."""
    out = pattern_entities(text, "DATE")
    for kind in list(PATTERNS)[1:]:
        out = F.array_union(out, pattern_entities(text, kind))
    return F.array_union(out, capitalised(text))


def concepts(text: Column) -> Column:
    """Distinct terms of a document: capitalised phrases, technical terms, long words in lower case."""
    long = F.filter(F.transform(matches(text, LONG_WORD), F.lower), lambda w: ~w.isin(STOP))
    found = F.array_union(F.array_union(matches(text, SEVERAL_CAPITALISED), matches(text, TECHNICAL)), long)
    return F.filter(found, lambda c: F.length(c) > 3)


def query_entities(text: Column) -> Column:
    keywords = F.filter(matches(text, r"\b[a-zA-Z]+\b"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(QUERY_STOP))
    return F.array_union(entities(text), keywords)


def entity_type(text: Column) -> Column:
    """ORG, DATE, MONEY, PERCENT, PERSON or UNKNOWN, by the first rule that holds."""
    low, bare = F.lower(text), F.regexp_replace(text, "[ ,%]", "")
    has = lambda *xs: F.array_max(F.array(*[F.contains(low, F.lit(x)) for x in xs]))
    return (
        F.when(has("group", "company", "llc", "ltd", "corp", "inc"), "ORG")
        .when(bare.rlike("^[0-9]+$"), F.when(F.length(text) == 4, "DATE").otherwise("MONEY"))
        .when(F.contains(text, F.lit("%")), "PERCENT")
        .when(has("$", "million", "billion"), "MONEY")
        .when(has(*_MONTHS, "q1", "q2", "q3", "q4"), "DATE")
        .when(text.rlike("^[A-Z]") & (F.size(words(text)) <= 3), "PERSON")
        .otherwise("UNKNOWN")
    )


def text_overlap(query: Column, entity: Column) -> Column:
    """1 if either contains the other; else the share of the entity's words that the query has, from one half on."""
    mine = F.array_distinct(words(entity))
    share = F.size(F.array_intersect(F.array_distinct(words(query)), mine)) / F.size(mine)
    return (
        F.when(F.contains(query, entity) | F.contains(entity, query), 1.0)
        .when(F.size(mine) == 0, 0.0)
        .when(share >= 0.5, share)
        .otherwise(0.0)
    )


def string_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0.9 for containment, else shared characters over the longer length."""
    a, b = F.trim(F.lower(a)), F.trim(F.lower(b))
    shared = F.size(F.array_intersect(F.split(a, ""), F.split(b, "")))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.when(longer == 0, 0.0).otherwise(1.0)).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(shared / longer)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
