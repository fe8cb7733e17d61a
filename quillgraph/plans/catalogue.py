"""Registry of the engine's own queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chunk, text as T
from ..operators import dedup, evaluate, graph, ppr, query as Q, retrieval, vectors, weights
from ..session import cut, table
from ..sources import cache, json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows if there is one."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passages, parts as concepts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("passage_id"), F.col("l_partkey").alias("concept_id")).distinct()


_EDGES = "SELECT DISTINCT l_orderkey AS passage_id, l_partkey AS concept_id FROM lineitem"
#: Letters and digits beyond ASCII become an ASCII word character, since DuckDB's word boundaries know no others. The queries read the texts as they are.
_MASK = "regexp_replace(text, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM]', '_', 'g')"


def _counted(docs: DataFrame, found, name: str) -> DataFrame:
    return docs.select(F.explode(found).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


@query("normalize_concepts", "SELECT lower(trim(p_name)) AS concept_id, count(*) AS n FROM part GROUP BY 1")
def normalize_concepts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(T.normalize(F.col("p_name")).alias("concept_id")).agg(F.count("*").alias("n"))


_STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP) + "]"


@query(
    "extract_capitalized",
    f"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_MASK}, '{T.CAPITALISED}'))) AS phrase FROM documents)
    SELECT phrase, count(*) AS n FROM m
    WHERE len(list_filter(regexp_split_to_array(lower(phrase), '\\s+'), lambda w: NOT list_contains({_STOP_LIST}, w))) > 0 GROUP BY 1""",
)
def extract_capitalized(spark, sf_dir):
    return _counted(table(spark, sf_dir, "documents"), T.capitalised(F.col("text")), "phrase")


@query(
    "extract_patterns",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, entity, count(*) AS n FROM (SELECT unnest(list_distinct("
        + "list_concat(" + ", ".join(f"regexp_extract_all({_MASK}, '(?i){p}')" for p in ps) + "))) AS entity FROM documents) WHERE length(entity) > 1 GROUP BY ALL"
        for kind, ps in T.PATTERNS.items()
    ),
)
def extract_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), T.pattern_entities(F.col("text"), k).alias("found")) for k in T.PATTERNS])
    return docs.select(F.inline(kinds)).select("kind", F.explode("found").alias("entity")).groupBy("kind", "entity").agg(F.count("*").alias("n"))


def _distinct(*parts: str) -> str:
    return f"list_distinct(list_concat({', '.join(parts)}))"


def _all(pattern: str, options: str = "", text: str = "t") -> str:
    return f"regexp_extract_all({text}, '{options}{pattern}')"


_CAPITAL_SQL = f"list_filter({_all(T.CAPITALISED)}, lambda p: len(list_filter(regexp_split_to_array(lower(p), '\\s+'), lambda w: NOT list_contains({_STOP_LIST}, w))) > 0)"
_ENTITY_SQL = _distinct(*[f"list_filter({_all(p, '(?i)')}, lambda e: length(e) > 1)" for ps in T.PATTERNS.values() for p in ps], _CAPITAL_SQL)
_SEVERAL = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
_CONCEPT_SQL = f"list_filter({_distinct(_all(_SEVERAL), _all(T.TECHNICAL), f'list_filter(list_transform({_all(T.LONG_WORD)}, lambda w: lower(w)), lambda w: NOT list_contains({_STOP_LIST}, w))')}, lambda c: length(c) > 3)"
_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
#: Mention rows of the documents, and the concepts that a graph of them has.
_MENTIONS = f"""t AS (SELECT doc_id AS passage_id, {_MASK} AS t FROM documents),
    s AS (SELECT passage_id, 0 AS kind, unnest({_ENTITY_SQL}) AS surface FROM t UNION ALL SELECT passage_id, 1, unnest({_CONCEPT_SQL}) FROM t),
    m AS (SELECT passage_id, kind, surface, {_NORMAL.format("surface")} AS concept_id FROM s),
    c AS (SELECT concept_id, count(*) AS n, count(DISTINCT passage_id) AS frequency FROM m WHERE concept_id <> '' GROUP BY 1
    HAVING count(*) BETWEEN 2 AND (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM documents))"""
_QUERY_ENTITIES = f"""qt AS (SELECT item_id AS query_id, {_MASK} AS t FROM benchmark),
    qe AS (SELECT DISTINCT query_id, {_NORMAL.format("e")} AS entity FROM (SELECT query_id, unnest({_distinct(_ENTITY_SQL, "list_filter(" + _all("\\b[a-zA-Z]+\\b") + ", lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.QUERY_STOP) + "], lower(w)))")}) AS e FROM qt))"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("content"), F.col("doc_id").alias("chunk_index"))


@query("concept_frequency_band", f"WITH {_MENTIONS} SELECT concept_id, n FROM c")
def concept_frequency_band(spark, sf_dir):
    """Mention rows of all entities and concepts of the documents, within the band of the graph."""
    docs = _passages(spark, sf_dir)
    return graph.band(graph.mentions(docs), docs.count()).select("concept_id", "n")


@query("graph_documents", f"WITH {_MENTIONS} SELECT concept_id, frequency, md5(string_agg(CAST(passage_id AS VARCHAR), ',' ORDER BY passage_id)) AS passages FROM (SELECT DISTINCT concept_id, passage_id, frequency FROM m JOIN c USING (concept_id)) GROUP BY ALL")
def graph_documents(spark, sf_dir):
    """Concepts of the documents' graph, with a digest of the passages that each is linked with."""
    g = _documents_graph(spark, sf_dir)
    ids = F.transform(F.array_sort(F.collect_list("passage_id")), lambda x: x.cast("string"))
    return g.edges.groupBy("concept_id").agg(F.md5(F.array_join(ids, ",")).alias("passages")).join(g.concepts, "concept_id").select("concept_id", "frequency", "passages")


@query("query_keywords", f"WITH {_QUERY_ENTITIES} SELECT query_id, entity FROM qe WHERE entity <> ''")
def query_keywords(spark, sf_dir):
    return retrieval.query_entities(_benchmark_queries(spark, sf_dir))


@query("graph_concepts", f"SELECT concept_id, count(*) AS frequency FROM ({_EDGES}) GROUP BY 1")
def graph_concepts(spark, sf_dir):
    return graph.degrees(_graph_edges(spark, sf_dir)).where("side = 'concept'").select(F.col("node").cast("bigint").alias("concept_id"), F.col("degree").alias("frequency"))


@query(
    "graph_statistics",
    f"""WITH e AS ({_EDGES}), f AS (SELECT concept_id, count(*) AS f FROM e GROUP BY 1),
    s AS (SELECT count(*) AS edges, count(DISTINCT passage_id) AS passages, count(DISTINCT concept_id) AS concepts FROM e)
    SELECT edges, passages, concepts, round(edges / passages, 6) AS avg_passage_degree, round(edges / concepts, 6) AS avg_concept_degree,
    (SELECT min(f) FROM f) AS min_frequency, (SELECT max(f) FROM f) AS max_frequency, (SELECT round(avg(f), 6) FROM f) AS mean_frequency,
    (SELECT median(f) FROM f) AS median_frequency, (SELECT round(stddev_pop(f), 6) FROM f) AS std_frequency FROM s""",
)
def graph_statistics(spark, sf_dir):
    s = graph.statistics(_graph_edges(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_passage_degree", "avg_concept_degree", "mean_frequency", "std_frequency")})


@query(
    "top_degree",
    f"""WITH e AS ({_EDGES}) SELECT * FROM (SELECT 'passage' AS side, CAST(passage_id AS VARCHAR) AS node, count(*) AS degree FROM e GROUP BY 2
    UNION ALL SELECT 'concept', CAST(concept_id AS VARCHAR), count(*) FROM e GROUP BY 2) ORDER BY degree DESC, side, node LIMIT 30""",
)
def top_degree(spark, sf_dir):
    return graph.top_degree(_graph_edges(spark, sf_dir))


@query("search_concepts", "SELECT p_partkey AS concept_id, p_name AS concept_text FROM part WHERE contains(lower(p_name), 'ring')")
def search_concepts(spark, sf_dir):
    return graph.search(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_text")), "Ring")


_OVERLAP = """CASE WHEN contains(q, e) OR contains(e, q) THEN 1.0 ELSE (
    WITH w AS (SELECT list_distinct(string_split(e, ' ')) AS m) SELECT CASE WHEN len(list_intersect(string_split(q, ' '), m)) / len(m) >= 0.5
    THEN round(len(list_intersect(string_split(q, ' '), m)) / len(m), 6) ELSE 0 END FROM w) END"""


@query("text_overlap", f"SELECT q, e, CAST({_OVERLAP} AS DOUBLE) AS overlap FROM (SELECT DISTINCT p_name AS q FROM part), (SELECT DISTINCT p_name AS e FROM part)")
def text_overlap(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("q")).crossJoin(names.select(F.col("p_name").alias("e")))
    return pairs.select("q", "e", F.round(T.text_overlap(F.col("q"), F.col("e")), 6).alias("overlap"))


_TYPE = """CASE WHEN regexp_matches(lower(x), 'inc|corp|ltd|llc|company|group') THEN 'ORG'
    WHEN regexp_matches(regexp_replace(x, '[ ,%]', '', 'g'), '^[0-9]+$') THEN CASE WHEN length(x) = 4 THEN 'DATE' ELSE 'MONEY' END
    WHEN contains(x, '%') THEN 'PERCENT' WHEN regexp_matches(lower(x), '\\$|million|billion') THEN 'MONEY'
    WHEN regexp_matches(lower(x), 'january|february|march|april|may|june|july|august|september|october|november|december|q[1-4]') THEN 'DATE'
    WHEN regexp_matches(x, '^[A-Z]') AND len(string_split(x, ' ')) <= 3 THEN 'PERSON' ELSE 'UNKNOWN' END"""


@query(
    "entity_type_heuristic",
    f"SELECT x AS entity, {_TYPE} AS kind FROM (SELECT DISTINCT p_name AS x FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation UNION SELECT CAST(p_partkey AS VARCHAR) FROM part)",
)
def entity_type_heuristic(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.explode(F.array("p_name", "p_brand", "p_type", F.col("p_partkey").cast("string"))).alias("entity"))
    names = names.union(table(spark, sf_dir, "nation").select("n_name")).distinct()
    return names.select("entity", T.entity_type(F.col("entity")).alias("kind"))


_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))"


@query("semantic_topk", f"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v, {_WORDS} AS n FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
    s AS (SELECT q.vec_id AS query_id, p.vec_id AS passage_id, list_cosine_similarity(q.v, p.v) * CASE WHEN p.n > 50 THEN least(1.1, 1 + (p.n - 50) / 500) ELSE 1 END AS s FROM p q, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, passage_id) AS rank, max(s) OVER (PARTITION BY query_id) AS best FROM s WHERE s >= 0.3)
    SELECT query_id, passage_id, round(s / best, 6) AS score, rank FROM r WHERE rank <= 5""")
def semantic_topk(spark, sf_dir):
    """The five passages nearest to each vector, longer documents of the same number raised."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id", "left")
    out = retrieval.semantic(v.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "passage_id"), 5)
    return out.select("query_id", "passage_id", F.round("score", 6).alias("score"), "rank")


@query("embedding_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35""")
def embedding_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dedup.embedding_pairs(v, 0.35).withColumn("similarity", F.round("similarity", 6))


_PAIRS = """SELECT a, b, CASE WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE len(list_intersect(string_split(a, ''), string_split(b, ''))) / greatest(length(a), length(b)) END AS s
    FROM (SELECT DISTINCT p_name AS a FROM part) JOIN (SELECT DISTINCT p_name AS b FROM part) ON a < b"""


@query("string_similarity_pairs", f"SELECT a, b, CAST(round(s, 6) AS DOUBLE) AS similarity FROM ({_PAIRS}) WHERE s >= 0.7")
def string_similarity_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"))
    return dedup.string_pairs(names, 0.7).withColumn("similarity", F.round("similarity", 6))


@query(
    "canonical_mapping",
    f"""WITH RECURSIVE p AS (SELECT a, b FROM ({_PAIRS}) WHERE s >= 0.8), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
    c AS (SELECT x, min(y) AS component FROM r GROUP BY 1), k AS (SELECT component, arg_min(x, struct_pack(n := -length(x), x := x)) AS canonical FROM c GROUP BY 1)
    SELECT x AS duplicate, canonical FROM c JOIN k USING (component) WHERE x <> canonical""",
)
def canonical_mapping(spark, sf_dir):
    return dedup.canonical(dedup.string_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("entity")), 0.8))


@query(
    "jaccard_pairs",
    f"""WITH e AS ({_EDGES}), n AS (SELECT concept_id, count(*) AS n FROM e GROUP BY 1),
    s AS (SELECT x.concept_id AS a, y.concept_id AS b, count(*) AS k FROM e x JOIN e y ON x.passage_id = y.passage_id AND x.concept_id < y.concept_id GROUP BY ALL)
    SELECT a, b, round(k / (p.n + q.n - k), 6) AS jaccard FROM s JOIN n p ON p.concept_id = a JOIN n q ON q.concept_id = b WHERE k / (p.n + q.n - k) >= 0.05""",
)
def jaccard_pairs(spark, sf_dir):
    return dedup.jaccard_pairs(_graph_edges(spark, sf_dir), 0.05).withColumn("jaccard", F.round("jaccard", 6))


@query("merge_graphs", """SELECT passage_id, concept_id, max(weight) AS weight FROM (SELECT l_orderkey AS passage_id, l_partkey AS concept_id, l_discount AS weight FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_tax FROM lineitem) GROUP BY ALL""")
def merge_graphs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "passage_id", "l_partkey": "concept_id"})
    return graph.merge(*[li.select("passage_id", "concept_id", F.col(c).alias("weight")) for c in ("l_discount", "l_tax")])


#: A query for each size: its parts that the graph has.
_RESTART = "SELECT p_size AS query_id, p_partkey AS concept_id, 1.0 / count(*) OVER (PARTITION BY p_size) AS m FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)"


def _restart(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("concept_id"), F.lit(1.0).alias("weight"))
    return parts.join(_graph_edges(spark, sf_dir).select("concept_id").distinct(), "concept_id", "left_semi")


@query(
    "restart_weights",
    f"""WITH e AS ({_EDGES}), f AS (SELECT concept_id, count(*) AS frequency FROM e GROUP BY 1)
    SELECT p_size AS query_id, p_partkey AS concept_id, round(0.5 * ln((SELECT count(DISTINCT passage_id) FROM e) / (frequency + 1)) / 10 + 0.25, 9) AS weight FROM part JOIN f ON concept_id = p_partkey""",
)
def restart_weights(spark, sf_dir):
    edges = _graph_edges(spark, sf_dir)
    concepts = edges.groupBy("concept_id").agg(F.count("*").alias("frequency"))
    matched = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("concept_id"))
    return ppr.restart(matched, concepts, edges.select("passage_id").distinct().count()).withColumn("weight", F.round("weight", 9))


def _ppr_sql(n: int, alpha: float = 0.15, restart: str = _RESTART) -> str:
    """The series of the walk, one table for each step."""
    steps = [f"e AS MATERIALIZED ({_EDGES}), dp AS MATERIALIZED (SELECT passage_id, count(*) AS d FROM e GROUP BY 1), dc AS MATERIALIZED (SELECT concept_id, count(*) AS d FROM e GROUP BY 1), v0 AS ({restart})"]
    parts = []
    for k in range(1, n + 1):
        here, there, d = ("concept_id", "passage_id", "dc") if k % 2 else ("passage_id", "concept_id", "dp")
        steps.append(f"v{k} AS MATERIALIZED (SELECT query_id, {there}, sum(m / d) AS m FROM v{k - 1} JOIN e USING ({here}) JOIN {d} USING ({here}) GROUP BY ALL)")
        if k % 2:
            parts.append(f"SELECT query_id, passage_id, m * {(1 - alpha) ** k * (1 if k == n else alpha)!r} AS s FROM v{k}")
    return f"WITH {', '.join(steps)} SELECT query_id, passage_id, sum(s) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("ppr_k_steps", f"SELECT query_id, passage_id, round(score, 9) AS score FROM ({_ppr_sql(4)})")
def ppr_k_steps(spark, sf_dir):
    """Four steps from every size."""
    got = ppr.ppr(_graph_edges(spark, sf_dir), _restart(spark, sf_dir), max_iter=4)
    return got.withColumn("score", F.round("score", 9))


@query(
    "ppr_topk",
    f"SELECT query_id, passage_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, passage_id) AS rank FROM ({_ppr_sql(ppr.steps(0.15, 1e-6, 100))})) WHERE rank <= 10",
)
def ppr_topk(spark, sf_dir):
    """The best ten orders of every size, walked until the change of a step is below the operator's tolerance."""
    got = ppr.ppr(_graph_edges(spark, sf_dir), _restart(spark, sf_dir), top=10)
    return retrieval.top_k(got, 10).select("query_id", "passage_id", F.round("score", 6).alias("score"), "rank")


@query("ppr_trace")
def ppr_trace(spark, sf_dir):
    """The best twelve nodes after each of the first steps of every size, and each step's change."""
    got = ppr.trace(_graph_edges(spark, sf_dir), _restart(spark, sf_dir), max_iter=3)
    return got.withColumns({c: F.round(c, 9) for c in ("diff", "score")})


def _sides(spark, sf_dir) -> list[DataFrame]:
    e = table(spark, sf_dir, "events")
    return [e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("query_id"), F.expr("event_id % 50").alias("passage_id")).agg(F.max("value").alias("score")) for kind in ("click", "view")]


def _fused(method: str):
    def run(spark, sf_dir):
        return retrieval.fuse(*_sides(spark, sf_dir), method).withColumn("score", F.round("score", 6))

    return run


_SIDE = "SELECT user_id AS query_id, event_id % 50 AS passage_id, max(value) AS {1} FROM events WHERE event_type = '{0}' GROUP BY ALL HAVING max(value) >= {2}"
_SIDES = f"a AS ({_SIDE.format('click', 'p', 1e-6)}), b AS ({_SIDE.format('view', 's', 0.3)})"
for _method, _score in {
    "weighted_sum": "0.6 * p + 0.4 * s", "max": "greatest(0.6 * p, 0.4 * s)", "harmonic_mean": "CASE WHEN p > 0 AND s > 0 THEN 2 * 0.6 * p * 0.4 * s / (0.6 * p + 0.4 * s) ELSE 0.6 * p + 0.4 * s END", "any_other": "0.6 * p + 0.4 * s",
}.items():
    query(
        f"fuse_{_method}",
        f"""WITH {_SIDES}, f AS (SELECT query_id, passage_id, coalesce(p, 0) AS p, coalesce(s, 0) AS s FROM a FULL JOIN b USING (query_id, passage_id))
        SELECT query_id, passage_id, p AS ppr_score, s AS semantic_score, round({_score}, 6) AS score FROM f""",
    )(_fused(_method))


@query("content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))


@query("min_length_filter", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 300")
def min_length_filter(spark, sf_dir):
    return json.min_length(table(spark, sf_dir, "documents"), "text", 300).select("doc_id")


@query("ingest_metadata_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none.x') AS missing FROM events")
def ingest_metadata_paths(spark, sf_dir):
    return json.json_path(table(spark, sf_dir, "events"), "props", k="k", missing="none.x").select("event_id", "k", "missing")


@query("ingest_qa", """WITH n AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nxt FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 'User asked: ' || text || chr(10) || chr(10) || 'Assistant answered: ' || answer AS content FROM n WHERE role = 'user' AND nxt = 'assistant'""")
def ingest_qa(spark, sf_dir):
    return json.compose_qa(table(spark, sf_dir, "conversations"))


@query("chunk_text")
def chunk_text(spark, sf_dir):
    return chunk.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def _documents_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build(_passages(spark, sf_dir))


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("flagship_retrieval")
def flagship_retrieval(spark, sf_dir):
    """The best ten documents of each benchmark text by personalised PageRank, with contents and the concepts that matched; entities match concepts exactly and in part."""
    g = _documents_graph(spark, sf_dir)
    matched = cut(retrieval.match(retrieval.query_entities(_benchmark_queries(spark, sf_dir)), g.concepts))
    return retrieval.results(g, retrieval.ppr_rank(g, matched), matched)


@query("match_exact", f"WITH {_MENTIONS}, {_QUERY_ENTITIES} SELECT DISTINCT query_id, concept_id FROM qe JOIN c ON entity = concept_id")
def match_exact(spark, sf_dir):
    """Concepts of the documents that equal an entity of a benchmark text."""
    return retrieval.match(retrieval.query_entities(_benchmark_queries(spark, sf_dir)), _documents_graph(spark, sf_dir).concepts, partial=False)


@query("match_partial", f"WITH {_MENTIONS}, {_QUERY_ENTITIES} SELECT DISTINCT query_id, concept_id FROM qe JOIN c ON entity <> '' AND (contains(concept_id, entity) OR contains(entity, concept_id))")
def match_partial(spark, sf_dir):
    """Those that hold such an entity or lie in one, equal ones among them."""
    return retrieval.match(retrieval.query_entities(_benchmark_queries(spark, sf_dir)), _documents_graph(spark, sf_dir).concepts)


def _hits(spark: SparkSession, sf_dir: str, partial: bool) -> DataFrame:
    queries = _benchmark_queries(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    gold = queries.join(docs, F.contains(docs["text"], queries["text"])).select("query_id", F.col("doc_id").alias("passage_id")).distinct()
    ranked = retrieval.ppr_retrieve(_documents_graph(spark, sf_dir), queries, partial=partial)
    return retrieval.hit_metrics(ranked, gold, queries)


@query("hit_at_k")
def hit_at_k(spark, sf_dir):
    """Retrieval quality of exact matching; the gold passages of a query are the documents that hold its text."""
    return _hits(spark, sf_dir, False)


@query("hit_at_k_partial")
def hit_at_k_partial(spark, sf_dir):
    """The same of the flagship, which matches parts too."""
    return _hits(spark, sf_dir, True)


# structure and lookups


@query(
    "structural_statistics",
    f"""WITH RECURSIVE e AS ({_EDGES}), d AS (SELECT 'p' || passage_id AS node, count(*) AS degree FROM e GROUP BY 1 UNION ALL SELECT 'c' || concept_id, count(*) FROM e GROUP BY 1),
    t AS (SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, count(*) FILTER (node LIKE 'p%') AS passage_nodes, count(*) FILTER (node LIKE 'c%') AS concept_nodes, avg(degree) AS a, max(degree) AS max_degree, min(degree) AS min_degree FROM d)
    SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1.0)), 9) AS density, passage_nodes, concept_nodes, round(edges / (passage_nodes * concept_nodes::DOUBLE), 9) AS bipartite_density, round(a, 6) AS avg_degree, max_degree, min_degree FROM t""",
)
def structural_statistics(spark, sf_dir):
    got = graph.structure(_graph_edges(spark, sf_dir))
    return got.drop("is_connected", "components", "is_bipartite").withColumns({"density": F.round("density", 9), "bipartite_density": F.round("bipartite_density", 9), "avg_degree": F.round("avg_degree", 6)})


@query("graph_components")
def graph_components(spark, sf_dir):
    """Connected components of the graph of orders and parts, and whether it is one."""
    return graph.structure(_graph_edges(spark, sf_dir)).select("components", "is_connected", "is_bipartite")


@query(
    "top_concepts",
    f"""WITH e AS ({_EDGES}), d AS (SELECT concept_id, count(*) AS degree FROM e GROUP BY 1)
    SELECT p_partkey AS concept_id, p_name AS concept_text, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON concept_id = p_partkey ORDER BY degree DESC, p_size DESC, p_name || p_partkey DESC LIMIT 30""",
)
def top_concepts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("concept_text"), "p_name", F.col("p_size").alias("frequency"))
    return graph.top_concepts(parts, _graph_edges(spark, sf_dir)).select("concept_id", F.col("p_name").alias("concept_text"), "degree")


# queries


_CLEAN = f"trim(regexp_replace(regexp_replace(lower({_MASK}), '[^a-zA-Z0-9_\\s\\-''.]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("clean_queries", f"SELECT item_id, {_CLEAN} AS cleaned FROM benchmark")
def clean_queries(spark, sf_dir):
    """Benchmark texts as queries are cleaned, with letters beyond ASCII shown as one sign."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(T.clean_query(F.lower("text")), r"[^\x00-\x7F]", "_").alias("cleaned"))


_TERM_STOP = "[" + ", ".join(f"'{w}'" for w in T.TERM_STOP) + "]"


@query(
    "query_terms",
    f"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
    r AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    g AS (SELECT item_id, n, i, w[i : i + n - 1] AS g FROM r, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w))
    SELECT item_id, array_to_string(g, ' ') AS term, count(*) AS n FROM g WHERE len(list_filter(g, lambda x: list_contains({_TERM_STOP}, x))) = 0 AND (n > 1 OR length(g[1]) > 2) GROUP BY ALL""",
)
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(Q.terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


_NAMES = "SELECT DISTINCT p_name AS t FROM part"
_OVER = f"""SELECT q.t AS query_id, c.t AS concept_id, 0.8 + 0.2 * CASE WHEN contains(lower(q.t), lower(c.t)) OR contains(lower(c.t), lower(q.t)) THEN 1.0
    ELSE len(list_intersect(list_distinct(string_split(lower(q.t), ' ')), list_distinct(string_split(lower(c.t), ' ')))) / len(list_distinct(string_split(lower(c.t), ' '))) END AS score FROM ({_NAMES}) q, ({_NAMES}) c"""


@query("query_text_matches", f"SELECT query_id, concept_id, round(score, 6) AS score FROM ({_OVER}) WHERE score >= 0.9 - 1e-9")
def query_text_matches(spark, sf_dir):
    """Part names that a part name has at least half the words of."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    got = Q.text_matches(names.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")), names.select(F.col("p_name").alias("concept_id"), F.col("p_name").alias("concept_text")))
    return got.withColumn("score", F.round("score", 6))


_BY_KIND = {k: f"SELECT user_id AS query_id, event_id % 50 AS concept_id, max(value) / 100 AS {n} FROM events WHERE event_type = '{k}' GROUP BY ALL" for k, n in (("click", "x"), ("view", "t"), ("purchase", "q"))}
_MERGED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, concept_id) AS rank FROM (SELECT query_id, concept_id, coalesce(greatest(x, t), q) AS score
    FROM ({_BY_KIND["click"]}) FULL JOIN ({_BY_KIND["view"]}) USING (query_id, concept_id) FULL JOIN ({_BY_KIND["purchase"]}) USING (query_id, concept_id))"""


def _merged_entities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = [e.where(F.col("event_type") == k).select(F.col("user_id").alias("query_id"), F.expr("event_id % 50").alias("concept_id"), (F.col("value") / 100).alias("score")) for k in _BY_KIND]
    return Q.merge_entities(*kinds)


@query("query_entities_merge", f"SELECT query_id, concept_id, round(score, 6) AS score, rank FROM ({_MERGED}) WHERE rank <= 10")
def query_entities_merge(spark, sf_dir):
    """The best ten entities of each user by three rankings of events."""
    return _merged_entities(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    "query_confidence",
    f"""WITH m AS (SELECT * FROM ({_MERGED}) WHERE rank <= 10), a AS (SELECT query_id, avg(score) AS s, count(*) AS n, count(*) FILTER (concept_id > 5) AS o FROM m GROUP BY 1)
    SELECT DISTINCT user_id AS query_id, round(CASE WHEN n IS NULL THEN 0.1 ELSE least(1.0, s + least(0.2, 0.05 * n) + least(0.2, 0.05 * o)) END, 6) AS confidence FROM events LEFT JOIN a ON query_id = user_id""",
)
def query_confidence(spark, sf_dir):
    """How sure each user's entities are; an entity's number stands for its frequency."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"))
    concepts = spark.range(50).select(F.col("id").alias("concept_id"), F.col("id").alias("frequency"))
    return Q.confidence(users, _merged_entities(spark, sf_dir), concepts).withColumn("confidence", F.round("confidence", 6))


@query(
    "hybrid_confidence",
    f"""WITH {_SIDES}, f AS (SELECT query_id, passage_id, coalesce(p, 0) / 101 AS p, coalesce(s, 0) / 101 AS s FROM a FULL JOIN b USING (query_id, passage_id))
    SELECT query_id, passage_id, round(least(1.0, CASE WHEN p > 0 AND s > 0 THEN 0.9 WHEN p > 0 THEN 0.7 WHEN s > 0 THEN 0.6 ELSE 0 END + 0.1 + least(0.2, 0.1 * greatest(p, s))), 6) AS confidence,
    CASE WHEN p > 0 AND s > 0 THEN printf('Linked in the graph (%.3f) and similar in meaning (%.3f)', p, s) WHEN p > 0 THEN printf('Linked in the graph through entities (%.3f)', p) ELSE printf('Similar in meaning (%.3f)', s) END AS explanation FROM f""",
)
def hybrid_confidence(spark, sf_dir):
    f = retrieval.fuse(*_sides(spark, sf_dir))
    p, s = F.col("ppr_score") / 101, F.col("semantic_score") / 101
    return f.select("query_id", "passage_id", F.round(retrieval.confidence(p, s, F.lit(0.5)), 6).alias("confidence"), retrieval.explanation(p, s, F.array().cast("array<string>")).alias("explanation"))


@query(
    "hybrid_analysis",
    f"""WITH {_SIDES.replace(" HAVING max(value) >= 1e-06", "").replace(" HAVING max(value) >= 0.3", "")}, f AS (SELECT query_id, p, s FROM a FULL JOIN b USING (query_id, passage_id))
    SELECT query_id, count(*) FILTER (s IS NULL) AS ppr_only, count(*) FILTER (p IS NULL) AS semantic_only, count(*) FILTER (p IS NOT NULL AND s IS NOT NULL) AS combined, round(coalesce(avg(p), 0), 6) AS avg_ppr_score,
    round(coalesce(avg(s), 0), 6) AS avg_semantic_score, round(count(*) FILTER (p IS NOT NULL AND s IS NOT NULL) / count(*), 6) AS coverage_overlap FROM f GROUP BY 1""",
)
def hybrid_analysis(spark, sf_dir):
    a = retrieval.analyse(*_sides(spark, sf_dir))
    return a.withColumns({c: F.round(c, 6) for c in ("avg_ppr_score", "avg_semantic_score", "coverage_overlap")})


@query("diversify")
def diversify(spark, sf_dir):
    """The best ten documents of each user's events that differ in their first words."""
    click, view = _sides(spark, sf_dir)
    return retrieval.diversify(retrieval.fuse(click, view).join(_passages(spark, sf_dir).select("passage_id", "content"), "passage_id"), 10).select("query_id", "passage_id", "score", "rank")


@query("semantic_explain", """SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
    CASE WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.8 THEN 'very high' WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.6 THEN 'high'
    WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4 THEN 'moderate' ELSE 'low' END AS level FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def semantic_explain(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q, p = v.select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("passage_id"), "embedding", F.lit("").alias("content"))
    got = retrieval.semantic_explain(q, p, v.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("passage_id")))
    return got.select("query_id", "passage_id", F.round("similarity", 6).alias("similarity"), "level")


@query("semantic_match", """SELECT a.vec_id AS query_id, b.vec_id AS concept_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a, embeddings b WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def semantic_match(spark, sf_dir):
    """All pairs of vectors whose plain product reaches a threshold, as entities match concepts."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got = vectors.search(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "passage_id"), None, 0.4, unit=False)
    return got.select("query_id", F.col("passage_id").alias("concept_id"), F.round("score", 6).alias("similarity"))


# weights


_TERMS = "SELECT DISTINCT doc_id, w AS term FROM (SELECT doc_id, unnest(string_split_regex(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE length(w) >= 12"
_KEYS = "[" + ", ".join(f"'{k}'" for k in weights.KEYWORDS) + "]"


@query(
    "edge_weights",
    f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, length(text) AS len, {_WORDS} AS words FROM documents), t AS ({_TERMS}), n AS (SELECT count(*) AS n FROM documents),
    u AS (SELECT DISTINCT lower(term) AS l FROM t), df AS (SELECT l, count(*) AS df FROM u JOIN d ON contains(low, l) GROUP BY 1),
    p AS (SELECT doc_id, term, string_split(low, lower(term)) AS parts FROM t JOIN d USING (doc_id)),
    s AS (SELECT doc_id, term, unnest(range(1, len(parts))) AS k, parts FROM p),
    m AS (SELECT doc_id, term, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(term) AS pos FROM s),
    c AS (SELECT doc_id, term, pos / len AS r, substr(low, CAST(greatest(pos - 50, 0) AS BIGINT) + 1, CAST(least(len, pos + length(term) + 50) - greatest(pos - 50, 0) AS BIGINT)) AS near FROM m JOIN d USING (doc_id)),
    v AS (SELECT doc_id, term, count(*) AS mentions, max(CASE WHEN r < 0.2 OR r > 0.8 THEN 0.9 WHEN r < 0.4 OR r > 0.6 THEN 0.7 ELSE 0.5 END) AS position,
    max(least(1.0, 5.0 * len(list_filter({_KEYS}, lambda k: contains(near, k))) / greatest(1, len(list_filter(regexp_split_to_array(near, '\\s+'), lambda w: w <> ''))))) AS context FROM c GROUP BY ALL),
    x AS (SELECT doc_id, term, mentions, least(1.0, 10.0 * mentions / words) AS tf, CASE WHEN n <= 1 THEN 1.0 ELSE ln(n / df) / ln(n) END AS idf, position, context FROM v JOIN d USING (doc_id) JOIN df ON l = lower(term), n)
    SELECT doc_id, term, mentions, round(tf, 6) AS tf, round(idf, 6) AS idf, position, round(context, 6) AS context,
    round(least(1.0, (0.35 * tf * idf + 0.25 * position + 0.14 + 0.2 * context) * CASE WHEN mentions > 1 THEN least(1.2, 1 + 0.1 * (mentions - 1)) ELSE 1 END), 6) AS weight FROM x""",
)
def edge_weights(spark, sf_dir):
    """Weights of the long words of every document."""
    docs = _passages(spark, sf_dir)
    terms = docs.select("passage_id", F.explode(F.array_distinct(F.split("content", "[^a-zA-Z]+"))).alias("term")).where("length(term) >= 12").withColumn("kind", F.lit("UNKNOWN"))
    got = weights.edge_weights(docs, terms)
    # as DuckDB rounds doubles: the product decides a tie, not the shortest digits, which F.round(c, 6) goes by
    six = {c: F.round(F.col(c) * 1e6) / 1e6 for c in ("tf", "idf", "context", "weight")}
    return got.withColumns(six).select(F.col("passage_id").alias("doc_id"), "term", "mentions", "tf", "idf", "position", "context", "weight")


# deduplication


_FIRST = "SELECT p_name AS t, min(p_partkey) AS id FROM part GROUP BY 1"
_JUDGED = f"""WITH e AS ({_EDGES}), n AS (SELECT concept_id, count(*) AS n FROM e GROUP BY 1), f AS ({_FIRST}), q AS (SELECT a, b, s, x.id AS ai, y.id AS bi FROM ({_PAIRS}) JOIN f x ON x.t = a JOIN f y ON y.t = b WHERE s >= 0.7),
    k AS (SELECT ai, bi, (SELECT count(*) FROM e u JOIN e v ON u.passage_id = v.passage_id WHERE u.concept_id = ai AND v.concept_id = bi) AS met, coalesce((SELECT n FROM n WHERE concept_id = ai), 0) AS na, coalesce((SELECT n FROM n WHERE concept_id = bi), 0) AS nb FROM q)
    SELECT a, b, s, CASE WHEN na + nb - met = 0 THEN 1.0 ELSE met / (na + nb - met) END AS j FROM q JOIN k USING (ai, bi)"""


def _named_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_text"), F.lit("named_entity").alias("concept_type"), F.lit(1).cast("bigint").alias("frequency"))


@query(
    "dedup_candidates",
    f"""SELECT a, b, round(s, 6) AS string_similarity, round(j, 6) AS graph_similarity, round(least(1.0, 0.3 * s + 0.3 * j), 6) AS confidence, 'string' || CASE WHEN j >= 0.0005 THEN '+graph' ELSE '+certain' END AS phase
    FROM ({_JUDGED}) WHERE j >= 0.0005 OR s >= 0.85""",
)
def dedup_candidates(spark, sf_dir):
    """Part names alike in letters, whose orders agree a little or whose letters are certain."""
    got = dedup.candidates(_named_parts(spark, sf_dir), _graph_edges(spark, sf_dir), None, 0.7, graph_least=0.0005, certain=0.85)
    return got.select("a", "b", *[F.round(c, 6).alias(c) for c in ("string_similarity", "graph_similarity", "confidence")], "phase")


_TO_FIRST = f"SELECT p_partkey AS duplicate, id AS canonical FROM part JOIN ({_FIRST}) ON t = p_name WHERE p_partkey <> id"


def _to_first(spark, sf_dir):
    parts = _named_parts(spark, sf_dir)
    first = parts.groupBy("concept_text").agg(F.min("concept_id").alias("canonical"))
    return parts.join(first, "concept_text").where("concept_id <> canonical").select(F.col("concept_id").alias("duplicate"), "canonical")


@query("merged_concepts", f"""WITH e AS ({_EDGES}), m AS ({_TO_FIRST}), x AS (SELECT DISTINCT coalesce(canonical, concept_id) AS concept_id, passage_id FROM e LEFT JOIN m ON duplicate = concept_id), c AS (SELECT concept_id, count(*) AS f FROM x GROUP BY 1)
    SELECT id AS concept_id, t AS concept_text, coalesce(f, 0) AS frequency, (SELECT count(*) FROM part WHERE p_name = t) AS merged FROM ({_FIRST}) LEFT JOIN c ON concept_id = id""")
def merged_concepts(spark, sf_dir):
    """Parts of one name as one concept."""
    out, _ = dedup.merge_concepts(_named_parts(spark, sf_dir), _graph_edges(spark, sf_dir).withColumn("weight", F.lit(1.0)), _to_first(spark, sf_dir))
    return out.select("concept_id", "concept_text", "frequency", "merged")


@query("merged_edges", f"""WITH m AS ({_TO_FIRST}) SELECT l_orderkey AS passage_id, coalesce(canonical, l_partkey) AS concept_id, max(l_discount) AS weight FROM lineitem LEFT JOIN m ON duplicate = l_partkey GROUP BY ALL""")
def merged_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("passage_id"), F.col("l_partkey").alias("concept_id"), F.col("l_discount").alias("weight"))
    return dedup.merge_concepts(_named_parts(spark, sf_dir), edges, _to_first(spark, sf_dir))[1]


@query("dedup_report", f"""WITH m AS ({_TO_FIRST}), s AS (SELECT canonical, count(*) + 1 AS size FROM m GROUP BY 1)
    SELECT (SELECT count(*) FROM part) AS before, (SELECT count(*) FROM part) - (SELECT count(*) FROM m) AS after, round(100.0 * (SELECT count(*) FROM m) / (SELECT count(*) FROM part), 6) AS reduction_percent, count(*) AS clusters, round(avg(size), 6) AS avg_cluster_size, max(size) AS max_cluster_size FROM s""")
def dedup_report(spark, sf_dir):
    counts, _ = dedup.report(_named_parts(spark, sf_dir), _to_first(spark, sf_dir))
    return counts.withColumns({c: F.round(c, 6) for c in ("reduction_percent", "avg_cluster_size")})


@query("append_graph", "SELECT 'passage_' || ((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) - 1) AS passage_id, o_orderkey AS old FROM orders")
def append_graph(spark, sf_dir):
    """Orders appended to as many others as the greatest order number: each is numbered on."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("passage_id"), F.col("o_orderkey").cast("string").alias("content"), F.col("o_orderkey").alias("chunk_index"))
    most = orders.agg(F.max("chunk_index")).first()[0]
    base = spark.range(most).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("passage_id"), F.lit(None).cast("string").alias("content"), F.col("id").alias("chunk_index"))
    empty = graph.Graph.empty(spark)
    both = graph.append(graph.Graph(base, empty.concepts, empty.edges), graph.Graph(orders, empty.concepts, empty.edges))
    return both.passages.where("content IS NOT NULL").select("passage_id", F.col("content").cast("bigint").alias("old"))


# ingestion


def _as_json(spark, sf_dir, fields: dict):
    """Conversation turns as JSON items of one list each."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.select(F.to_json(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))).alias("value"))


def _ingested(name: str, sql: str, rule: str | None, **fields):
    def run(spark, sf_dir):
        columns = {k: F.expr(v) for k, v in fields.items()}
        return json.ingest(_as_json(spark, sf_dir, columns), rule).select("content", "rule", F.col("content_hash").alias("hash")).groupBy("content", "rule", "hash").agg(F.count("*").alias("n"))

    query(name, f"SELECT content, rule, md5(content) AS hash, count(*) AS n FROM ({sql}) WHERE length(trim(content)) >= 30 GROUP BY ALL")(run)


_ingested("ingest_rule_qa", "SELECT role || ' asked: ' || text || chr(10) || chr(10) || 'Unknown answered: ' || conv_id AS content, 'qa_format' AS rule FROM conversations WHERE text IS NOT NULL", None, question="text", answer="cast(conv_id AS string)", questioner_name="role")
_ingested("ingest_rule_said", "SELECT role || ' said: ' || text AS content, 'qa_format' AS rule FROM conversations WHERE text IS NOT NULL", "qa_format", text="text", speaker_name="role")
_ingested("ingest_rule_parts", "SELECT role || ': ' || text || chr(10) || chr(10) || turn AS content, 'simple_content' AS rule FROM conversations WHERE text IS NOT NULL", None, content="text", body="cast(turn AS string)", author="role")
_ingested("ingest_rule_single", "SELECT CASE WHEN starts_with(text, role) THEN text ELSE role || ': ' || text END AS content, 'chunk_array' AS rule FROM conversations WHERE text IS NOT NULL", None, content="text", document_metadata="named_struct('source', role)", author="role")
_ingested("ingest_rule_nested", "SELECT text AS content, 'nested_chunks' AS rule FROM conversations WHERE text IS NOT NULL", "nested_chunks", content="text", metadata="named_struct('document', named_struct('a', role))")


@query("ingest_structures", "SELECT 'chunk_array' AS rule, count(*) AS n FROM conversations WHERE text IS NOT NULL AND length(trim(text)) >= 30 AND role = 'user' HAVING count(*) > 0 UNION ALL SELECT 'simple_content', count(*) FROM conversations WHERE text IS NOT NULL AND length(trim(text)) >= 30 AND role <> 'user' HAVING count(*) > 0")
def ingest_structures(spark, sf_dir):
    """Lists of different structures in one job: each is told by its own first item."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    item = F.struct(F.col("text").alias("content"), F.when(F.col("role") == "user", F.struct(F.col("conv_id"))).alias("document_metadata"))
    return json.ingest(turns.select(F.to_json(F.array(item)).alias("value"))).groupBy("rule").agg(F.count("*").alias("n"))


# caches and evaluation


@query("extraction_cache", f"""WITH {_MENTIONS}, x AS (SELECT DISTINCT md5(text) AS passage_hash, {_MASK} AS t FROM documents WHERE text IS NOT NULL)
    SELECT passage_hash, len({_ENTITY_SQL}) AS entities, len({_CONCEPT_SQL}) AS concepts FROM x""")
def extraction_cache(spark, sf_dir):
    """What an extraction of all documents puts into an empty cache."""
    made = cache.extract(_passages(spark, sf_dir).select("content"))
    return made.select("passage_hash", F.size("entities").alias("entities"), F.size("concepts").alias("concepts"))


@query("extraction_summary", "SELECT count(DISTINCT source) AS documents, count(DISTINCT md5(text)) AS passages FROM documents WHERE text IS NOT NULL")
def extraction_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("passage_hash"), F.create_map(F.lit("source"), "source").alias("document_metadata"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("concepts"))
    return cache.summary(docs.where("passage_hash IS NOT NULL")).select("documents", "passages")


@query("stratified_allocation", """WITH r AS (SELECT lang, source FROM documents), c AS (SELECT lang, source, count(*) AS size FROM r GROUP BY ALL), b AS (SELECT *, least(floor(size * 100.0::DOUBLE / (SELECT count(*) FROM r)), size) AS base, size * 100.0::DOUBLE / (SELECT count(*) FROM r) - floor(size * 100.0::DOUBLE / (SELECT count(*) FROM r)) AS part FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY round(part, 9) DESC, lang DESC, source DESC) AS place, least(100, (SELECT count(*) FROM r)) - sum(base) OVER () AS left_ FROM b)
    SELECT lang, source, size, CAST(base + CASE WHEN place <= left_ AND base < size THEN 1 ELSE 0 END AS BIGINT) AS taken FROM p""")
def stratified_allocation(spark, sf_dir):
    """A hundred documents over languages and sources."""
    return evaluate.allocation(table(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"], 100)


@query("stratified_sample", """WITH c AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), b AS (SELECT *, floor(size * 50.0::DOUBLE / (SELECT count(*) FROM documents)) AS base, size * 50.0::DOUBLE / (SELECT count(*) FROM documents) - floor(size * 50.0::DOUBLE / (SELECT count(*) FROM documents)) AS part FROM c),
    p AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY round(part, 9) DESC, lang DESC) <= 50 - sum(base) OVER () AND base < size THEN 1 ELSE 0 END AS taken FROM b),
    o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents)
    SELECT doc_id, o.lang FROM o JOIN p ON p.lang IS NOT DISTINCT FROM o.lang WHERE place <= taken""")
def stratified_sample(spark, sf_dir):
    """Fifty documents, as many of each language as its share: a sampling operator."""
    return evaluate.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 50, "doc_id")


@query("latency_percentiles", """WITH p AS (SELECT event_type, unnest([50.0, 95.0]) AS p, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT event_type, p::DOUBLE AS p, v[CAST(round_even(p / 100 * (len(v) - 1), 0) AS BIGINT) + 1] AS value FROM p""")
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "value", by=["event_type"])


_RANKED = "SELECT user_id AS query_id, event_id % 50 AS passage_id, CAST(min(event_id % 7) + 1 AS INTEGER) AS rank FROM events WHERE event_type = 'click' GROUP BY ALL"
_GOLD = "SELECT DISTINCT user_id AS query_id, event_id % 50 AS passage_id FROM events WHERE event_type = 'view'"
_ASKED = "SELECT DISTINCT user_id AS query_id FROM events"


@query("retrieval_metrics", f"""WITH r AS ({_RANKED}), g AS ({_GOLD}), q AS ({_ASKED}), f AS (SELECT query_id, count(g.passage_id) AS n, min(rank) AS best, count(*) FILTER (rank <= 1) AS n1, count(*) FILTER (rank <= 3) AS n3, count(*) FILTER (rank <= 5) AS n5, count(*) FILTER (rank <= 10) AS n10
    FROM q LEFT JOIN g USING (query_id) LEFT JOIN r USING (query_id, passage_id) GROUP BY 1), k AS (SELECT n, best, unnest([1, 3, 5, 10]) AS k, unnest([n1, n3, n5, n10]) AS got FROM f)
    SELECT k, round(avg(CAST(got > 0 AS INTEGER)), 6) AS hit, round(avg(CAST(n > 0 AND got = n AS INTEGER)), 6) AS full_support, round(avg(CASE WHEN n > 0 THEN got / n END), 6) AS coverage, round(avg(coalesce(1 / best, 0)), 6) AS mrr FROM k GROUP BY 1""")
def retrieval_metrics(spark, sf_dir):
    """Hit rates, support and reciprocal ranks of users' clicks against what they viewed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.expr("event_id % 50").alias("passage_id"), "event_id", "event_type")
    ranked = e.where("event_type = 'click'").groupBy("query_id", "passage_id").agg((F.min(F.expr("event_id % 7")) + 1).cast("int").alias("rank"))
    return evaluate.evaluate(ranked, e.where("event_type = 'view'"), e)[0]
