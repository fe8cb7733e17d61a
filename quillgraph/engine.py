"""The engine's facade: build, load, save, insert, query.

Questions may come one by one or as a table. A method that needs vectors asks
for a provider (anything with ``encode(texts)``); a language model is used for
extraction only if one is given.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .config import METHODS, EngineConfig
from .functions import text as T
from .operators import graph as G, query as Q, retrieval as R
from .operators.ppr import steps as ppr_steps
from .session import cut
from .sources import cache, documents, embeddings as E, providers as P


@dataclass
class Result:
    passage_id: str
    content: str
    score: float
    matched_concepts: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        return self.passage_id

    @property
    def text(self) -> str:
        return self.content

    def to_dict(self) -> dict:
        return {"score": self.score, "metadata": self.metadata, "matched_concepts": self.matched_concepts} | dict.fromkeys(("id", "passage_id"), self.id) | dict.fromkeys(("text", "content"), self.content)

    def to_document(self) -> dict:
        """``page_content`` and metadata; the result's own keys win over the passage's."""
        return {"page_content": self.content, "metadata": self.metadata | dict.fromkeys(("id", "passage_id"), self.id) | {"matched_concepts": self.matched_concepts, "score": self.score}}


@dataclass
class Metrics:
    num_query_entities: int = 0
    num_matched_concepts: int = 0
    ppr_iterations: int = 0
    retrieval_time: float = 0.0
    num_results: int = 0


class Engine:
    def __init__(self, spark: SparkSession, graph: G.Graph, config: EngineConfig | None = None, embedding_model: E.Provider | None = None, generator: P.Generator | None = None):
        self.spark, self.graph, self.config, self.embedding_model, self.generator = spark, graph, config or EngineConfig(), embedding_model, generator
        self._vectors: DataFrame | None = graph.embeddings

    # building

    @classmethod
    def empty(cls, spark: SparkSession, config: EngineConfig | None = None, **more) -> Engine:
        return cls(spark, G.Graph.empty(spark), config, **more)

    @classmethod
    def from_chunks(cls, spark: SparkSession, chunks: DataFrame | list[dict], config: EngineConfig | None = None, **more) -> Engine:
        """An index of chunks: dicts, or a table ``content[, metadata, chunk_index]``; passages are ``passage_<index>``."""
        config = config or EngineConfig()
        table = chunks if isinstance(chunks, DataFrame) else documents.frame(spark, chunks)
        out = cls(spark, G.Graph.empty(spark), config, **more)
        out.graph = out._build(table)
        if config.auto_save_graph:
            out.save_graph(config.graph_save_path)
        return out

    def _build(self, table: DataFrame) -> G.Graph:
        if "chunk_index" not in table.columns:
            table = table.withColumn("chunk_index", F.row_number().over(Window.orderBy("content")) - 1)
        more = [c for c in ("metadata",) if c in table.columns]
        passages = cut(table.select(F.concat(F.lit("passage_"), F.col("chunk_index").cast("string")).alias("passage_id"), F.coalesce("content", F.lit("")).alias("content"), F.col("chunk_index").cast("bigint").alias("chunk_index"), *more))
        c = self.config
        if not (c.use_llm_for_ner and self.generator is not None):
            return G.build(passages, c.min_concept_freq, c.max_concept_freq_ratio)
        made = cache.extract(passages, c.extraction_cache_dir, P.extractor(self.generator), c.llm_model or c.llm_provider)
        told = cut(passages.join(made.select("content", F.col("entities").alias("__e"), F.col("concepts").alias("__c")), "content"))
        built = G.build(told, c.min_concept_freq, c.max_concept_freq_ratio, entities=F.col("__e"), concepts=F.col("__c"))
        return G.Graph(passages, built.concepts, built.edges)

    @classmethod
    def from_chunks_file(cls, spark: SparkSession, path: str, config: EngineConfig | None = None, **more) -> Engine:
        """An index of a JSON file of chunks."""
        found = cut(documents.chunk_files(documents.files(spark, path, (".json",))))
        return cls.from_chunks(spark, found.select("content", "metadata", "chunk_index"), config, **more)

    @classmethod
    def from_graph_file(cls, spark: SparkSession, path: str, config: EngineConfig | None = None, **more) -> Engine:
        """An index from a saved graph: a folder of Parquet tables, or the JSON format."""
        graph = G.Graph.load(spark, path) if G._there(spark, f"{path}/edges/_SUCCESS") and _parquet(spark, f"{path}/edges") else G.Graph.read_json(spark, path)
        return cls(spark, graph, config, **more)

    def save_graph(self, path: str, kind: str = "parquet") -> None:
        """Write the graph, and the concepts' vectors if there are any."""
        graph = G.Graph(self.graph.passages, self.graph.concepts, self.graph.edges, self._vectors)
        graph.save(path) if kind == "parquet" else graph.write_json(path)

    def add_chunks(self, chunks: DataFrame | list[dict], rebuild: bool = True) -> Engine:
        """The index built anew from its chunks and the new ones, which are numbered on."""
        if not rebuild:
            raise NotImplementedError("only a rebuild adds chunks; for streams of passages see quillgraph.streaming")
        new = chunks if isinstance(chunks, DataFrame) else documents.frame(self.spark, chunks)
        n = self.graph.passages.agg(F.coalesce(F.max("chunk_index") + 1, F.lit(0))).first()[0]
        about = F.col("metadata") if "metadata" in self.graph.passages.columns else F.create_map().cast("map<string,string>").alias("metadata")
        old = self.graph.passages.select("content", about, "chunk_index")
        if "chunk_index" not in new.columns:
            new = new.withColumn("chunk_index", F.row_number().over(Window.orderBy("content")) - 1)
        if "metadata" not in new.columns:
            new = new.withColumn("metadata", F.create_map().cast("map<string,string>"))
        self.graph = self._build(old.unionByName(new.select("content", "metadata", (F.col("chunk_index") + n).alias("chunk_index"))))
        self._vectors = None
        return self

    def add_documents(self, items: list, rebuild: bool = True) -> Engine:
        """Add texts, dicts or document objects."""
        return self.add_chunks([documents.coerce(d, i) for i, d in enumerate(items)], rebuild)

    insert = add_documents

    # asking

    def _check(self, method: str) -> None:
        if method not in METHODS:
            raise ValueError(f"unknown retrieval method {method!r}; there are {', '.join(METHODS)}")
        if method != "ppr" and self.embedding_model is None:
            raise ValueError(f"retrieval method {method!r} needs an embedding model")

    def vectors(self) -> DataFrame:
        """``concept_id, embedding``, made when first needed."""
        if self._vectors is None:
            self._vectors = cut(E.embed_concepts(self.graph.concepts, self.embedding_model))
        return self._vectors

    def entities(self, queries: DataFrame) -> DataFrame:
        """``query_id, entity`` by the language model if there is one, by patterns where it fails or is missing."""
        found = R.query_entities(queries)
        if not (self.config.use_llm_for_ner and self.generator is not None):
            return found
        ask, rows = P.query_extractor(self.generator), []
        for r in queries.select("query_id", "text").collect():  # questions for a model are few
            try:
                rows += [(r.query_id, e) for e in ask(r.text)]
            except Exception:
                rows += [(r.query_id, None)]
        told = self.spark.createDataFrame(rows, f"query_id {queries.schema['query_id'].dataType.simpleString()}, e string")
        failed = told.where("e IS NULL").select("query_id")
        said = told.where("e IS NOT NULL").select("query_id", T.normalize(F.col("e")).alias("entity")).where("entity <> ''").distinct()
        return said.unionByName(found.join(failed, "query_id", "left_semi"))

    def matches(self, entities: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        """``query_id, concept_id[, similarity]`` of the entities; with vectors also those near in meaning, and how near the query is."""
        c = self.config
        if self.embedding_model is None:
            return R.match(entities, self.graph.concepts)
        near = None
        if c.use_semantic_entity_matching:
            made = self.vectors().withColumnRenamed("concept_id", "text")
            near = (E.embed(entities.select("entity"), self.embedding_model), made)
        found = R.match(entities, self.graph.concepts, semantic=near, threshold=c.semantic_match_threshold)
        if queries is None:
            return found
        asked = queries.select("query_id", "text").join(E.embed(queries.select("text"), self.embedding_model), "text").select("query_id", F.col("embedding").alias("__q"))
        both = found.join(asked, "query_id", "left").join(self.vectors().select("concept_id", F.col("embedding").alias("__c")), "concept_id", "left")
        return both.select("query_id", "concept_id", T.dot(F.col("__q"), F.col("__c")).alias("similarity"))

    def retrieve_all(
        self, queries: DataFrame, method: str | None = None, top_k: int | None = None, min_score_threshold: float | None = None, semantic_weight: float = 0.4, ppr_weight: float = 0.6
    ) -> tuple[DataFrame, DataFrame]:
        """Results ``query_id, rank, passage_id, content, score, matched_concepts[, metadata]`` and counts by query of ``queries(query_id, text)``.

        The threshold is applied after the best ``top_k`` are chosen.
        """
        c = self.config
        method, k = method or c.default_retrieval_method, top_k or c.top_k
        self._check(method)
        counts = queries.select("query_id").distinct()
        if method == "hybrid":
            found, _ = Q.hybrid(self.graph, queries, self.embedding_model, k, ppr_weight=ppr_weight, semantic_weight=semantic_weight)
            found = found.withColumnRenamed("entity_matches", "matched_concepts")
            found = found.select("query_id", "rank", "passage_id", "content", "score", "matched_concepts")
            if "metadata" in self.graph.passages.columns:
                found = found.join(self.graph.passages.select("passage_id", "metadata"), "passage_id")
            n = found.select("query_id", F.explode("matched_concepts").alias("m")).groupBy("query_id").agg(F.countDistinct("m").alias("num_matched_concepts"))
            counts = counts.join(n, "query_id", "left").select("query_id", F.lit(0).alias("num_query_entities"), "num_matched_concepts")
        elif method == "semantic":
            asked = queries.select("query_id", T.clean_query(F.lower("text")).alias("cleaned"))
            asked = asked.join(E.embed(asked.select("cleaned"), self.embedding_model).withColumnRenamed("text", "cleaned"), "cleaned")
            rows = E.embed_passages(self.graph.passages, self.embedding_model)
            ranked = R.semantic(asked, rows, k, 0.5 if min_score_threshold is None else min_score_threshold)
            found = R.results(self.graph, ranked, queries.select("query_id", F.lit(None).cast("string").alias("concept_id")).limit(0))
            counts = counts.select("query_id", F.lit(0).alias("num_query_entities"), F.lit(0).alias("num_matched_concepts"))
        else:
            said = cut(self.entities(queries))
            matched = cut(self.matches(said, queries))
            ranked = R.ppr_rank(self.graph, matched, k, c.ppr_alpha, c.ppr_max_iterations, (c.frequency_weight, c.semantic_weight))
            found = R.results(self.graph, ranked, matched)
            number = lambda df, c, name: df.groupBy("query_id").agg(F.countDistinct(c).alias(name))
            counts = counts.join(number(said, "entity", "num_query_entities"), "query_id", "left").join(number(matched, "concept_id", "num_matched_concepts"), "query_id", "left")
        if min_score_threshold is not None:
            found = found.where(F.col("score") >= min_score_threshold)
        return found, counts.fillna(0)

    def retrieve(self, query: str, method: str | None = None, top_k: int | None = None, **more) -> tuple[list[Result], Metrics]:
        """Results of one question, best first, and what it took."""
        self._check(method or self.config.default_retrieval_method)
        began = time.time()
        found, counts = self.retrieve_all(self.spark.createDataFrame([(0, query)], "query_id bigint, text string"), method, top_k, **more)
        rows = [r.asDict(True) for r in found.orderBy("rank").collect()]
        out = [Result(r["passage_id"], r["content"], r["score"], r["matched_concepts"] or [], r.get("metadata") or {}) for r in rows]
        n = counts.first()
        steps = 0
        if (method or self.config.default_retrieval_method) == "ppr" and n.num_matched_concepts:
            steps = ppr_steps(self.config.ppr_alpha, 1e-6, self.config.ppr_max_iterations)
        return out, Metrics(n.num_query_entities, n.num_matched_concepts, steps, time.time() - began, len(out))

    def query(self, query: str, method: str | None = None, top_k: int | None = None, return_metrics: bool = False, **more):
        results, metrics = self.retrieve(query, method, top_k, **more)
        return (results, metrics) if return_metrics else results

    def statistics(self) -> dict:
        """Counts, mean degrees and the spread of frequencies of the graph."""
        row = G.statistics(self.graph.edges).first().asDict()
        row["passages"] = self.graph.passages.count()
        row["concepts"] = self.graph.concepts.count()
        row["avg_passage_degree"] = row["edges"] / row["passages"] if row["passages"] else 0.0
        row["avg_concept_degree"] = row["edges"] / row["concepts"] if row["concepts"] else 0.0
        return {k: 0 if v is None else v for k, v in row.items()}

    def as_retriever(self, **settings):
        """A retriever of the optional framework ``langchain_core``."""
        from .integrations import retriever

        return retriever(self, **settings)


def _parquet(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(f.getPath().getName().endswith(".parquet") for f in system.listStatus(root))
