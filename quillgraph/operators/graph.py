"""Bipartite passage-concept graph: mentions, frequency band, concepts, edges, statistics, merging.

A graph is three tables: ``passages(passage_id, content, chunk_index)``,
``concepts(concept_id, concept_text, concept_type, frequency)`` and
``edges(passage_id, concept_id, weight)``. Nulls in a key are left out;
repeated rows count once; empty inputs give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import cut, parted, spread
from . import weights as W
from .components import connected_components

PASSAGES = "passage_id string, content string, chunk_index bigint, metadata map<string,string>"
CONCEPTS = "concept_id string, concept_text string, concept_type string, frequency bigint"
EDGES = "passage_id string, concept_id string, weight double"
EMBEDDINGS = "concept_id string, embedding array<double>"


@dataclass
class Graph:
    passages: DataFrame
    concepts: DataFrame
    edges: DataFrame

    embeddings: DataFrame | None = None

    def save(self, path: str) -> None:
        """One Parquet table each, weights included; the statistics of a run are derived from these."""
        for name in ("passages", "concepts", "edges", *(["embeddings"] if self.embeddings is not None else [])):
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/embeddings")
        more = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        return Graph(*[spark.read.parquet(f"{path}/{name}") for name in ("passages", "concepts", "edges")], spark.read.parquet(f"{path}/embeddings") if more else None)

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(*[spark.createDataFrame([], schema) for schema in (PASSAGES, CONCEPTS, EDGES)])

    def export_json(self, path: str) -> None:
        """Nested JSON lines: one for each passage with its concepts."""
        held = self.edges.groupBy("passage_id").agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"))
        self.passages.join(held, "passage_id", "left").write.json(path)

    def records(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Passages with their concepts, concepts with their passages, and the concepts of each passage, as the JSON format has them."""
        of = lambda key, value, name: self.edges.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
        none = F.array().cast("array<string>")
        by_passage, by_concept = of("passage_id", "concept_id", "concepts"), of("concept_id", "passage_id", "passage_ids")
        metadata = F.col("metadata") if "metadata" in self.passages.columns else F.create_map().cast("map<string,string>")
        passages = self.passages.join(by_passage, "passage_id", "left").select("passage_id", "content", "chunk_index", F.coalesce("concepts", none).alias("concepts"), metadata.alias("metadata"))
        concepts = self.concepts.join(by_concept, "concept_id", "left").select("concept_id", "concept_text", "concept_type", "frequency", F.coalesce("passage_ids", none).alias("passage_ids"))
        return passages, concepts, by_passage

    def write_json(self, path: str) -> None:
        """The JSON format as a folder of JSON lines for each of its parts: passages, concepts, edges and concept embeddings."""
        passages, concepts, edges = self.records()
        for name, df in (("passages", passages), ("concepts", concepts), ("edges", edges), ("concept_embeddings", self.embeddings)):
            if df is not None:
                df.write.json(f"{path}/{name}")

    @staticmethod
    def read_json(spark: SparkSession, path: str) -> Graph:
        """A graph in the JSON format: a folder that :meth:`write_json` made, or one document; it has no weights, so they are 1."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/passages")
        kinds = {
            "passages": "passage_id string, content string, chunk_index bigint, concepts array<string>, metadata map<string,string>",
            "concepts": f"{CONCEPTS}, passage_ids array<string>",
        }
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            passages, concepts = (spark.read.schema(k).json(f"{path}/{n}") for n, k in kinds.items())
            edges = spark.read.schema("passage_id string, concepts array<string>").json(f"{path}/edges").select("passage_id", F.explode("concepts").alias("concept_id"))
            vectors = spark.read.schema(EMBEDDINGS).json(f"{path}/concept_embeddings*") if _there(spark, f"{path}/concept_embeddings") else None
        else:
            whole = spark.read.schema(
                ", ".join(f"{n} array<struct<{k.replace(' ', ':')}>>".replace(",:", ",") for n, k in kinds.items()) + ", edges map<string,array<string>>, concept_embeddings map<string,array<double>>"
            ).option("multiLine", True).json(path)
            passages, concepts = (whole.select(F.inline(n)) for n in kinds)
            edges = whole.select(F.explode("edges").alias("passage_id", "c")).select("passage_id", F.explode("c").alias("concept_id"))
            vectors = whole.where("concept_embeddings IS NOT NULL").select(F.explode("concept_embeddings").alias("concept_id", "embedding"))
        return Graph(passages.drop("concepts"), concepts.drop("passage_ids"), edges.distinct().withColumn("weight", F.lit(1.0)), vectors)

    def chunks(self) -> DataFrame:
        """``content, metadata`` of the passages, in order."""
        return self.passages.orderBy("chunk_index", "passage_id").select("content", *(["metadata"] if "metadata" in self.passages.columns else []))

    def passage(self, passage_id) -> DataFrame:
        return self.passages.where(F.col("passage_id") == passage_id)

    def concept(self, concept_id) -> DataFrame:
        return self.concepts.where(F.col("concept_id") == concept_id)

    def neighbours(self, passage_id=None, concept_id=None) -> DataFrame:
        """Concepts of a passage or passages of a concept, with the edges' weights."""
        if (passage_id is None) == (concept_id is None):
            raise ValueError("give a passage_id or a concept_id")
        mine, other, at = ("passage_id", "concept_id", passage_id) if concept_id is None else ("concept_id", "passage_id", concept_id)
        return self.edges.where(F.col(mine) == at).select(other, "weight")

    def nodes(self, flat: bool = False) -> DataFrame:
        """``id, node_type, bipartite`` and attributes of all nodes: contents cut to 200 characters, counts, texts, metadata."""
        passages, concepts, _ = self.records()
        text = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
        p = passages.select(
            F.concat(F.lit("passage:"), F.col("passage_id").cast("string")).alias("id"), F.lit("passage").alias("node_type"), F.lit(0).alias("bipartite"), text.alias("content"), "chunk_index",
            F.size("concepts").alias("num_concepts"), (F.transform_keys("metadata", lambda k, v: F.concat(F.lit("passage_"), k)) if flat else F.col("metadata")).alias("metadata"),
        )
        c = concepts.select(
            F.concat(F.lit("concept:"), F.col("concept_id").cast("string")).alias("id"), F.lit("concept").alias("node_type"), F.lit(1).alias("bipartite"), "concept_text", "concept_type", "frequency", F.size("passage_ids").alias("num_passages")
        )
        return p.unionByName(c, allowMissingColumns=True)

    def links(self) -> DataFrame:
        """``src, dst, weight, concept_frequency`` of all edges between the ids of :meth:`nodes`."""
        name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        return self.edges.join(self.concepts.select("concept_id", "frequency"), "concept_id").select(name("passage", "passage_id").alias("src"), name("concept", "concept_id").alias("dst"), "weight", F.col("frequency").alias("concept_frequency"))


def _there(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def flatten(value: object, prefix: str = "") -> dict[str, object]:
    """Nested metadata as one level: keys joined by ``_``, lists of texts by a comma, other lists as text, None as an empty text."""
    out: dict[str, object] = {}
    for k, v in value.items() if isinstance(value, dict) else ():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}_")
        elif isinstance(v, list):
            out[f"{prefix}{k}"] = ", ".join(v) if all(isinstance(x, str) for x in v) else str(v)
        else:
            out[f"{prefix}{k}"] = "" if v is None else v if isinstance(v, (str, int, float)) else str(v)
    return out


def mentions(passages: DataFrame, entities: Column | None = None, concepts: Column | None = None) -> DataFrame:
    """``passage_id, chunk_index, kind_rank, surface, concept_id``: one row for each distinct surface of a kind."""
    entities = T.entities(F.col("content")) if entities is None else entities
    concepts = T.concepts(F.col("content")) if concepts is None else concepts
    parts = F.array(F.struct(F.lit(0).alias("kind_rank"), entities.alias("surfaces")), F.struct(F.lit(1).alias("kind_rank"), concepts.alias("surfaces")))
    return (
        spread(passages)
        .select("passage_id", "chunk_index", F.inline(parts))
        .select("passage_id", "chunk_index", "kind_rank", F.explode(F.array_distinct("surfaces")).alias("surface"))
        .withColumn("concept_id", T.normalize(F.col("surface")))
        .where("concept_id <> '' AND passage_id IS NOT NULL")
    )


def band(found: DataFrame, passages: int, min_freq: int = 2, max_ratio: float = 0.5) -> DataFrame:
    """``concept_id, n, first, frequency`` of concepts whose number ``n`` of mention rows lies in ``min_freq .. int(passages * max_ratio)``."""
    first = F.min(F.struct("chunk_index", "kind_rank", "surface")).alias("first")
    counted = found.groupBy("concept_id").agg(F.count("*").alias("n"), first, F.countDistinct("passage_id").alias("frequency"))
    return counted.where(F.col("n").between(min_freq, int(passages * max_ratio)))


def build(passages: DataFrame, min_freq: int = 2, max_ratio: float = 0.5, **extracted: Column) -> Graph:
    """Concepts whose number of mention rows lies in ``min_freq .. int(passages * max_ratio)``, and their edges."""
    if min_freq < 1 or not 0 < max_ratio <= 1:
        raise ValueError("min_freq must be at least 1 and max_ratio in (0, 1]")
    return from_mentions(passages, cut(mentions(passages, **extracted)), min_freq, max_ratio)


def from_mentions(passages: DataFrame, found: DataFrame, min_freq: int = 2, max_ratio: float = 0.5) -> Graph:
    """The graph of mention rows that are already there."""
    banded = band(found, passages.count(), min_freq, max_ratio)
    kind = F.when(F.col("first.kind_rank") == 0, "named_entity").otherwise("concept")
    concepts = cut(banded.select("concept_id", F.col("first.surface").alias("concept_text"), kind.alias("concept_type"), "frequency"))
    edges = cut(found.join(concepts.select("concept_id"), "concept_id", "left_semi").select("passage_id", "concept_id").distinct().withColumn("weight", F.lit(1.0)))
    return Graph(passages, concepts, edges)


def from_extractions(extractions: DataFrame, min_freq: int = 1, max_ratio: float = 0.5, weighted: bool = True, separate_types: bool = True) -> Graph:
    """A weighted graph of extraction records ``passage_hash, content, entities, concepts[, passage_metadata, document_metadata, n]``.

    Contents of fewer than ten characters are left out. A record without a
    hash is ``passage_<number>``, by ``n`` or else by content. Of records with
    one hash the last (by ``n``) is the passage, and all are counted. An edge
    weighs as its passage's mentions of the concept's own text, and 1 if the
    passage writes it otherwise.
    """
    if min_freq < 1 or not 0 < max_ratio <= 1:
        raise ValueError("min_freq must be at least 1 and max_ratio in (0, 1]")
    long = extractions.where("length(trim(content)) >= 10")
    if "n" not in long.columns or long.where("n IS NULL").limit(1).count():  # numbers are given here only where records have none
        order = Window.orderBy(*([F.col("n").asc_nulls_last()] if "n" in long.columns else []), "content", "passage_hash")
        long = long.withColumn("__n", F.row_number().over(order) - 1).drop("n").withColumnRenamed("__n", "n")
    meta = lambda name: F.col(name).cast("map<string,string>") if name in long.columns else F.create_map().cast("map<string,string>")
    known = cut(
        long.select(
            F.coalesce("passage_hash", F.concat(F.lit("passage_"), F.col("n").cast("string"))).alias("passage_id"), "content", F.col("n").cast("bigint").alias("n"),
            F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), meta("passage_metadata").alias("pm"), meta("document_metadata").alias("dm"),
        )
    )
    passages = known.groupBy("passage_id").agg(F.max_by(F.struct("content", "n", "pm", "dm"), "n").alias("r")).select(
        "passage_id", "r.content", F.coalesce(F.expr("try_cast(r.pm['original_index'] AS bigint)"), "r.n").alias("chunk_index"), F.map_concat("r.dm", F.map_filter("r.pm", lambda k, v: ~F.map_contains_key("r.dm", k))).alias("metadata")
    )
    kinds = F.array(F.struct(F.lit(0).alias("kind_rank"), F.col("entities").alias("surfaces")), F.struct(F.lit(1).alias("kind_rank"), F.col("concepts").alias("surfaces")))
    found = cut(
        known.select("passage_id", F.col("n").alias("chunk_index"), F.inline(kinds)).select("passage_id", "chunk_index", "kind_rank", F.explode("surfaces").alias("surface")).withColumn("concept_id", T.normalize(F.col("surface"))).where("concept_id <> ''")
    )
    banded = band(found, known.count(), min_freq, max_ratio)
    kind = F.when(F.lit(separate_types), F.when(F.col("first.kind_rank") == 0, "named_entity").otherwise("document_concept")).otherwise("concept")
    concepts = cut(banded.select("concept_id", F.col("first.surface").alias("concept_text"), kind.alias("concept_type"), "frequency"))
    edges = found.select("passage_id", "concept_id").distinct().join(concepts.select("concept_id", "concept_text"), "concept_id")
    if weighted:
        typed = F.when(F.col("kind_rank") == 1, "CONCEPT").otherwise(T.entity_type(F.col("surface")))
        terms = found.groupBy("passage_id", F.col("surface").alias("term")).agg(F.max_by(typed, "kind_rank").alias("kind"))
        weights = W.edge_weights(passages, terms).select("passage_id", F.col("term").alias("concept_text"), "weight")
        edges = edges.join(weights, ["passage_id", "concept_text"], "left").select("passage_id", "concept_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    else:
        edges = edges.select("passage_id", "concept_id", F.lit(1.0).alias("weight"))
    return Graph(cut(passages), concepts, cut(edges))


def structure(edges: DataFrame, passages: DataFrame | None = None, concepts: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, density, connected components, degrees; nodes without an edge count if their tables are given."""
    rows = edges.count()
    with parted(edges.sparkSession, rows):
        e = cut(edges.select("passage_id", "concept_id").distinct())
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ends = e.select(node("p", "passage_id").alias("src"), node("c", "concept_id").alias("dst"))
    with parted(edges.sparkSession, 2 * rows):
        degree = cut(ends.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")))
    every = degree.select("node")
    for df, kind, c in ((passages, "p", "passage_id"), (concepts, "c", "concept_id")):
        if df is not None:
            every = every.union(df.select(node(kind, c)))
    all_ = degree if passages is None and concepts is None else every.distinct().join(degree, "node", "left").fillna(0, ["degree"])
    label = connected_components(ends).select("component").distinct().agg(F.count("*").alias("held"))
    counts = all_.agg(
        F.count("*").alias("nodes"), F.count(F.when(F.col("node").startswith("p"), 1)).alias("passage_nodes"), F.count(F.when(F.col("node").startswith("c"), 1)).alias("concept_nodes"),
        F.count(F.when(F.col("degree") == 0, 1)).alias("alone"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"),
    ).crossJoin(label)
    v, n = F.col("nodes"), (F.col("ends") / 2).cast("bigint")
    parts = F.col("held") + F.col("alone")
    return counts.select(
        "nodes", n.alias("edges"), F.when(v > 1, 2 * n / (v * (v - 1))).otherwise(0.0).alias("density"), (parts == 1).alias("is_connected"), parts.alias("components"),
        "passage_nodes", "concept_nodes", F.lit(True).alias("is_bipartite"), (n / F.greatest(F.lit(1), F.col("passage_nodes") * F.col("concept_nodes"))).alias("bipartite_density"), "avg_degree", "max_degree", "min_degree",
    )


def top_concepts(concepts: DataFrame, edges: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` concepts of highest degree, frequency and text."""
    degree = edges.groupBy("concept_id").agg(F.count("*").alias("degree"))
    return concepts.join(degree, "concept_id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), F.desc("frequency"), F.desc("concept_text")).limit(k)


def statistics(edges: DataFrame) -> DataFrame:
    """One row: counts, average degrees of both sides, and the spread of concept frequencies."""
    sides = edges.agg(F.count("*").alias("edges"), F.countDistinct("passage_id").alias("passages"), F.countDistinct("concept_id").alias("concepts"))
    freq = edges.groupBy("concept_id").agg(F.count("*").alias("f")).agg(
        F.min("f").alias("min_frequency"), F.max("f").alias("max_frequency"), F.avg("f").alias("mean_frequency"), F.median("f").alias("median_frequency"), F.stddev_pop("f").alias("std_frequency")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sides.withColumns({"avg_passage_degree": ratio("edges", "passages"), "avg_concept_degree": ratio("edges", "concepts")}).crossJoin(freq)


def degrees(edges: DataFrame) -> DataFrame:
    """``side, node, degree`` of all nodes."""
    side = lambda c, name: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("degree")).select(F.lit(name).alias("side"), F.col("node").cast("string").alias("node"), "degree")
    return side("passage_id", "passage").unionByName(side("concept_id", "concept"))


def top_degree(edges: DataFrame, k: int = 30) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "side", "node").limit(k)


def search(concepts: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    text = F.col("concept_text")
    return concepts.where(F.contains(text, F.lit(query)) if case_sensitive else F.contains(F.lower(text), F.lit(query.lower())))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of two graphs; the larger weight of an edge in both."""
    return a.unionByName(b).groupBy("passage_id", "concept_id").agg(F.max("weight").alias("weight"))


def merge_all(a: Graph, b: Graph) -> Graph:
    """Two graphs by their ids: the first graph's passage and concept of an id in both, all edges with the larger weight, frequencies counted anew."""
    edges = cut(merge(a.edges.select("passage_id", "concept_id", "weight"), b.edges.select("passage_id", "concept_id", "weight")))
    passages = a.passages.unionByName(b.passages.join(a.passages.select("passage_id"), "passage_id", "left_anti"), allowMissingColumns=True)
    concepts = a.concepts.unionByName(b.concepts.join(a.concepts.select("concept_id"), "concept_id", "left_anti"), allowMissingColumns=True)
    counted = edges.groupBy("concept_id").agg(F.countDistinct("passage_id").alias("__n"))
    concepts = concepts.join(counted, "concept_id", "left").withColumn("frequency", F.coalesce("__n", "frequency")).drop("__n")
    return Graph(passages, concepts, edges)


def append(a: Graph, b: Graph) -> Graph:
    """``a`` with the passages of ``b`` added as ``passage_<n>``, numbered on from ``a`` in the order of their chunks."""
    before = a.passages.count()
    ranked = b.passages.select("passage_id", "chunk_index").orderBy("chunk_index", "passage_id")
    sorted_ = cut(ranked.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    at = {r["part"]: r["n"] for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ahead, done = [], before
    for part in sorted(at):
        ahead.append((part, done))
        done += at[part]
    begin = b.passages.sparkSession.createDataFrame(ahead, "part int, begin bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy("i")) - 1 + F.col("begin")
    ids = cut(sorted_.join(F.broadcast(begin), "part").withColumn("n", place).select("passage_id", F.concat(F.lit("passage_"), F.col("n").cast("string")).alias("new"), F.col("n").cast("bigint").alias("n")))
    passages = b.passages.join(ids, "passage_id").drop("passage_id", "chunk_index").withColumnsRenamed({"new": "passage_id", "n": "chunk_index"})
    edges = b.edges.join(ids, "passage_id").select(F.col("new").alias("passage_id"), "concept_id", "weight")
    base = Graph(a.passages.withColumn("passage_id", F.col("passage_id").cast("string")), a.concepts, a.edges.withColumn("passage_id", F.col("passage_id").cast("string")))
    return merge_all(base, Graph(passages, b.concepts, edges))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after replacing ``duplicate`` concepts by ``canonical`` ones; the larger weight of edges that meet."""
    to = mapping.select(F.col("duplicate").alias("concept_id"), "canonical")
    return edges.join(to, "concept_id", "left").groupBy("passage_id", F.coalesce("canonical", "concept_id").alias("concept_id")).agg(F.max("weight").alias("weight"))
