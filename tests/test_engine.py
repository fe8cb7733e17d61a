"""The facade, its settings, sources, caches and providers."""

import json

import pytest
from pyspark.sql import functions as F
from quillgraph import config as C, integrations
from quillgraph.engine import Engine, Result
from quillgraph.sources import cache, documents, embeddings as E, json as J, providers as P
from quillgraph.streaming import incremental

CHUNKS = [
    {"content": "Apple Inc announced strong revenue growth in Q4 2024.", "metadata": {"source": "news"}},
    {"content": "Microsoft Corporation reported significant cloud achievements.", "metadata": {"source": "news", "tags": ["a", "b"]}},
    {"content": "The technology sector saw increased competition.", "metadata": {"source": "analysis"}},
]


@pytest.mark.parametrize(
    "make",
    [
        lambda: C.GraphConfig(min_concept_freq=0), lambda: C.GraphConfig(max_concept_freq_ratio=0), lambda: C.GraphConfig(max_concept_freq_ratio=1.5), lambda: C.RetrievalConfig(top_k=0),
        lambda: C.RetrievalConfig(default_retrieval_method="magic"), lambda: C.RetrievalConfig(ppr_alpha=-0.1), lambda: C.RetrievalConfig(ppr_max_iterations=0),
        lambda: C.RetrievalConfig(semantic_weight=0, frequency_weight=0), lambda: C.NERConfig(llm_provider="unknown"), lambda: C.NERConfig(extraction_cache_dir=""),
        lambda: C.EmbeddingConfig(semantic_match_threshold=2.0), lambda: C.StorageConfig(auto_save_graph=True, graph_save_path=None), lambda: C.EngineConfig(top_k=-1),
        lambda: C.EngineConfig(graph_config=object()), lambda: C.EngineConfig(no_such_setting=1),
    ],
)
def test_settings_are_checked(make):
    with pytest.raises((TypeError, ValueError)):
        make()


def test_settings_mirror_each_other():
    c = C.EngineConfig(top_k=3, retrieval_config={"top_k": 7}, min_concept_freq=1)
    assert (c.top_k, c.retrieval_config.top_k, c.graph_config.min_concept_freq, c.min_concept_freq) == (7, 7, 1, 1)
    assert c.to_dict()["retrieval_config"]["top_k"] == 7 and set(c.to_dict()) == set(C.SECTIONS)


def test_build_query_save_and_insert(spark, tmp_path):
    engine = Engine.from_chunks(spark, CHUNKS, C.EngineConfig(top_k=2, min_concept_freq=1), embedding_model=None)
    s = engine.statistics()
    assert s["passages"] == 3 and s["concepts"] > 0 and s["edges"] > 0
    results, metrics = engine.retrieve("What about Apple's revenue?")
    assert [r.passage_id for r in results] == ["passage_0", "passage_1"] and metrics.num_results == 2 and metrics.ppr_iterations == 90
    assert results[0].metadata == {"source": "news"} and "revenue" in results[0].matched_concepts and results[1].score == 0
    assert engine.query("What about Apple's revenue?", min_score_threshold=0.1)[0].content == CHUNKS[0]["content"] and engine.query("zzz") == []
    with pytest.raises(ValueError):
        engine.query("x", method="magic")
    with pytest.raises(ValueError):
        engine.query("x", method="semantic")
    engine.save_graph(str(tmp_path / "g"))
    engine.save_graph(str(tmp_path / "j"), "json")
    for path in ("g", "j"):
        back = Engine.from_graph_file(spark, str(tmp_path / path), engine.config)
        assert [r.id for r in back.query("revenue")] == ["passage_0", "passage_1"]
    with pytest.raises(NotImplementedError):
        engine.add_chunks([], rebuild=False)
    engine.insert(["Apple Inc opened a laboratory", {"text": "Banana laboratory", "metadata": {"k": 1}}])
    assert engine.statistics()["passages"] == 5 and engine.query("laboratory")[0].passage_id in ("passage_3", "passage_4")
    empty = Engine.empty(spark)
    assert empty.statistics()["passages"] == 0 and empty.query("anything") == []


def test_meaning_and_both(spark):
    engine = Engine.from_chunks(spark, CHUNKS, C.EngineConfig(top_k=2, min_concept_freq=1, max_concept_freq_ratio=1.0), embedding_model=E.HashedProvider())
    found = engine.query("Apple revenue growth announced", method="semantic", min_score_threshold=0.1)
    assert found[0].id == "passage_0" and found[0].score == 1.0 and found[0].matched_concepts == []
    both, metrics = engine.retrieve("Apple revenue growth", method="hybrid")
    assert both[0].id == "passage_0" and both[0].matched_concepts and metrics.num_matched_concepts > 0 and both[0].metadata["source"] == "news"
    assert engine.query("Apple revenue")[0].id == "passage_0"


def test_results_and_documents():
    r = Result("p", "text", 0.5, ["c"], {"id": "other", "k": 1})
    assert r.id == "p" and r.text == "text" and r.to_dict()["metadata"] == {"id": "other", "k": 1}
    assert r.to_document() == {"page_content": "text", "metadata": {"id": "p", "k": 1, "passage_id": "p", "score": 0.5, "matched_concepts": ["c"]}}

    class Page:
        page_content, metadata = "x", None

    assert documents.coerce("a", 3) == {"content": "a", "metadata": {"document_index": 3}} and documents.coerce(Page(), 0) == {"content": "x", "metadata": {}}
    assert documents.coerce({"content": "c", "text": "t"}, 0)["content"] == "c"
    with pytest.raises(ValueError):
        documents.coerce({"x": 1}, 0)
    with pytest.raises(TypeError):
        documents.coerce(7, 0)
    if integrations.Document is None:
        with pytest.raises(ImportError):
            integrations.to_documents([r])


def test_files_as_chunks_and_their_index(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.TXT").write_bytes(b"First text of file a. \xff" + b"More words follow here. " * 10)
    (folder / "deep" / "b.md").write_text("Second file")
    (folder / "c.json").write_text(json.dumps(["plain", {"text": "record", "metadata": {"source": "mine", "n": 1}}, {"other": 1}]))
    (folder / "d.json").write_text(json.dumps({"not": "chunks"}))
    (folder / "e.bin").write_text("no")
    rows = documents.load(spark, str(folder), size=100, overlap=10).orderBy("source", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source.rsplit("/", 1)[1], []).append(r)
    assert set(by) == {"a.TXT", "b.md", "c.json", "d.json"} and len(by["a.TXT"]) > 1 and by["a.TXT"][1].metadata["start_char"] != "0"
    assert [(r.content, r.metadata["source"]) for r in by["c.json"]][1] == ("record", "mine") and by["d.json"][0].content.startswith("{")
    assert [r[0] for r in spark.createDataFrame([("my graph!! 1.",), ("???",)], "n string").select(documents.slug(F.col("n"))).collect()] == ["my_graph_1", "graph"]
    out = str(tmp_path / "index")
    assert incremental.index_files(spark, str(folder), out, 100, 10) == 4
    assert incremental.index_files(spark, str(folder), out, 100, 10) == 0
    n = len(rows)
    (folder / "f.txt").write_text("A third file about laboratories")
    assert incremental.index_files(spark, str(folder), out, 100, 10) == 1
    told = {r.name: (r.first_chunk, r.last_chunk) for r in spark.read.parquet(f"{out}/manifest").collect()}
    assert told["f.txt"] == (n, n) and sorted(x for a, b in told.values() for x in range(a, b + 1)) == list(range(n + 1))
    assert incremental.graph(spark, out, 1, 1.0).concept("laboratories").count() == 1


def test_json_rules(spark, tmp_path):
    assert J.sniff([]) == J.sniff(["x"]) == J.sniff("x") == J.sniff({"a": 1}) == J.sniff({"chunks": []}) == "simple_content"
    assert J.sniff([{"content": 1, "document_metadata": {}}]) == J.sniff({"chunks": [{"content": 1}]}) == "chunk_array"
    assert J.sniff([{"question": 1}]) == J.sniff({"chunks": [{"type": 1}]}) == "qa_format" and J.sniff({"document_info": 1}) == "nested_chunks"
    qa, simple = J.RULES["qa_format"], J.RULES["simple_content"]
    assert J.compose(["q", "a"], qa, {"questioner_name": "Ann"}) == "Ann asked: q\n\nUnknown answered: a"
    assert J.compose(["t"], qa, {"speaker_name": "Bo"}) == "Bo said: t" and J.compose(["a", "b"], simple, {"author": "Cy"}) == "Cy: a\n\nb"
    assert J.compose(["a", "b"], simple, {"author": "", "answerer_name": ""}) == "a\n\nb"
    one = J.custom_rule(["content"], min_length=1)
    assert J.compose(["Dee says"], one, {"author": "Dee"}) == "Dee says" and J.compose(["x"], one, {"questioner_name": "Ed"}) == "Ed: x" and J.compose(["x"], one, {"author": None}) == "x"
    assert J.at_path({"a": {"b": 1}}, "a.b") == 1 and J.at_path({"a": 1}, "a.b") is None
    texts = {
        "nested.json": {"metadata": {"document": {"title": "T"}, "passage": {"page": 4}}, "content": "long enough content of this item here", "id": 9, "type": "x"},
        "chunks.json": {"chunks": [{"content": "short"}, "no dict", {"content": "another content that is long enough", "document_metadata": {"source_file": "own"}, "chunk_id": 5}]},
        "bad.json": None,
    }
    for name, data in texts.items():
        (tmp_path / name).write_text("{" if data is None else json.dumps(data))
    got = {r.rule: r for r in J.ingest_files(spark, [str(tmp_path / n) for n in texts]).collect()}
    assert set(got) == {"nested_chunks", "chunk_array"}
    n = got["nested_chunks"]
    assert n.document_metadata["title"] == "T" and n.document_metadata["source_file"] == "nested.json" and n.document_metadata["batch_processing"] == "true" and n.passage_metadata == {"original_index": "0", "page": "4", "chunk_id": "9", "content_type": "x"}
    c = got["chunk_array"]
    assert c.item == 2 and c.document_metadata["source_file"] == "own" and c.passage_metadata["chunk_id"] == "5" and len(c.content_hash) == 32
    with pytest.raises(ValueError):
        J.ingest(spark.createDataFrame([("[]",)], "value string"), "magic")
    seen = J.preview(J.read_json(spark, str(tmp_path / "chunks.json")))
    assert seen["rule"] == "chunk_array" and seen["items"] == 3 and seen["metadata_fields"] == ["chunk_id"] and len(seen["sample"]) == 2
    renamed = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>").select(J.rename_metadata(F.col("m"), {"a": "x"})).first()[0]
    assert renamed == {"x": "1"} and J.estimate({"chunks": [1, 2]}) == 2 and J.estimate({}) == 1
    (tmp_path / "plain.json").write_text(json.dumps([{"body": "b", "metadata": {"k": "v"}}, {"text": "t", "n": 2}]))
    rows = {r.content: json.loads(r.metadata) for r in J.read_chunks(spark, str(tmp_path / "plain.json")).collect()}
    assert rows == {"b": {"metadata": {"k": "v"}}, "t": {"n": 2}}
    short = spark.createDataFrame([("  a b  ",), (None,), (" x　",), ("",)], "content string")
    assert J.min_length(short, least=3).count() == 1


def test_extraction_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([("Apple Inc in 2024", {"source": "a"}), ("broken passage", {"document_id": "d"}), ("Apple Inc in 2024", {"source": "b"}), (None, None)], "content string, document_metadata map<string,string>")

    def extractor(text):
        if "broken" in text:
            raise RuntimeError("no")
        return ["E"], ["C"]

    first = {r.content: r for r in cache.extract(docs, path, extractor, "model").collect()}
    assert len(first) == 2 and first["Apple Inc in 2024"].entities == ["E"] and first["broken passage"].error == "RuntimeError: no" and first["broken passage"].model_used == "patterns"
    known, missing = cache.split(docs, path)
    assert known.count() == 2 and [r.content for r in missing.collect()] == ["broken passage"]
    again = {r.content: r for r in cache.extract(docs, path, lambda t: (["F"], []), "model").collect()}
    assert again["Apple Inc in 2024"].entities == ["E"] and again["broken passage"].entities == ["F"]
    table = cache.load(spark, path)
    row = cache.progress(table, 10).first()
    assert (row.processed, row.failed, row.remaining, row.percent) == (2, 1, 8, 20.0)
    assert cache.summary(table.where("error IS NULL")).first().asDict() == {"documents": 2, "passages": 2, "unique_entities": 2, "unique_concepts": 1}
    assert [r.content for r in cache.document_passages(table.where("error IS NULL"), "d").collect()] == ["broken passage"] and cache.document_registry(table).count() == 2
    cache.export(table, str(tmp_path / "x"), content=False)
    assert "content" not in spark.read.json(str(tmp_path / "x")).columns
    cache.clear(spark, path)
    assert cache.load(spark, path).count() == 0 and abs(cache.cost(1000, (1.0, 2.0)) - (1.3 * 0.6 + 1.3 * 0.4 * 2)) < 1e-9


def test_embedding_cache(spark, tmp_path):
    path, texts = str(tmp_path / "v"), spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    assert E.embed(texts, E.HashedProvider(), path).count() == 2

    class Broken:
        def encode(self, texts):
            raise RuntimeError("down")

    assert E.embed(texts, Broken(), path).count() == 2  # all is known
    assert E.cache_statistics(spark, path).first().vectors == 2
    with pytest.raises(RuntimeError):
        E.encoded(Broken(), ["x"], wait=0)
    E.clear_cache(spark, path)
    assert E.cache_statistics(spark, path).first().vectors == 0
    v = E.embed(texts, E.HashedProvider())
    assert abs(E.pair_similarity("a", "a", v) - 1) < 1e-9 and E.pair_similarity("a", "zz", v) is None


def test_providers():
    assert P.parse_extraction('```json\n{"entities": ["A", null, " "], "concepts": ["c"]}\n```') == (["A"], ["c"])
    assert P.parse_extraction("Entities:\n- A\n2. B\nConcepts\n* c") == (["A", "B"], ["c"]) and P.parse_extraction("[1]") == ([], [])
    assert P.parse_query('["bb", "aa", "aa", "x"]') == ["aa", "bb"] and P.parse_query("3") == []
    assert P.parse_query("I say 'Apple' and \"pie\"") == ["Apple", "pie"] and P.parse_query('{"entities": ["Apple"]}') == ["Apple"]
    calls = []

    def send(prompt, system):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return '{"entities": ["E"], "concepts": []}', 1000

    got = P.provider("openai", send, "m", wait=0)
    assert P.extractor(got)("text") == (["E"], []) and len(calls) == 3
    bad = P.Called(lambda p, s: 1 / 0, "groq", "m", wait=0)
    assert bad.generate("x").error.startswith("ZeroDivisionError") and not bad.generate("x").success
    for f in (P.extractor(bad), P.query_extractor(bad)):
        with pytest.raises(RuntimeError):
            f("x")
    with pytest.raises(ValueError):
        P.provider("none", send)
    with pytest.raises(RuntimeError):
        P.provider("groq")
    assert P.answer_question(got, "q", []).startswith("No passage") and abs(P.price(1000, "openai") - (0.6 * 0.00005 + 0.4 * 0.0004)) < 1e-12
