import duckdb
import pytest
from quillgraph.plans.catalogue import ORACLES, QUERIES

from . import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare.differences(spark, name, QUERIES[name], ORACLES[name], SF) is None


def test_edge_weights_equal_their_sql_to_the_last_digit_at_ties(spark, tmp_path):
    texts = [
        "x " * 32 + "Tbcdefghijklmno" + " x" * 287,  # .0109375 + .125 + .14
        "y " * 24 + "Ubcdefghijklmno" + " y" * 39,  # .0546875 + .175 + .14
        "Vbcdefghijklmno revenue" + " abcd" * 7 + " abcdefghijk" + " x" * 54,  # .5196875, whose product with a million is less than a half above the integer
        "x " * 160 + "Wbcdefghijklmno" + " x" * 159,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.term: r.asDict() for r in QUERIES["edge_weights"](spark, str(tmp_path)).collect()}
    rel = con.sql(ORACLES["edge_weights"])
    want = {r[1]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
    assert got.keys() == want.keys() and len(got) == 4
    for term, row in want.items():
        assert got[term] == row | {"position": float(row["position"])}, term
    assert got["Vbcdefghijklmno"]["weight"] == 0.519687 and got["Wbcdefghijklmno"]["weight"] == 0.275938


def test_flagship_finds_the_gold_documents(spark):
    rows = {r.k: r for r in QUERIES["hit_at_k"](spark, SF).collect()}
    asked, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    # rates are over all queries; only some have a gold document
    share = asked.join(docs, docs["text"].contains(asked["text"]), "left_semi").count() / asked.count()
    assert 0 < share < 1 and rows[10].hit >= 0.9 * share and rows[10].mrr > 0.5 * share and rows[10].coverage >= 0.9


def test_entry_module_loads(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "passage_id", "score", "rank", "content", "matched_concepts"]
    assert set(e.oracle_sql()) <= set(e.queries())
