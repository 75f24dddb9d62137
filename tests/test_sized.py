"""What a task or the driver holds doesn't grow with the large tables."""

import os
from collections import Counter

import duckdb
import pytest

from axiomloom import catalogue
from axiomloom.plans import sized


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces(spark):
    rows = spark.range(1000).selectExpr("id % 300 AS a", "id % 2 AS b")
    found = sized.unique(rows, 1000, each=100)
    assert "HashAggregate" not in plan(found).partition("Exchange")[2]  # nothing is gathered before rows are dealt
    assert found.rdd.getNumPartitions() == 10 and found.count() == 300
    assert sized.dealt_by(rows, 0, "a").count() == sized.dealt_by(rows, 1000, "a", each=1).count() == 1000


@pytest.mark.parametrize("block", [1, 3, 512])
def test_symmetric_pairs(spark, tmp_path, monkeypatch, block):
    """Repeated rows give repeated pairs, as the SQL says; rows without a nation or key pair with none; pairs are never compared."""
    rows = [(k, k % 2) for k in range(9)] + [(3, 1), (4, 1), (None, 1), (20, None)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(catalogue, "NEAR", block)
    found = catalogue.symmetric_property_assertions(spark, str(tmp_path))
    want = duckdb.connect().execute(catalogue.SQL["symmetric_property_assertions"].replace("supplier a", f"'{tmp_path}/supplier.parquet/*.parquet' a").replace("supplier b", f"'{tmp_path}/supplier.parquet/*.parquet' b")).fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert "hashpartitioning(prop" not in plan(found) and "HashAggregate(keys=[subject" not in plan(found)


def test_symmetric_pairs_of_none(spark, tmp_path):
    spark.createDataFrame([], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert catalogue.symmetric_property_assertions(spark, str(tmp_path)).count() == 0


def test_assertions_are_not_dealt_by_property(spark, sf_dir):
    """Two properties would send all assertions to two tasks."""
    found = catalogue.domain_range_types(spark, sf_dir)
    assert "hashpartitioning(prop" not in plan(found)


def test_asserted_types_are_not_broadcast(spark, sf_dir):
    text = plan(catalogue.remove_trivial(spark, sf_dir))
    assert not [line for line in text.splitlines() if "BroadcastHashJoin" in line and "LeftAnti" in line]
    assert "hashpartitioning(cls" not in text  # few classes


def test_relations_in_pieces(spark, monkeypatch):
    """Entities that are asked for twice, or are null, give no more rows; pieces are dealt by numbers of rows."""
    from axiomloom.operators import relations

    edges = spark.createDataFrame([("a", "b", "types", "1"), ("a", "c", "types", "2"), (None, "c", "types", "3"), ("d", "e", "domains", "4")], "src string, dst string, rel string, axiom_id string")
    asked = spark.createDataFrame([("a",), ("a",), (None,), ("d",)], "iri string")
    monkeypatch.setattr(relations, "dealt_by", lambda df, rows, *by: sized.dealt_by(df, rows, *by, each=1))
    found = relations.directly_related(edges, asked, {"types"})
    assert "REPARTITION_BY_NUM" in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "b", "types", "1"), ("a", "c", "types", "2")]


def test_absent_kinds_are_empty_plans(spark, sf_dir):
    """Joins with what no axiom says aren't carried out."""
    from axiomloom.catalogue import Tables, iri
    from axiomloom.catalogue_terms import _reasoner, _row

    nations = Tables(spark, sf_dir).nation
    reasoner = _reasoner(spark, [_row(nations, "Declaration", iri("nation", "n_nationkey"), "class"), _row(nations.limit(1), "SubClassOf", "a", "http://www.w3.org/2002/07/owl#Nothing")])
    facts = reasoner.of("ObjectPropertyAssertion").join(nations, reasoner.of("ObjectPropertyAssertion")["a1"] == nations["n_name"])
    for df in (facts, reasoner._with("some")):
        assert "LocalTableScan <empty>" in plan(df) and "Join" not in plan(df)
    assert {tuple(r) for r in reasoner.saturated()[0].where("a = 'a' and b like '%Nothing'").collect()} == {("a", "http://www.w3.org/2002/07/owl#Nothing")}
