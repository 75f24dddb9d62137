"""Every registered ontology query against its SQL, and operators on edge cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from axiomloom import catalogue, catalogue_sources, catalogue_terms  # noqa: F401 -- the last two register queries
from axiomloom.operators import closure, compile, inference, lookup, store
from axiomloom.streaming import deltas


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf_dir, db, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    res = db.execute(catalogue.SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in res.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_closure_cases(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("d", None), ("x", "y")])
    got = {(r.start, r.node): r.depth for r in closure.closure(e).collect()}
    assert got[("a", "a")] == 3 and got[("a", "c")] == 2 and ("x", "y") in got and len(got) == 10
    assert closure.closure(edges(spark, [])).count() == 0
    assert {(r.start, r.node, r.depth) for r in closure.closure(e, spark.createDataFrame([("x",), ("z",)], "start string"), include_start=True).collect()} == {("x", "x", 0), ("x", "y", 1), ("z", "z", 0)}
    assert {(r.node, r.root) for r in closure.mutual(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    # expanding twice changes nothing
    once = closure.closure(e).select(F.col("start").alias("src"), F.col("node").alias("dst"))
    assert {tuple(r)[:2] for r in closure.closure(once).collect()} == set(got)


def test_reduction_with_equivalents(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("c", "d")])
    assert {tuple(r) for r in closure.direct(e).collect()} == {("a", "c"), ("b", "c"), ("c", "d")}


def test_label_cases(spark):
    labels = spark.createDataFrame([("x", "r/1"), ("x", "r/1"), ("x", "s/2"), ("y", "r/3")], "label string, iri string")
    asked = spark.createDataFrame([("x", ""), ("x", "s/"), ("x", "q/"), ("y", None), ("z", "")], "label string, root string")
    got = {(r.label, r.root): (r.iri, r.status) for r in lookup.lookup_labels(asked, labels).collect()}
    assert got == {("x", ""): (None, "ambiguous"), ("x", "s/"): ("s/2", "found"), ("x", "q/"): (None, "invalid"), ("y", ""): ("r/3", "found"), ("z", ""): (None, "invalid")}


def test_definitions(spark):
    labels = spark.createDataFrame([("test class", "http://purl.obolibrary.org/obo/T_0010"), ("other", "http://f/ID_1"), ("far", "http://g/ID_2")], "label string, iri string")
    prefixes = spark.createDataFrame([("f", "http://f/")], "prefix string, namespace string")
    texts = {"An {'test class'}.": "An 'test class' (T:0010).", "An {test class'}.": "An 'test class' (T:0010).", "An {T:test class}.": "An T:'test class' (T:0010).", "{$test class}": "(T:0010)", "{} and {test class}": "{} and 'test class' (T:0010)", "{other} {far}": "'other' (f:ID_1) 'far' (http://g/ID_2)", "plain": "plain", "{lost}": "{lost}"}
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {r.text: (r.expanded, r.missing) for r in compile.expand_definitions(df, labels, prefixes, "http://purl.obolibrary.org/obo/").collect()}
    assert {t: x for t, (x, _) in got.items()} == texts and [t for t, (_, m) in got.items() if m] == ["{lost}"]


def test_term_errors(spark):
    with pytest.raises(compile.TermTableError):
        compile.term_rows(spark.createDataFrame([("1",)], "ID string"))
    rows = compile.term_rows(spark.createDataFrame([("A:1", "klass", ""), ("", "Class", None), ("A:2", "Data Property", "")], "ID string, Type string, Ignore string"))
    assert compile.bad_rows(rows).count() == 2 and {tuple(r) for r in compile.declared(rows.where("id <> ''")).collect()} == {("A:2", "dprop")}


def test_recognised(spark):
    types = spark.createDataFrame([("i", "A"), ("j", "B"), ("k", "A")], "ind string, cls string")
    facts = spark.createDataFrame([("i", "p", "j"), ("k", "p", "k")], "subject string, prop string, object string")
    d = spark.createDataFrame([("D", 1, None, "A"), ("D", 2, "p", "B")], "cls string, part int, prop string, filler string")
    assert [tuple(r) for r in inference.recognised(types, facts, d).collect()] == [("i", "D")]


def test_imports(spark):
    i = spark.createDataFrame([("a", "b"), ("b", "c")], "ontology_iri string, import_iri string")
    assert store.with_import(store.with_import(i, "a", "z"), "a", "z").count() == 3
    assert {tuple(r) for r in store.updated_import(i, "a", "b", "q").collect()} == {("a", "q"), ("b", "c")}
    with pytest.raises(store.OntologyError):
        store.updated_import(i, "a", "nope", "q")
    assert store.without_import(i, "a", "b").count() == 1


def test_streamed_types(spark, tmp_path):
    told = edges(spark, [("A", "B"), ("B", "C")])
    for k, rows in enumerate(([("i", "A")], [("j", "B"), ("i", "A")])):
        spark.createDataFrame(rows, "ind string, cls string").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ind string, cls string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = deltas.stream_types(stream, told, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = inference.inferred_types(spark.createDataFrame([("i", "A"), ("j", "B")], "ind string, cls string"), told)
    assert {tuple(r) for r in deltas.current_types(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in batch.collect()}


def test_streamed_counts(spark, tmp_path):
    rows = [("2026-01-01 00:01:00", "a"), ("2026-01-01 00:02:00", "a"), ("2026-01-01 00:12:00", "b"), ("2026-01-01 02:00:00", "a")]
    df = spark.createDataFrame(rows, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = deltas.stream_counts(stream, "ts", "k").writeStream.format("memory").queryName("streamed_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.n, r.start.minute, r.start.hour) for r in spark.table("streamed_counts").collect()} == {("a", 2, 0, 0), ("b", 1, 10, 0), ("a", 1, 0, 2)}
