import pytest
from pyspark.sql import functions as F

from axiomloom.functions import delimited, identifiers, manchester, phrases, porter


@pytest.mark.parametrize(
    "text, values",
    [
        ("", []), (" \t ", []), (";", []), (r"\;", [";"]), (r"\"", [r"\""]), (";;two words;; ; values;", ["two words", "values"]),
        ('a "b; c" d', ['a "b; c" d']), ('a "b; c" ; d', ['a "b; c"', "d"]), (r'"x; y"; and \; more', ['"x; y"', "and ; more"]), (r'"x \"quoted\""', [r'"x \"quoted\""']),
    ],
)
def test_delimited(text, values):
    assert delimited.parse(text) == values


def test_delimited_signs():
    assert delimited.parse("\"a;,\"; b, 'c,'", ",;", "'\"") == ['"a;,"', "b", "'c,'"]
    assert delimited.parse('one "two\tthree"', " \t", '"') == ["one", '"two\tthree"']
    with pytest.raises(delimited.DelimitedStringError):
        delimited.parse('a "b')
    assert [delimited.unquote(x) for x in ('"a"', 'a"', r'"a\"b"', '"', r'"a\"')] == ["a", 'a"', 'a"b', '"', r'"a\"']


def test_delimited_columns(spark):
    rows = [("a; b",), ('x "y; z"; w',), (None,), ("",)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(delimited.split_delimited(F.col("t")).alias("v")).collect()]
    assert got == [["a", "b"], ['x "y; z"', "w"], [], []]
    assert [r.v for r in spark.createDataFrame([('"a\\"b"',), ("c",)], "t string").select(delimited.unquoted(F.col("t")).alias("v")).collect()] == ['a"b', "c"]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "flies": "fli", "dies": "die", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "relational": "relat", "digitizer": "digit", "decisiveness": "decis", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "labels": "label", "testing": "test", "is": "is", "dying": "die"}
    assert {w: porter.stem(w) for w in pairs} == pairs


def test_phrases(spark):
    def one(col, text):
        return spark.createDataFrame([(text,)], "t string").select(col.alias("v")).first().v

    t = F.col("t")
    assert one(phrases.depunctuate(t), "the cat's dogs' (big) “tail” x's") == "the cat dogs big tail xs"
    assert one(phrases.depunctuate(t), "back\\slash") == "back\\slash"
    runs = one(phrases.sub_phrases(phrases.phrase_words(t)), "name of the cat")
    assert {" ".join(r) for r in runs} == {"name", "cat", "name of", "the cat", "name of the", "of the cat"}
    assert one(phrases.sub_phrases(phrases.phrase_words(t)), "single") == []
    assert {" ".join(r) for r in one(phrases.sub_phrases(phrases.phrase_words(t), longest=1), "red old cat")} == {"red", "old", "cat"}


def test_identifiers(spark):
    df = spark.createDataFrame([("OBO:0001",), ("A_B:12",), ("OBO:x",), ("1BO:1",), ("'a label'",), ("p:'x'",), ("p:rest",), ("bad iri",)], "id string")
    got = {r.id: (r.obo, r.iri, r.label) for r in df.select("id", identifiers.is_obo_id(F.col("id")).alias("obo"), identifiers.obo_to_iri(F.col("id")).alias("iri"), identifiers.is_label(F.col("id")).alias("label")).collect()}
    assert got["OBO:0001"] == (True, "http://purl.obolibrary.org/obo/OBO_0001", False)
    assert got["A_B:12"][1].endswith("A_B_12") and not got["OBO:x"][0] and not got["1BO:1"][0]
    assert got["'a label'"][2] and got["p:'x'"][2] and not got["p:rest"][2]
    iris = identifiers.expand_iri(df, "id", spark.createDataFrame([("p", "http://p/")], "prefix string, namespace string"))
    full = {r.id: r.iri for r in iris.collect()}
    assert full["p:rest"] == "http://p/rest" and full["OBO:x"] == "OBO:x" and full["bad iri"] is None
    back = spark.createDataFrame([("http://purl.obolibrary.org/obo/OBO_0001",), ("http://x/OBO_1",)], "i string").select(identifiers.iri_to_obo(F.col("i")).alias("o"))
    assert [r.o for r in back.collect()] == ["OBO:0001", None]


def test_manchester():
    assert manchester.parse_class("'a b' AND not c or d") == ("or", ("and", ("named", "'a b'"), ("not", ("named", "c"))), ("named", "d"))
    assert manchester.parse_class("p some (q only {x, y})") == ("some", "p", ("only", "q", ("oneof", ("named", "x"), ("named", "y"))))
    assert manchester.parse_class("p min 2 c and q max 1") == ("and", ("min", "p", 2, ("named", "c")), ("max", "q", 1, None))
    assert manchester.parse_class("p value \"1\"^^xsd:int")[2][1:] == ("1", "http://www.w3.org/2001/XMLSchema#int", "")
    assert manchester.parse_data_range("xsd:integer[>= 1, < 5]")[0] == "datatype"
    assert manchester.parse_literal('"text"@de') == ("text", "", "de") and manchester.parse_literal("1.0f")[1].endswith("float") and manchester.parse_literal("true")[1].endswith("boolean") and manchester.parse_literal("12")[1].endswith("integer")
    for bad in ("a and", "(a", "p some", "p min x c", "a b"):
        with pytest.raises(manchester.ManchesterError):
            manchester.parse_class(bad)
    a, rows = manchester.flatten(manchester.parse_class("c and p some d"))
    b, _ = manchester.flatten(manchester.parse_class("p some d and c"))
    assert a == b and len(rows) == 2
