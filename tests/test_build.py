import csv

import pytest

from axiomloom import cli
from axiomloom.ontology import Ontology
from axiomloom.plans import targets
from axiomloom.plans.config import Config, ConfigError, is_glob

CLASSES = '''ID,Type,Label,Parent,Text definition,Comments,Subclass of,Equivalent to,Disjoint with,Ignore
DEMO:0001,Class,animal,,,"first; ""second; same""",,,,
DEMO:0002,Class,dog,'animal',A {animal} that barks.,,,,,
DEMO:0003,Class,cat,'animal',,,,,'dog',
DEMO:0004,Class,puppy,,,,,'dog' and ('part of' some 'animal'),,
DEMO:0005,Class,ghost,,,,,,,yes
'''
PROPERTIES = "ID,Type,Label,Characteristics\nDEMO:0010,Object property,part of,\"Transitive, Irreflexive\"\n"
INDIVIDUALS = "ID,Type,Label,Instance of,Relations\nDEMO:0020,Individual,rex,'dog','part of' 'pack'\nDEMO:0021,Individual,pack,'animal',\n"


@pytest.fixture
def project(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["-q", "initialize", "demo.owl"], spark) == 0
    for kind, text in (("classes", CLASSES), ("properties", PROPERTIES), ("individuals", INDIVIDUALS)):
        (tmp_path / f"src/entities/demo_{kind}.csv").write_text(text)
    return tmp_path


def test_project(project, spark):
    assert cli.main(["-q", "make"], spark) == 0
    raw = Ontology(spark, str(project / "demo-raw.owl"))
    assert raw.existing("'dog'").definitions() == ["A 'animal' (DEMO:0001) that barks."]
    assert sorted(raw.existing("'animal'").comments()) == ["first", "second; same"] and raw.existing("DEMO:0005") is None
    made = (project / "demo-raw.owl").stat().st_mtime_ns
    assert cli.main(["-q", "make"], spark) == 0 and (project / "demo-raw.owl").stat().st_mtime_ns == made
    assert cli.main(["-q", "-r", "make", "ont"], spark) == 0
    full = Ontology(spark, str(project / "demo-reasoned.owl"))
    types = {(r["a1"][-4:], r["a2"][-4:]) for r in full.document.axioms.values() if r["axiom_type"] == "ClassAssertion"}
    assert types == {("0020", "0002"), ("0020", "0004"), ("0020", "0001"), ("0021", "0001")}
    (project / "terms.txt").write_text("dogs\nunknown\n")
    assert cli.main(["-q", "-s", "demo-raw.owl", "-i", "terms.txt", "-o", "out.csv", "fe"], spark) == 0
    rows = list(csv.reader(open(project / "out.csv")))
    assert rows[0] == list(targets.FindEntities.COLUMNS) and [r[:3] for r in rows[1:]] == [["dogs", "http://purl.obolibrary.org/obo/DEMO_0002", "dog"]]


def test_imports_and_release(project, spark, monkeypatch):
    source = project / "imports/source_ontologies"
    source.mkdir(parents=True)
    other = Ontology(spark)
    other.set_id("http://other.example/other.owl")
    for name, label in (("OTH:0001", "thing one"), ("OTH:0002", "thing two")):
        other.create("class", name).add_label(label)
    other.existing("OTH:0002").relate("superclass", "OTH:0001")
    other.save(str(source / "other.owl"))
    (project / "src/imports/imported_ontologies.csv").write_text("Name,IRI,Entities file,Ignore\nother,http://other.example/other.owl,other.csv,\n")
    (project / "src/imports/other.csv").write_text("ID,Method,Related entities,Exclude,Ignore\nOTH:0002,single,ancestors,,\n")
    (project / "src/entities/demo_more.csv").write_text("ID,Type,Label,Parent\nDEMO:0030,Class,own thing,'thing two'\n")
    assert cli.main(["-q", "-d", "2026-01-02", "make", "release"], spark) == 0
    out = project / "releases/2026-01-02"
    raw, main = Ontology(spark, str(out / "demo-raw.owl")), Ontology(spark, str(out / "demo.owl"))
    assert raw.document.imports[0].endswith("/releases/2026-01-02/imports/other_demo_import_module.owl") and not main.document.imports
    assert main.existing("OTH:0001") and main.existing("OTH:0002").values("http://purl.obolibrary.org/obo/IAO_0000412") == ["http://other.example/other.owl"]
    assert main.document.version.endswith("releases/2026-01-02/demo.owl")
    assert cli.main(["-q", "-d", "soon", "make", "release"], spark) == 1


def test_pipeline_and_errors(project, spark, capsys):
    cli.main(["-q", "make"], spark)
    assert cli.main(["-q", "-i", "demo-raw.owl", "-o", "inferred.owl", "inference_pipeline"], spark) == 0
    assert Ontology(spark, str(project / "inferred.owl")).existing("'rex'")
    assert cli.main(["-q", "error_check"], spark) == 0 and "consistent" in capsys.readouterr().out
    (project / "src/doc_specification.txt").write_text("# D\n\n## C\n- ID: \"'animal'\"\n  descendants: all\n")
    assert cli.main(["-q", "make", "documentation"], spark) == 0 and (project / "documentation/demo.html").exists()
    assert cli.main(["-q", "update_base"], spark) == 0
    for args in (["-q", "nonsense"], ["-q", "make", "x"], ["-q", "-c", "none.conf", "make"], ["-q", "fe"]):
        assert cli.main(args, spark) == 1
    (project / "src/entities/demo_bad.csv").write_text("ID,Type,Label\nDEMO:0001,Individual,animal\n")
    assert cli.main(["-q", "make"], spark) == 1


def test_config(project):
    c = Config("project.conf")
    assert c.reasoner == "hermit" and c.output_format == "RDF/XML" and c.annotate_merged and len(c.entity_files) == 3
    assert c.dev_iri("a/b.owl").endswith("/a/b.owl") and [is_glob(x) for x in ("a", "a*", "a[b", "a[b]")] == [False, True, False, True]
    (project / "bad.conf").write_text("[Reasoning]\nreasoner = none\ninferences = x\n[Ontology]\nentity_sourcefiles = gone.csv\n")
    bad = Config("bad.conf")
    for name in ("reasoner", "inferences", "ontology_file", "entity_files"):
        with pytest.raises(ConfigError):
            getattr(bad, name)


def test_targets():
    class Step(targets.Target):
        def __init__(self, name, due, *needs):
            super().__init__(*needs)
            self.name, self.due, self.runs = name, due, 0

        def own_stale(self):
            return self.due and not self.runs

        def make(self):
            self.runs += 1

        def products(self):
            return {self.name: self.name}

    a, b = Step("a", False), Step("b", True)
    top = Step("top", False, a, b)
    assert top.stale() and top.run() == {"a": "a", "b": "b", "top": "top"} and (a.runs, b.runs, top.runs) == (0, 1, 1)
    assert not top.stale()
    with pytest.raises(targets.BuildError):
        Step("x", True, Step("a", True), Step("a", True)).run()
