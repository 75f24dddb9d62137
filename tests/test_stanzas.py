"""OBO and functional-syntax documents give the rows that the same ontology in Turtle gives, however they are split."""

import pytest

from axiomloom.sources import owl, rdf
from axiomloom.sources.stanzas import parse_functional, read_functional, read_obo

OBO = """format-version: 1.2
ontology: zoo

[Term]
id: ZOO:1
name: animal ! living
def: "A \\"living\\" thing\\nthat moves." [ZOO:ref]
synonym: "beast" EXACT []
synonym: "creature" []
relationship: eats ZOO:3 {source="x"} ! food

[Term]
id: ZOO:2
name: herbivore
is_a: ZOO:1 ! animal
intersection_of: ZOO:1
intersection_of: eats ZOO:3 ! plant
disjoint_from: ZOO:4

[Term]
id: ZOO:3
name: plant
is_obsolete: true

[Term]
id: ZOO:4
name: either
union_of: ZOO:1
union_of: ZOO:3

[Typedef]
id: eats
name: eats
domain: ZOO:1
is_transitive: true
holds_over_chain: eats part_of
inverse_of: eaten_by

[Typedef]
id: eaten_by
is_a: touches

[Instance]
id: ZOO:8
instance_of: ZOO:2
relationship: eats ZOO:9
"""
ZOO, LOCAL = "http://purl.obolibrary.org/obo/ZOO_", "http://purl.obolibrary.org/obo/zoo#"
PREFIXES = "@prefix z: <http://purl.obolibrary.org/obo/ZOO_> . @prefix l: <http://purl.obolibrary.org/obo/zoo#> . @prefix obo: <http://purl.obolibrary.org/obo/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix oio: <http://www.geneontology.org/formats/oboInOwl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
TURTLE = PREFIXES + """obo:zoo.owl a owl:Ontology . obo:IAO_0000115 a owl:AnnotationProperty . oio:hasExactSynonym a owl:AnnotationProperty . oio:hasRelatedSynonym a owl:AnnotationProperty . owl:deprecated a owl:AnnotationProperty .
z:1 a owl:Class ; rdfs:label "animal"^^xsd:string ; obo:IAO_0000115 "A \\"living\\" thing\\nthat moves."^^xsd:string ; oio:hasExactSynonym "beast"^^xsd:string ; oio:hasRelatedSynonym "creature"^^xsd:string ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty l:eats ; owl:someValuesFrom z:3 ] .
z:2 a owl:Class ; rdfs:label "herbivore"^^xsd:string ; rdfs:subClassOf z:1 ; owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( z:1 [ a owl:Restriction ; owl:onProperty l:eats ; owl:someValuesFrom z:3 ] ) ] ; owl:disjointWith z:4 .
z:3 a owl:Class ; rdfs:label "plant"^^xsd:string ; owl:deprecated "true"^^xsd:boolean .
z:4 a owl:Class ; rdfs:label "either"^^xsd:string ; owl:equivalentClass [ a owl:Class ; owl:unionOf ( z:1 z:3 ) ] .
l:eats a owl:ObjectProperty , owl:TransitiveProperty ; rdfs:label "eats"^^xsd:string ; rdfs:domain z:1 ; owl:propertyChainAxiom ( l:eats l:part_of ) ; owl:inverseOf l:eaten_by .
l:eaten_by a owl:ObjectProperty ; rdfs:subPropertyOf l:touches . z:8 a owl:NamedIndividual , z:2 ; l:eats z:9 .
"""
FUNCTIONAL = """Prefix(:=<http://x/>)
Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>)
Ontology(<http://x/o>

Declaration(Class(:A))
Declaration(Class(:B))
Declaration(ObjectProperty(:p))
Declaration(DataProperty(:d))
Declaration(NamedIndividual(:i))
# a remark
SubClassOf(:A ObjectIntersectionOf(:B ObjectSomeValuesFrom(:p ObjectComplementOf(:A))))
EquivalentClasses(:B ObjectMaxCardinality(2 :p :A))
SubClassOf(:B ObjectAllValuesFrom(ObjectInverseOf(:p) ObjectOneOf(:i)))
SubClassOf(:B DataHasValue(:d "v (1)"^^xsd:string))
SubObjectPropertyOf(ObjectPropertyChain(:p :q) :p)
TransitiveObjectProperty(:p)
ObjectPropertyRange(:p :B)
HasKey(:A (:p) (:d))
ClassAssertion(:A :i)
ObjectPropertyAssertion(:p :i :j)
NegativeObjectPropertyAssertion(:p :i :k)
DataPropertyAssertion(:d :i "say \\"so\\""@en)
DifferentIndividuals(:i :j :k)
AnnotationAssertion(<http://www.w3.org/2000/01/rdf-schema#label> :A "a (label"@en)
)
"""
FUNCTIONAL_TURTLE = """@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:o a owl:Ontology . :A a owl:Class ; rdfs:label "a (label"@en ; rdfs:subClassOf [ a owl:Class ; owl:intersectionOf ( :B [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom [ a owl:Class ; owl:complementOf :A ] ] ) ] ; owl:hasKey ( :p :d ) .
:B a owl:Class ; owl:equivalentClass [ a owl:Restriction ; owl:onProperty :p ; owl:maxQualifiedCardinality "2"^^xsd:nonNegativeInteger ; owl:onClass :A ] ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty [ owl:inverseOf :p ] ; owl:allValuesFrom [ a owl:Class ; owl:oneOf ( :i ) ] ] , [ a owl:Restriction ; owl:onProperty :d ; owl:hasValue "v (1)"^^xsd:string ] .
:p a owl:ObjectProperty , owl:TransitiveProperty ; owl:propertyChainAxiom ( :p :q ) ; rdfs:range :B . :d a owl:DatatypeProperty .
:i a owl:NamedIndividual , :A ; :p :j ; :d "say \\"so\\""@en . [] a owl:NegativePropertyAssertion ; owl:sourceIndividual :i ; owl:assertionProperty :p ; owl:targetIndividual :k .
[] a owl:AllDifferent ; owl:distinctMembers ( :i :j :k ) .
"""


def same_rows(got, turtle, without=()):
    doc = owl.from_triples(*rdf.parse_turtle(turtle))
    axioms, expressions = got
    want = {k: r for k, r in doc.axioms.items() if not (r["axiom_type"] == "Declaration" and r["a2"] in without)}
    rows = {r.axiom_id: r.asDict() for r in axioms.collect()}
    assert sorted(map(str, (r for k, r in rows.items() if k not in want))) == sorted(map(str, (r for k, r in want.items() if k not in rows)))
    assert {r.expr_id: r.asDict() for r in expressions.collect()} == doc.expressions


@pytest.fixture
def splits(spark):
    """Splits of a few hundred bytes, so that records lie across their borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "150b")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_obo(spark, tmp_path, splits):
    (tmp_path / "zoo.obo").write_text(OBO)
    assert spark.read.option("lineSep", "\n[").text(str(tmp_path)).rdd.getNumPartitions() > 4
    same_rows(read_obo(spark, str(tmp_path)), TURTLE, without=("aprop",))


def test_functional(spark, tmp_path, splits):
    (tmp_path / "x.ofn").write_text(FUNCTIONAL)
    same_rows(read_functional(spark, str(tmp_path)), FUNCTIONAL_TURTLE)


def test_functional_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="isn't closed"):
        parse_functional("SubClassOf(:A :B")
    (tmp_path / "x.ofn").write_text("Ontology(<http://x/o>\nSubClassOf(a:A a:B)\n)\n")
    with pytest.raises(Exception, match="No prefix for a:A"):
        read_functional(spark, str(tmp_path))
