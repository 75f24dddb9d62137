"""Distributed locality modules against the plain ones, over random axioms and nested expressions."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import plain_locality  # noqa: E402

from axiomloom.operators import locality  # noqa: E402
from axiomloom.schema import AXIOM, EXPRESSION  # noqa: E402
from axiomloom.sources import owl  # noqa: E402

THING, NOTHING = "http://www.w3.org/2002/07/owl#Thing", "http://www.w3.org/2002/07/owl#Nothing"


def world(seed):
    rng = np.random.default_rng(seed)
    doc = owl.Document()
    pick = lambda items: items[rng.integers(len(items))]
    classes, props, inds = [f"C{i}" for i in range(14)], [f"r{i}" for i in range(4)], [f"i{i}" for i in range(4)]
    keys: list[str] = []

    def some_class():
        return pick([pick(classes), pick(classes), THING, NOTHING, *(keys[:3] or classes)])

    for _ in range(14):
        op = pick(["and", "or", "not", "some", "only", "min", "max", "exactly", "value", "self", "oneof"])
        prop = pick([pick(props), f"inverse({pick(props)})"])
        if op in ("and", "or"):
            keys.append(doc.expression(op, operands=sorted({some_class(), some_class()})))
        elif op == "not":
            keys.append(doc.expression(op, filler=some_class()))
        elif op == "oneof":
            keys.append(doc.expression(op, operands=[pick(inds)]))
        elif op in ("some", "only"):
            keys.append(doc.expression(op, prop=prop, filler=some_class()))
        elif op == "value":
            keys.append(doc.expression(op, prop=prop, filler=pick(inds)))
        elif op == "self":
            keys.append(doc.expression(op, prop=prop))
        else:
            keys.append(doc.expression(op, prop=prop, card=int(rng.integers(0, 3)), filler=pick([None, some_class()])))
    cls = lambda: pick([*classes, *keys])
    for c in classes:
        doc.add("Declaration", c, "class")
        doc.add("AnnotationAssertion", c, "label", f"label of {c}")
    for _ in range(22):
        kind = pick(["SubClassOf"] * 5 + ["EquivalentClasses", "DisjointClasses", "SubObjectPropertyOf", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties", "ObjectPropertyDomain", "ObjectPropertyRange", "ClassAssertion", "ObjectPropertyAssertion", "SymmetricObjectProperty", "FunctionalObjectProperty", "ReflexiveObjectProperty", "SubPropertyChainOf", "HasKey"])
        if kind in ("EquivalentClasses", "DisjointClasses"):
            doc.add(kind, operands=[cls(), cls(), cls()])
        elif kind.startswith(("EquivalentO", "DisjointO")):
            doc.add(kind, operands=[pick(props), pick(props)])
        elif kind == "SubClassOf":
            doc.add(kind, cls(), cls())
        elif kind in ("SubObjectPropertyOf", "InverseObjectProperties"):
            doc.add(kind, pick(props), pick(props))
        elif kind.startswith("ObjectPropertyA"):
            doc.add(kind, pick(inds), pick(props), pick(inds), negative=bool(rng.integers(2)))
        elif kind.startswith("ObjectProperty"):
            doc.add(kind, pick(props), cls())
        elif kind == "ClassAssertion":
            doc.add(kind, pick(inds), cls())
        elif kind in ("SubPropertyChainOf", "HasKey"):
            doc.add(kind, pick(props) if kind[0] == "S" else cls(), operands=[pick(props), pick(props)])
        else:
            doc.add(kind, pick(props))
    return doc, [pick(classes), pick([*classes, *props])]


@pytest.mark.parametrize("seed", [1])
def test_star(spark, seed):
    doc, seeds = world(seed)
    axioms, expressions = owl.frames(spark, doc)
    got = {r.axiom_id for r in locality.star_module(axioms, expressions, spark.createDataFrame([(s,) for s in seeds], "iri string")).select("axiom_id").collect()}
    rows, known = [dict(r) for r in doc.axioms.values()], doc.expressions
    assert got == plain_locality.star_module(rows, known, set(seeds))


def test_star_empty(spark):
    none = spark.createDataFrame([], AXIOM), spark.createDataFrame([], EXPRESSION)
    assert locality.star_module(*none, spark.createDataFrame([("a",)], "iri string")).count() == 0
    axioms, expressions = owl.frames(spark, world(1)[0])
    assert locality.star_module(axioms, expressions, spark.createDataFrame([], "iri string")).count() == 0
