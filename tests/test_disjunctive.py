"""Subsumptions from unions, complements, universal and counting restrictions, against a plain tableau."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from tableau import Tableau  # noqa: E402

from axiomloom.operators.reason import Reasoner  # noqa: E402
from axiomloom.sources import owl  # noqa: E402

CLASSES, ROLES = 5, ("p", "q", "r")


def random_axioms(rng):
    """``(general inclusions, super-roles)`` over a few classes and roles."""
    pick = lambda items: items[rng.integers(len(items))]
    name = lambda: ("name", f"C{rng.integers(CLASSES)}")

    def concept(depth):
        op = pick(["name", "name", "not", "and", "or", "some", "some", "only", "only", "max", "min"]) if depth else "name"
        if op == "name":
            return name()
        if op == "not":
            return ("not", concept(depth - 1))
        if op in ("and", "or"):
            return (op, concept(depth - 1), concept(depth - 1))
        if op in ("some", "only"):
            return (op, pick(ROLES), concept(depth - 1))
        return (op, int(rng.integers(0, 3)) if op == "max" else int(rng.integers(1, 3)), pick(ROLES), pick([concept(0), concept(0), "top"]))

    gcis = [(concept(int(rng.integers(0, 2))), concept(2)) for _ in range(int(rng.integers(4, 8)))]
    return gcis, [(pick(ROLES), pick(ROLES)) for _ in range(int(rng.integers(0, 2)))]


def reflexive(roles):
    up = {r: {r} for r in ROLES}
    for _ in ROLES:
        for a, b in roles:
            for s in up.values():
                s |= {b} if a in s else set()
    return up


def key(doc, c, own):
    """The name or expression of a concept, its names prefixed by ``own``."""
    if c == "top":
        return owl.OWL + "Thing"
    if c[0] == "name":
        return own + c[1]
    if c[0] == "not":
        return doc.expression("not", filler=key(doc, c[1], own))
    if c[0] in ("and", "or"):
        return doc.expression(c[0], operands=sorted({key(doc, c[1], own), key(doc, c[2], own)}))
    if c[0] in ("some", "only"):
        return doc.expression(c[0], prop=own + c[1], filler=key(doc, c[2], own))
    return doc.expression(c[0], card=c[1], prop=own + c[2], filler=None if c[3] == "top" else key(doc, c[3], own))


def compare(spark, worlds):
    doc = owl.Document()
    for k, (gcis, roles) in enumerate(worlds):
        own = f"w{k}:"
        for c in range(CLASSES):
            doc.add("Declaration", f"{own}C{c}", "class")
        for a, b in gcis:
            doc.add("SubClassOf", key(doc, a, own), key(doc, b, own))
        for a, b in roles:
            if a != b:
                doc.add("SubObjectPropertyOf", own + a, own + b)
    r = Reasoner(*owl.frames(spark, doc))
    assert r.ignored().count() == 0
    got, empty = {tuple(x) for x in r.superclasses().collect()}, {x[0] for x in r.unsatisfiable().collect()}
    want, none, full = set(), set(), set()
    for k, (gcis, roles) in enumerate(worlds):
        t = Tableau(gcis, reflexive(roles))
        for a in range(CLASSES):
            if not t.satisfiable([("name", f"C{a}")]):
                none.add(f"w{k}:C{a}")
                continue
            want |= {(f"w{k}:C{a}", f"w{k}:C{b}") for b in range(CLASSES) if a != b and not t.satisfiable([("name", f"C{a}"), ("not", ("name", f"C{b}"))])}
        full |= {f"w{k}:C{b}" for b in range(CLASSES) if not t.satisfiable([("not", ("name", f"C{b}"))])}
    # a class that is everything is above those of the other ontologies too
    want |= {(f"w{k}:C{a}", f) for k in range(len(worlds)) for a in range(CLASSES) for f in full if f != f"w{k}:C{a}" and f"w{k}:C{a}" not in none}
    assert empty == none
    assert {p for p in got if p[0] not in empty} == want
    return len(want), len(none)


A, B, C, D, E = (("name", f"C{k}") for k in range(5))
NAMED = {
    "cases of a union": ([(A, ("or", B, C)), (B, D), (C, D)], []),
    "a union with one case left": ([(A, ("or", B, C)), (("and", A, B), "bottom"), (C, E)], []),
    "a value of an only": ([(A, ("and", ("some", "p", "top"), ("only", "p", B))), (("some", "p", B), C)], []),
    "an only of a superior property": ([(A, ("and", ("some", "p", B), ("only", "q", ("not", B))))], [("p", "q")]),
    "a complement of a restriction": ([(("not", ("some", "p", B)), C), (A, ("only", "p", ("not", B)))], []),
    "one value that is both": ([(A, ("and", ("some", "p", B), ("and", ("some", "p", C), ("max", 1, "p", "top")))), (("some", "p", ("and", B, C)), D)], []),
    "too many values": ([(A, ("and", ("min", 3, "p", B), ("max", 2, "p", "top")))], []),
    "a bound by kind": ([(A, ("and", ("min", 2, "p", B), ("max", 1, "p", ("and", B, C)))), (B, ("or", C, D)), (("some", "p", D), E)], []),
    "none at all": ([(A, ("max", 0, "p", B)), (("only", "p", ("not", B)), C)], []),
    "at least two by two kinds": ([(A, ("and", ("some", "p", B), ("some", "p", ("not", B)))), (("min", 2, "p", "top"), C)], []),
}


def tidy(worlds):
    """``bottom`` on a right side said with names that the mapping has."""
    return [([(a, ("and", A, ("not", A)) if b == "bottom" else b) for a, b in gcis], roles) for gcis, roles in worlds]


def test_named_cases(spark):
    found, none = compare(spark, tidy(NAMED.values()))
    assert found >= 7 and none >= 2


def telling(rng, n):
    """``n`` random ontologies of which the tableau has several subsumptions or an unsatisfiable class."""
    found = []
    while len(found) < n:
        world = random_axioms(rng)
        t = Tableau(world[0], reflexive(world[1]))
        names = [("name", f"C{c}") for c in range(CLASSES)]
        empty = [a for a in names if not t.satisfiable([a])]
        below = sum(not t.satisfiable([a, ("not", b)]) for a in names for b in names if a != b and a not in empty)
        if 2 <= below + len(empty) and len(empty) < 3:
            found.append(world)
    return found


@pytest.mark.parametrize("seed", [1])
def test_random_ontologies(spark, seed):
    found, none = compare(spark, telling(np.random.default_rng(seed), int(os.environ.get("WORLDS", "2"))))
    assert found + none >= 4
