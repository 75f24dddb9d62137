"""Components and property rules against plain versions."""

import numpy as np

from axiomloom.operators import components, rules
from axiomloom.operators.closure import direct, equivalent_pairs

EDGE, FACT = "src string, dst string", "subject string, prop string, object string"


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for n in out:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found[n] = seen
    return found


def test_strong_components(spark):
    rng = np.random.default_rng(3)
    edges = {(f"{g}:{a:02d}", f"{g}:{b:02d}") for g in range(6) for n in (4, 14) for a, b in rng.integers(0, n, (n + g, 2))} | {("x", "x"), ("y", "z")}
    got = {r.node: r.root for r in components.strong(spark.createDataFrame([*edges, (None, "x")], EDGE)).collect()}
    to = reach(edges)
    assert got == {n: min(m for m in to[n] if n in to.get(m, ())) for n in to if n in to[n]}
    pairs = {tuple(r) for r in equivalent_pairs(spark.createDataFrame(list(edges), EDGE)).collect()}
    assert pairs == {(a, b) for a in got for b in got if a != b and got[a] == got[b]}


def test_a_long_ring(spark):
    """Longer than colours are waited for, with a chain that leads to it and one that leaves it."""
    n = 600
    ring = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    chains = spark.range(n).selectExpr(f"id + {n} as src", f"id + {n + 1} as dst").union(spark.createDataFrame([(2 * n, 0), (5, 5 * n), (5 * n, 5 * n + 1)], "src long, dst long"))
    found = components.strong(ring.union(chains))
    assert found.count() == n and {r.root for r in found.select("root").distinct().collect()} == {0}


def test_direct_superiors_of_a_cycle(spark):
    """One stands for all on a cycle, and each for all in the result; closed edges give the same."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "e"), ("d", "e"), ("x", "a")]
    want = {(n, "d") for n in "abc"} | {("d", "e")} | {("x", n) for n in "abc"}
    assert {tuple(r) for r in direct(spark.createDataFrame(edges, EDGE)).collect()} == want
    closed = [(a, b) for a, bs in reach(edges).items() for b in bs if a != b]
    assert {tuple(r) for r in direct(spark.createDataFrame(closed, EDGE), closed=True).collect()} == want


def plain_facts(facts, roles, inverses, symmetric, chains):
    known = set(facts)
    while True:
        new = {(s, q, o) for s, p, o in known for a, q in roles if a == p}
        new |= {(o, q, s) for s, p, o in known for a, q in [*inverses, *((b, a) for a, b in inverses), *((p, p) for p in symmetric)] if a == p}
        for steps, sup in chains:
            ends = {(s, s) for s, _, _ in known}
            for step in steps:
                ends = {(a, o) for a, b in ends for s, p, o in known if p == step and s == b}
            new |= {(a, sup, b) for a, b in ends}
        if new <= known:
            return known
        known |= new


def test_property_rules(spark):
    """Chains of two and three steps that feed each other, a transitive property, inverses; then more is told."""
    rng = np.random.default_rng(4)
    facts = sorted({(f"i{a}", str(rng.choice(["p", "q", "r", "t"])), f"i{b}") for a, b in rng.integers(0, 14, (34, 2))})
    roles, inverses, symmetric = [("p", "above p"), ("u", "v")], [("q", "q back")], ["s"]
    chains = [(("p", "q"), "u"), (("v", "r", "q back"), "w"), (("w", "above p"), "s"), (("t", "t"), "t")]
    moved = rules.moves(spark.createDataFrame(roles, EDGE), spark.createDataFrame(inverses, "p string, q string"), spark.createDataFrame([(s,) for s in symmetric], "p string"), spark.createDataFrame([(p,) for p in ("p", "q", "r", "t", "w", "s")], "prop string"))
    made = rules.compositions(spark.createDataFrame([("t",)], "prop string"), spark.createDataFrame([(list(s), p) for s, p in chains[:3]], "steps array<string>, sup string"))
    held = rules.Facts(moved, made)
    held.add(spark.createDataFrame(facts[:25], FACT))
    got = held.add(spark.createDataFrame(facts[25:], FACT))
    rows = [tuple(r) for r in got.collect()]
    want = plain_facts(facts, roles, inverses, symmetric, chains)
    assert {r for r in rows if not r[1].startswith("chain:")} == want and len(rows) == len(set(rows))
    assert {p for _, p, _ in want} >= {"u", "v", "w", "s"}


def test_many_equal_individuals(spark):
    """Thousands of values of a functional property are one individual, at a row for each."""
    n = 5000
    told = spark.range(n).selectExpr("'club' as subject", "'has member' as prop", "'m' || id as object")
    none = spark.createDataFrame([], "a string, b string")
    moved = rules.moves(spark.createDataFrame([], EDGE), spark.createDataFrame([], "p string, q string"), spark.createDataFrame([], "p string"), spark.createDataFrame([("has member",)], "prop string"))
    empty = spark.createDataFrame([], "prop string")
    facts = rules.Facts(moved, rules.compositions(empty, spark.createDataFrame([], "steps array<string>, sup string")))
    known, roots = rules.settle(facts, told, none, spark.createDataFrame([("has member",)], "prop string"), empty)
    assert [tuple(r) for r in known.collect()] == [("club", "has member", "m0")]
    assert roots.count() == n - 1 and {r.root for r in roots.collect()} == {"m0"}
    assert rules.spread(known, "object", roots).count() == n
