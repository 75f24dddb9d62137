"""Locality modules of one document, row by row: what the joins of the library are held against.

An axiom is local for a signature if it says nothing about it once all other names are
empty (bottom) or everything (top). A module is what is left after taking in, until
nothing changes, each axiom that isn't local and its names; STAR alternates both kinds.
"""

from __future__ import annotations

_NOTHING, _THING = "http://www.w3.org/2002/07/owl#Nothing", "http://www.w3.org/2002/07/owl#Thing"
_KEPT = ("Declaration", "AnnotationAssertion")


def names_of(row: dict, expressions: dict[str, dict]) -> set[str]:
    """The entities that an axiom names."""
    out, todo = set(), [x for x in (row["a1"], row["a2"], *([] if row["axiom_type"] in ("DataPropertyAssertion", "AnnotationAssertion") else [row["a3"]]), *(row["operands"] or [])) if x]
    while todo:
        x = todo.pop()
        e = expressions.get(x)
        if e is None:
            out.add(x.removeprefix("inverse(").removesuffix(")"))
        elif e["op"] not in ("literal", "datatype"):
            todo += [y for y in (e["iri"], e["prop"], e["filler"], *(e["operands"] or [])) if y]
    return out - {_THING, _NOTHING}


class _Locality:
    def __init__(self, expressions: dict[str, dict], signature: set[str], top: bool):
        self.x, self.s, self.top = expressions, signature, top
        self.memo: dict[tuple[str, bool], bool] = {}

    def role_out(self, prop: str) -> bool:
        return prop.removeprefix("inverse(").removesuffix(")") not in self.s

    def empty(self, c: str) -> bool:
        return self._known(c, True)

    def full(self, c: str) -> bool:
        return self._known(c, False)

    def _known(self, c: str, empty: bool) -> bool:
        if (c, empty) not in self.memo:
            self.memo[c, empty] = False
            self.memo[c, empty] = self._empty(c) if empty else self._full(c)
        return self.memo[c, empty]

    def _empty(self, c: str) -> bool:
        e = self.x.get(c)
        if e is None:
            return c == _NOTHING or (not self.top and c != _THING and c not in self.s)
        op = e["op"]
        if op == "not":
            return self.full(e["filler"])
        if op in ("and", "or"):
            return (any if op == "and" else all)(map(self.empty, e["operands"]))
        if op in ("some", "value", "self") or op in ("min", "exactly") and e["card"] > 0:
            return not self.top and self.role_out(e["prop"]) or op != "value" and bool(e["filler"]) and self.empty(e["filler"])
        if op in ("only", "max") and self.top and self.role_out(e["prop"]):
            return op == "only" and self.empty(e["filler"]) or op == "max" and (not e["filler"] or self.full(e["filler"]))
        return False

    def _full(self, c: str) -> bool:
        e = self.x.get(c)
        if e is None:
            return c == _THING or (self.top and c != _NOTHING and c not in self.s)
        op = e["op"]
        if op == "not":
            return self.empty(e["filler"])
        if op in ("and", "or"):
            return (all if op == "and" else any)(map(self.full, e["operands"]))
        if op == "only":
            return not self.top and self.role_out(e["prop"]) or self.full(e["filler"])
        if op == "max":
            return not self.top and self.role_out(e["prop"]) or bool(e["filler"]) and self.empty(e["filler"])
        if op in ("some", "min") and self.top and self.role_out(e["prop"]):
            return (e["card"] or 1) <= 1 and (not e["filler"] or self.full(e["filler"]))
        return op in ("value", "self") and self.top and self.role_out(e["prop"]) or op == "min" and e["card"] == 0

    def local(self, row: dict) -> bool:
        """Whether an axiom says nothing about the signature."""
        kind, a1, a2 = row["axiom_type"], row["a1"], row["a2"]
        if kind == "SubClassOf":
            return self.empty(a1) or self.full(a2)
        if kind == "EquivalentClasses":
            return all(map(self.empty, row["operands"])) or all(map(self.full, row["operands"]))
        if kind == "DisjointClasses":
            return sum(not self.empty(x) for x in row["operands"]) <= 1
        if kind in ("SubObjectPropertyOf", "SubDataPropertyOf"):
            return self.role_out(a2 if self.top else a1)
        if kind in ("EquivalentObjectProperties", "EquivalentDataProperties"):
            return all(map(self.role_out, row["operands"]))
        if kind in ("DisjointObjectProperties", "DisjointDataProperties"):
            return not self.top and sum(not self.role_out(x) for x in row["operands"]) <= 1
        if kind == "SubPropertyChainOf":
            return self.role_out(a1) if self.top else any(map(self.role_out, row["operands"]))
        if kind == "HasKey":
            return not self.top and self.empty(a1)
        if kind == "InverseObjectProperties":
            return self.role_out(a1) and self.role_out(a2)
        if kind.endswith(("PropertyDomain", "PropertyRange")) and kind[0] in "OD":
            return self.full(a2) or not self.top and self.role_out(a1)
        if kind == "ClassAssertion":
            return self.full(a2)
        if kind in ("ObjectPropertyAssertion", "DataPropertyAssertion"):
            return self.role_out(a2) and (self.top != bool(row["negative"]))
        if kind.endswith(("ObjectProperty", "DataProperty")):
            if kind.startswith("Reflexive"):
                return self.top and self.role_out(a1)
            return self.role_out(a1) and (not self.top or kind.startswith(("Symmetric", "Transitive")))
        return True


def _extract(rows: list[dict], expressions, seeds: set[str], names: dict[str, set[str]], top: bool) -> list[dict]:
    """The rows that aren't local, with a signature that grows by what they name."""
    signature, taken = set(seeds), set()
    while True:
        test = _Locality(expressions, signature, top)
        new = [r for r in rows if r["axiom_id"] not in taken and not test.local(r)]
        if not new:
            return [r for r in rows if r["axiom_id"] in taken]
        for r in new:
            taken.add(r["axiom_id"])
            signature |= names[r["axiom_id"]]


def star_module(rows: list[dict], expressions: dict[str, dict], seeds: set[str]) -> set[str]:
    """The ids of the axioms in the STAR module of ``seeds``: with declarations and annotations of all that it names. No seeds, no module."""
    if not seeds:
        return set()
    logical = [r for r in rows if r["axiom_type"] not in _KEPT and not r["axiom_type"].startswith(("SubAnnotation", "AnnotationProperty"))]
    names = {r["axiom_id"]: names_of(r, expressions) for r in logical}
    size = -1
    while size != len(logical):
        size = len(logical)
        for top in (False, True):
            logical = _extract(logical, expressions, seeds, names, top)
    signature = set(seeds).union(*(names[r["axiom_id"]] for r in logical))
    return {r["axiom_id"] for r in logical} | {r["axiom_id"] for r in rows if r["axiom_type"] in _KEPT and r["a1"] in signature}
