"""Ontologies from term tables, import modules from tables of seeds."""

from __future__ import annotations

import re
import unicodedata

from ..functions.delimited import parse, unquote
from ..ontology import Entity, Ontology, OntologyError
from ..operators.compile import CHARACTERISTICS, TYPES
from ..operators.relations import parse_relations
from ..schema import CLASS, DATA_PROPERTY, INDIVIDUAL, OBJECT_PROPERTY, OBO_BASE
from ..sources.tables import Row, TableError, read_tables
from .config import TRUE

#: What a column says of the row's entity.
COLUMNS = {
    "parent": {CLASS: "superclass", None: "superproperty"}, "subclass of": {CLASS: "superclass"}, "superclass of": {CLASS: "subclass"}, "equivalent to": {CLASS: "equivalent", None: "equivalent"},
    "disjoint with": {CLASS: "disjoint", OBJECT_PROPERTY: "disjoint", DATA_PROPERTY: "disjoint"}, "subproperty of": {None: "superproperty"}, "superproperty of": {None: "subproperty"},
    "domain": {OBJECT_PROPERTY: "domain", DATA_PROPERTY: "domain"}, "range": {OBJECT_PROPERTY: "range", DATA_PROPERTY: "range"}, "inverse": {OBJECT_PROPERTY: "inverse"}, "instance of": {INDIVIDUAL: "type"},
}
_MARK = re.compile(r"\{([^{}]+)\}")


class EntityError(TableError):
    """A row that describes an entity wrongly."""


class Builder:
    """Takes in rows: first every entity and its label, then what they say, so that rows may name later ones."""

    def __init__(self, ontology: Ontology):
        self.ontology = ontology
        self.waiting: list[tuple[Entity, Row, bool]] = []

    def add(self, row: Row, expand: bool = True) -> None:
        kind = TYPES.get(row["Type"].lower().replace(" ", ""))
        if kind is None:
            raise EntityError(f"The entity type {row['Type']!r} is not supported, in {row.place()}.")
        try:
            name = row["ID"]
            iri = self.ontology.resolve_id(name)
            entity = self.ontology.existing(iri)
            if entity is None:
                entity = self.ontology.create(kind, iri)
            elif entity.kind != kind:
                raise OntologyError(f"The entity {name} is already defined as another type of entity.")
            label = row["Label"].strip("'")
            known = entity.labels()
            if label and known and label not in known:
                raise OntologyError(f"The entity {name} already has the label {known[0]!r}, which differs from {label!r}.")
            if label and not known:
                entity.add_label(row["Label"])
        except OntologyError as e:
            raise EntityError(f"{e} ({row.place()})") from e
        self.waiting.append((entity, row, expand))

    def finish(self) -> None:
        """The second pass over all rows taken in."""
        while self.waiting:
            entity, row, expand = self.waiting.pop(0)
            try:
                self._describe(entity, row, expand)
            except (OntologyError, ValueError) as e:
                raise EntityError(f"{e} ({row.place()})") from e

    def _describe(self, e: Entity, row: Row, expand: bool) -> None:
        if text := row["Text definition"]:
            e.add_definition(self.expand(text) if expand else text)
        for text in parse(row["Comments"]):
            e.add_comment(unquote(text))
        for pair in parse(row["Annotations"]):
            parts = parse(pair, " \t\n", "'\"")
            if len(parts) != 2:
                raise EntityError(f"Invalid annotation: {pair}")
            e.annotate(parts[0], unquote(parts[1], "'\""))
        for column in row:
            if column.startswith("@"):
                for text in parse(row[column]):
                    e.annotate(column[1:].strip(), unquote(text))
        for column, meaning in COLUMNS.items():
            relation = meaning.get(e.kind) or (meaning.get(None) if e.kind not in (CLASS, INDIVIDUAL) else None)
            if relation:
                for text in parse(row[column]):
                    e.relate(relation, text)
        for item in unicodedata.normalize("NFKC", row["Characteristics"]).lower().split(","):
            item = " ".join(item.split())
            if not item:
                continue
            if item not in CHARACTERISTICS or e.kind not in (OBJECT_PROPERTY, DATA_PROPERTY):
                raise EntityError(f"Unrecognized property characteristic: {item!r}.")
            e.make(CHARACTERISTICS[item].removesuffix("ObjectProperty"))
        if e.kind == INDIVIDUAL:
            for fact in parse(row["Relations"]) + parse(row["Data facts"]):
                parts = parse(fact, " \t\n", "'\"")
                negative = len(parts) == 3 and parts[0].lower() == "not"
                if len(parts) != 2 + negative:
                    raise EntityError(f"Invalid property assertion: {fact}")
                e.add_fact(*parts[-2:], negative=negative)

    def expand(self, text: str) -> str:
        """A definition with its ``{label}`` marks replaced by label and identifier."""

        def one(m: re.Match) -> str:
            quiet, inner = m[1].strip().startswith("$"), m[1].strip().lstrip("$").strip()
            prefix, colon, label = inner.partition(":") if re.match(r"[A-Za-z_][\w.-]*:", inner) else ("", "", inner)
            label = f"{prefix}{colon}'{label.strip().strip(chr(39))}'"
            iri = self.ontology.resolve(label)
            local = iri.removeprefix(OBO_BASE)
            obo = re.fullmatch(r"([A-Za-z]+(?:_[A-Za-z]+)?)_([0-9]+)", local) if iri.startswith(OBO_BASE) else None
            space = max(((ns, p) for p, ns in self.ontology.document.prefixes.items() if ns and p and iri.startswith(ns)), key=lambda x: len(x[0]), default=None)
            name = f"{obo[1]}:{obo[2]}" if obo else f"{space[1]}:{iri[len(space[0]) :]}" if space else iri
            return f"({name})" if quiet else f"{label} ({name})"

        return _MARK.sub(one, text)


def ignored(row: Row) -> bool:
    return row["Ignore"].strip().lower() in TRUE


def compile_tables(ontology: Ontology, paths: list[str], expand: bool = True) -> None:
    """Adds what the tables of ``paths`` describe to ``ontology``."""
    builder = Builder(ontology)
    for path in paths:
        for t in read_tables(path):
            for row in t.need("Type", "ID"):
                if not ignored(row):
                    builder.add(row, expand)
    builder.finish()


def build_module(source: Ontology, terms_path: str, module_iri: str) -> Ontology:
    """The import module of ``source`` that a table of seeds asks for."""
    include, exclude = [], []
    for t in read_tables(terms_path):
        for row in t.need("ID"):
            if ignored(row):
                continue
            how = (row["Method"] or "locality").strip().lower()
            if how not in ("single", "locality"):
                raise EntityError(f"Unrecognized extraction method {how!r} in {row.place()}.")
            rels = parse_relations(row["Related entities"])
            name = row["ID"]
            if source.existing(name) is None:
                raise EntityError(f"The entity {name} could not be found in the source ontology ({row.place()}).")
            if row["Exclude"].strip().lower() in TRUE:
                exclude.append((name, rels))
            else:
                include.append((name, how, rels))
    return source.extract(module_iri, include, exclude)


def excluded_rows(path: str) -> list[tuple[str, bool, bool]]:
    """``(id, the class itself, its superclasses)`` of a table of types that aren't wanted."""
    out = []
    for t in read_tables(path):
        for row in t.need("ID", "Exclude superclasses"):
            if not ignored(row):
                out.append((row["ID"], row["Exclude class"].strip().lower() in TRUE, row["Exclude superclasses"].strip().lower() in TRUE))
    return out
