"""Build targets: what depends on what, what is out of date, and how each product is made."""

from __future__ import annotations

import csv
import datetime
import os
import shutil
import sys
import urllib.request
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..ontology import Catalog, Ontology
from ..operators import documents, reason, search
from ..schema import DEFINITION
from ..sources.tables import read_tables
from . import builder
from .config import Config, ConfigError


class BuildError(RuntimeError):
    """A build that can't go on."""


class Target:
    """A step with steps before it. It runs if it is out of date or one of those ran."""

    def __init__(self, *needs: Target):
        self.needs = list(needs)

    def stale(self) -> bool:
        return any(t.stale() for t in self.needs) or self.own_stale()

    def own_stale(self) -> bool:
        return True

    def run(self, force: bool = False) -> dict[str, str]:
        """Runs what is out of date, and returns the products by name; two of one name are an error."""
        products: dict[str, str] = {}
        ran = False
        for t in self.needs:
            due = force or t.stale()
            ran |= due
            made = t.run(force) if due else t.products()
            if twice := set(made) & set(products):
                raise BuildError(f"Two build targets make the same product: {', '.join(sorted(twice))}.")
            products |= made
        if force or ran or self.own_stale():
            self.make()
        return products | self.products()

    def make(self) -> None:
        raise NotImplementedError

    def products(self) -> dict[str, str]:
        return {}


def newer(product: str, *sources: str) -> bool:
    """Whether ``product`` is there and not older than any source that is there."""
    if not os.path.isfile(product):
        return False
    made = os.path.getmtime(product)
    return all(os.path.getmtime(s) <= made for s in sources if s and os.path.exists(s))


def _folder(path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)


class Imports(Target):
    """Import modules, one for each source ontology that a table lists."""

    def __init__(self, spark: SparkSession, config: Config):
        super().__init__()
        self.spark, self.config = spark, config
        self.rows: list[tuple[str, str, str]] = []
        if config.imports_file:
            if not os.path.isfile(config.imports_file):
                raise ConfigError(f"The imports file could not be found: {config.imports_file}.")
            for t in read_tables(config.imports_file):
                for row in t.need("IRI", "Entities file"):
                    if not builder.ignored(row):
                        terms = row["Entities file"]
                        terms = terms if not terms or os.path.isabs(terms) else os.path.join(os.path.dirname(config.imports_file), terms)
                        if terms and not os.path.isfile(terms):
                            raise ConfigError(f"The terms file {terms} could not be found ({row.place()}).")
                        self.rows.append((row["Name"], row["IRI"], terms))

    def module_path(self, iri: str) -> str:
        stem = os.path.splitext(os.path.basename(iri.rstrip("/")))[0]
        return os.path.join(self.config.imports_folder, stem + self.config.import_suffix)

    def info(self) -> list[tuple[str, str]]:
        """``(path, IRI)`` of each import: of its module, or of the ontology itself if no terms are listed (no path)."""
        return [(self.module_path(i), self.config.dev_iri(self.module_path(i))) if terms else ("", i) for _, i, terms in self.rows]

    def own_stale(self) -> bool:
        return any(terms and not newer(self.module_path(i), terms, self.config.imports_file) for _, i, terms in self.rows)

    def source(self, iri: str) -> str:
        """The local copy of a source ontology; fetched on first use."""
        folder = os.path.join(self.config.imports_folder, "source_ontologies")
        path = os.path.join(folder, os.path.basename(iri.rstrip("/")) or "ontology.owl")
        if not os.path.isfile(path):
            _folder(path)
            try:
                with urllib.request.urlopen(iri, timeout=60) as r, open(path, "wb") as f:  # noqa: S310
                    shutil.copyfileobj(r, f)
            except (OSError, ValueError) as e:
                raise BuildError(f"The ontology <{iri}> could not be fetched: {e}") from e
        return path

    def make(self) -> None:
        for _, iri, terms in self.rows:
            path = self.module_path(iri)
            if terms and not newer(path, terms, self.config.imports_file):
                module = builder.build_module(Ontology(self.spark, self.source(iri)), terms, self.config.dev_iri(path))
                _folder(path)
                module.save(path, self.config.output_format)

    def products(self) -> dict[str, str]:
        return {f"import module {iri}": path for path, iri in self.info() if path}

    def catalog(self) -> Catalog:
        c = Catalog()
        for path, iri in self.info():
            if path:
                c.add(iri, path)
        return c


class Compiled(Target):
    """The ontology as its tables describe it, with its imports."""

    def __init__(self, spark: SparkSession, config: Config):
        self.imports = Imports(spark, config)
        super().__init__(self.imports)
        self.spark, self.config = spark, config

    @property
    def path(self) -> str:
        name = os.path.basename(self.config.ontology_file)
        stem, ext = os.path.splitext(name)
        return os.path.join(os.path.dirname(self.config.ontology_file) if self.config.in_source else self.config.build_folder, f"{stem}-raw{ext}")

    def own_stale(self) -> bool:
        return not newer(self.path, self.config.path, self.config.base_ontology, self.config.imports_file, *self.config.entity_files)

    def make(self) -> None:
        base = self.config.base_ontology
        o = Ontology(self.spark, base if os.path.isfile(base) else None, self.imports.catalog())
        o.set_id(self.config.dev_iri(self.path))
        for _, iri in self.imports.info():
            o.add_import(iri)
        builder.compile_tables(o, self.config.entity_files, self.config.expand_definitions)
        _folder(self.path)
        o.save(self.path, self.config.output_format)

    def products(self) -> dict[str, str]:
        return {"ontology": self.path}

    def load(self) -> Ontology:
        return Ontology(self.spark, self.path, self.imports.catalog())


class Modified(Target):
    """The compiled ontology with imports merged in, inferences added, or both."""

    def __init__(self, spark: SparkSession, config: Config, merge: bool, infer: bool):
        self.compiled = Compiled(spark, config)
        super().__init__(self.compiled)
        self.spark, self.config, self.merge, self.infer = spark, config, merge, infer

    @property
    def path(self) -> str:
        stem, ext = os.path.splitext(self.compiled.path)
        return stem.removesuffix("-raw") + "-merged" * self.merge + "-reasoned" * self.infer + ext

    def own_stale(self) -> bool:
        return not newer(self.path, self.compiled.path)

    def make(self) -> None:
        o = self.compiled.load()
        if self.merge:
            for path, _ in self.compiled.imports.info():
                if path:
                    o.merge(Ontology(self.spark, path), self.config.annotate_merged)
        if self.infer:
            infer(o, self.config)
        o.set_id(self.config.dev_iri(self.path))
        o.save(self.path, self.config.output_format)

    def products(self) -> dict[str, str]:
        return {"merged" * self.merge + "reasoned" * self.infer + " ontology": self.path}


def infer(o: Ontology, config: Config) -> int:
    """Adds inferences as the configuration asks; inference types that the reasoner lacks are passed over with a warning."""
    can, cannot = reason.supported(config.reasoner, config.inferences)
    for kind in cannot:
        print(f"The inference type {kind!r} is not supported by {config.reasoner}.", file=sys.stderr)
    excluded = o.excluded_types(builder.excluded_rows(config.excluded_types_file)) if config.excluded_types_file else None
    return o.infer(can, config.annotate_inferred, config.preprocess_inverses, excluded)


class Release(Target):
    """Raw, merged and main ontology and the import modules under release IRIs, with the date as version."""

    def __init__(self, spark: SparkSession, config: Config, date: str = ""):
        self.merged, self.full = Modified(spark, config, True, False), Modified(spark, config, True, True)
        super().__init__()
        self.spark, self.config = spark, config
        try:
            day = datetime.date.fromisoformat(date) if date else datetime.date.today()
        except ValueError as e:
            raise BuildError(f"The release date must be in the format YYYY-MM-DD: {date}.") from e
        self.folder = os.path.join(config.folder, "releases", day.isoformat())

    def _files(self) -> list[tuple[str, str, str, bool]]:
        stem, ext = os.path.splitext(os.path.basename(self.config.ontology_file))
        return [(self.merged.compiled.path, f"{stem}-raw{ext}", "", False), (self.merged.path, f"{stem}-merged{ext}", "", False), (self.full.path, stem + ext, "", True)]

    def own_stale(self) -> bool:
        return self.merged.stale() or self.full.stale() or any(not os.path.isfile(os.path.join(self.folder, n)) for _, n, _, _ in self._files())

    def make(self) -> None:
        for t in (self.merged, self.full):
            if t.stale():
                t.run()
        os.makedirs(os.path.join(self.folder, "imports"), exist_ok=True)
        changed = []
        for path, iri in self.merged.compiled.imports.info():
            if path:
                to = os.path.join(self.folder, "imports", os.path.basename(path))
                o = Ontology(self.spark, path)
                o.set_id(self.config.release_iri(os.path.join("imports", os.path.basename(path))), self.config.release_iri(to))
                o.save(to, self.config.output_format)
                changed.append((iri, o.document.version))
        for source, name, _, main in self._files():
            to = os.path.join(self.folder, name)
            o = Ontology(self.spark, source)
            o.set_id(self.config.release_ontology_iri if main else self.config.release_iri(name), self.config.release_iri(to))
            for old, new in changed:
                if o.has_import(old):
                    o.update_import(old, new)
            o.save(to, self.config.output_format)

    def products(self) -> dict[str, str]:
        return {f"release {n}": os.path.join(self.folder, n) for _, n, _, _ in self._files()}


class Documentation(Target):
    """Documentation of the reasoned ontology in the configured formats."""

    def __init__(self, spark: SparkSession, config: Config):
        self.reasoned = Modified(spark, config, False, True)
        super().__init__(self.reasoned)
        self.spark, self.config = spark, config
        if not os.path.isfile(config.doc_specification):
            raise ConfigError(f"The documentation specification could not be found: {config.doc_specification}.")

    def _paths(self) -> dict[str, str]:
        return {f: self.config.docs_path + {"html": ".html", "markdown": ".md"}[f] for f in self.config.doc_formats}

    def own_stale(self) -> bool:
        return any(not newer(p, self.config.doc_specification, self.reasoned.path) for p in self._paths().values())

    def make(self) -> None:
        o = Ontology(self.spark, self.reasoned.path, self.reasoned.compiled.imports.catalog())
        spec = Path(self.config.doc_specification).read_text(encoding="utf-8")
        for form, path in self._paths().items():
            _folder(path)
            Path(path).write_text(documents.document(o, spec, form), encoding="utf-8")
            if form == "html":
                Path(os.path.dirname(path), "documentation.css").write_text(documents.STYLES)

    def products(self) -> dict[str, str]:
        return {f"{f} documentation": p for f, p in self._paths().items()}


class UpdateBase(Target):
    """The base ontology with the configured imports declared in it."""

    def __init__(self, spark: SparkSession, config: Config):
        self.imports = Imports(spark, config)
        super().__init__(self.imports)
        self.spark, self.config = spark, config

    def make(self) -> None:
        o = Ontology(self.spark, self.config.base_ontology if os.path.isfile(self.config.base_ontology) else None, self.imports.catalog())
        o.set_id(self.config.dev_iri(self.config.base_ontology))
        for _, iri in self.imports.info():
            o.add_import(iri, load=False)
        _folder(self.config.base_ontology)
        o.save(self.config.base_ontology, self.config.output_format)

    def products(self) -> dict[str, str]:
        return {"base ontology": self.config.base_ontology}


class ErrorCheck(Target):
    """Whether the merged ontology is consistent, and which classes can have no members."""

    def __init__(self, spark: SparkSession, config: Config):
        self.merged = Modified(spark, config, True, False)
        super().__init__(self.merged)
        self.spark, self.found = spark, {}

    def make(self) -> None:
        self.found = Ontology(self.spark, self.merged.path).check()
        print("The ontology is consistent." if self.found["is_consistent"] else "The ontology is inconsistent.")
        for iri in self.found["unsatisfiable_classes"]:
            print(f"Unsatisfiable class: {iri}")


class Pipeline(Target):
    """A document in, the document with inferences out; standard input and output without paths."""

    def __init__(self, spark: SparkSession, config: Config, source: str = "", out: str = ""):
        super().__init__()
        if source and not os.path.isfile(source):
            raise ConfigError(f"The source ontology/data set could not be found: {source}.")
        self.spark, self.config, self.source, self.out = spark, config, source, out

    def make(self) -> None:
        o = Ontology(self.spark, self.source or sys.stdin.buffer.read())
        infer(o, self.config)
        if self.out:
            o.save(self.out, self.config.output_format)
        else:
            sys.stdout.write(o.text(self.config.output_format))

    def products(self) -> dict[str, str]:
        return {"inferred": self.out} if self.out else {}


class FindEntities(Target):
    """Searches ontologies for terms, one in a line, and writes a CSV file of matches."""

    COLUMNS = ("Search term", "Matching entity", "Label(s)", "Annotation", "Value", "Match type", "Definition(s)")

    def __init__(self, spark: SparkSession, ontologies: list[str], source: str = "", out: str = ""):
        super().__init__()
        if not ontologies:
            raise ConfigError("No search ontologies were given.")
        if missing := [p for p in [*ontologies, *filter(None, [source])] if not os.path.isfile(p)]:
            raise ConfigError(f"Files that could not be found: {', '.join(missing)}.")
        self.spark, self.ontologies, self.source, self.out = spark, ontologies, source, out

    def make(self) -> None:
        lines = (Path(self.source).read_text(encoding="utf-8") if self.source else sys.stdin.read()).splitlines()
        notes = None
        for p in self.ontologies:
            own = Ontology(self.spark, p).annotations()
            notes = own if notes is None else notes.unionByName(own)
        notes = notes.distinct()
        terms = self.spark.createDataFrame([(x.strip(),) for x in lines], "term string").distinct()
        found = search.decorated(search.find_entities(terms, search.build_index(notes)), notes, DEFINITION)
        # each line of the input gives its own block, in the input's order
        asked = self.spark.createDataFrame([(k, x.strip()) for k, x in enumerate(lines)], "line long, term string")
        rows = asked.join(found, "term").orderBy("line", "match", "iri", "text").select("term", "iri", "labels", search.short_name(F.col("prop")).alias("prop"), "text", "match", "definitions")
        out = open(self.out, "w", encoding="utf-8", newline="") if self.out else sys.stdout
        try:
            w = csv.writer(out)
            w.writerow(self.COLUMNS)
            for r in rows.toLocalIterator():  # one partition at a time
                w.writerow(r)
        finally:
            if self.out:
                out.close()

    def products(self) -> dict[str, str]:
        return {"matches": self.out} if self.out else {}


class Initialize(Target):
    """A new project: configuration, folders, sample tables and a base ontology."""

    def __init__(self, spark: SparkSession, name: str, folder: str = "."):
        super().__init__()
        if not name.strip():
            raise ConfigError("Please give the name of an ontology file for the new project.")
        self.spark, self.name, self.folder = spark, os.path.basename(name), folder

    def make(self) -> None:
        conf = os.path.join(self.folder, "project.conf")
        if os.path.exists(conf):
            raise BuildError(f"The folder {self.folder} already has a project.")
        stem = Path(self.name).stem
        for d in ("src/entities", "src/imports", "imports", "documentation"):
            os.makedirs(os.path.join(self.folder, d), exist_ok=True)
        write = lambda path, text: Path(self.folder, path).write_text(text, encoding="utf-8")
        write("project.conf", SETTINGS.format(file=self.name if Path(self.name).suffix else self.name + ".owl", stem=stem))
        for kind, columns in SAMPLES.items():
            write(f"src/entities/{stem}_{kind}.csv", ",".join(columns) + "\n")
        write("src/imports/imported_ontologies.csv", "Name,IRI,Entities file,Ignore\n")
        write("src/doc_specification.txt", f"# {stem} documentation\n\n## Classes\n")
        o = Ontology(self.spark)
        o.set_id("file://localhost" + os.path.abspath(os.path.join(self.folder, f"src/{stem}-base.owl")))
        o.save(os.path.join(self.folder, f"src/{stem}-base.owl"))


SETTINGS = """[IRIs]
dev_base_IRI =
release_base_IRI =
release_ontology_IRI =

[Ontology]
ontology_file = {file}
entity_sourcefiles = {stem}_*.csv
base_ontology_file = src/{stem}-base.owl
entity_sourcedir = src/entities

[Reasoning]
reasoner = HermiT
inferences = subclasses, equivalent classes, types, subdata properties, subobject properties
annotate_inferred = False
excluded_types_file =
preprocess_inverses = False

[Build]
insource_builds = True
builddir = build
expand_entity_defs = True
output_format = RDF/XML

[Imports]
imports_src = src/imports
imports_dir = imports
top_importsfile =
import_mod_suffix =
annotate_merged = True

[Documentation]
doc_specification = src/doc_specification.txt
docs_file_path =
doc_formats = HTML
"""
SAMPLES = {
    "classes": ("ID", "Type", "Label", "Parent", "Text definition", "Comments", "Subclass of", "Equivalent to", "Disjoint with", "Ignore"),
    "properties": ("ID", "Type", "Label", "Parent", "Text definition", "Comments", "Domain", "Range", "Characteristics", "Ignore"),
    "individuals": ("ID", "Type", "Label", "Instance of", "Text definition", "Comments", "Relations", "Data facts", "Ignore"),
}
