"""Project configuration: an INI file with typed settings and defaults."""

from __future__ import annotations

import os
from configparser import ConfigParser
from glob import glob
from pathlib import Path
from urllib.parse import quote, urlsplit, urlunsplit

from ..operators.reason import DEFAULT_INFERENCES, INFERENCES, PROFILES
from ..sources.writers import FORMATS

TRUE = ("t", "true", "y", "yes")


class ConfigError(ValueError):
    """A setting that can't be used."""


def is_glob(path: str) -> bool:
    """Whether a path is a pattern: ``*`` or ``?``, or a bracket with its end."""
    return any(c in path for c in "*?") or "[" in path and "]" in path[path.index("[") :]


class Config:
    """The settings of the project whose configuration file is given."""

    def __init__(self, path: str):
        self.path = os.path.abspath(path)
        if not os.path.isfile(self.path):
            raise ConfigError(f"The configuration file could not be found: {path}.")
        self.folder = os.path.dirname(self.path)
        self.parser = ConfigParser(interpolation=None)
        self.parser.read(self.path, encoding="utf-8")

    def get(self, section: str, key: str, default: str = "") -> str:
        return self.parser.get(section, key, fallback="").strip() or default

    def flag(self, section: str, key: str, default: bool) -> bool:
        value = self.get(section, key)
        return value.lower() in TRUE if value else default

    def absolute(self, path: str) -> str:
        return path if os.path.isabs(path) else os.path.normpath(os.path.join(self.folder, path))

    def _iri(self, key: str) -> str:
        value = self.get("IRIs", key)
        if value and (not urlsplit(value).scheme or "#" in value or any(c in value for c in ' <>"{}|\\^`')):
            raise ConfigError(f"Invalid IRI in the setting {key!r}: {value}.")
        return value

    @property
    def ontology_file(self) -> str:
        value = self.get("Ontology", "ontology_file")
        if not value:
            raise ConfigError("The setting 'ontology_file' is missing.")
        return self.absolute(value)

    @property
    def base_name(self) -> str:
        return Path(self.ontology_file).stem

    @property
    def dev_base(self) -> str:
        return self._iri("dev_base_IRI") or "file://localhost" + quote(self.folder)

    @property
    def release_base(self) -> str:
        return self._iri("release_base_IRI") or self.dev_base

    def _path_iri(self, path: str, base: str) -> str:
        rel = os.path.relpath(self.absolute(path), self.folder)
        if rel.startswith(".."):
            raise ConfigError(f"{path} is not inside the project folder {self.folder}, so it has no IRI.")
        parts = urlsplit(base)
        return urlunsplit(parts._replace(path=parts.path.rstrip("/") + "/" + quote(rel.replace(os.sep, "/"))))

    def dev_iri(self, path: str) -> str:
        return self._path_iri(path, self.dev_base)

    def release_iri(self, path: str) -> str:
        return self._path_iri(path, self.release_base)

    @property
    def release_ontology_iri(self) -> str:
        return self._iri("release_ontology_IRI") or self.release_iri(os.path.basename(self.ontology_file))

    @property
    def base_ontology(self) -> str:
        return self.absolute(self.get("Ontology", "base_ontology_file", f"src/{self.base_name}-base.owl"))

    @property
    def entity_folder(self) -> str:
        return self.absolute(self.get("Ontology", "entity_sourcedir", "src/entities"))

    @property
    def entity_files(self) -> list[str]:
        """The term tables, patterns expanded, each once; a plain name without a file is an error."""
        out: list[str] = []
        for name in filter(None, map(str.strip, self.get("Ontology", "entity_sourcefiles").split(","))):
            path = name if os.path.isabs(name) else os.path.join(self.entity_folder, name)
            found = sorted(glob(path))
            if not found and not is_glob(name):
                raise ConfigError(f"The source file could not be found: {path}.")
            out += found
        return list(dict.fromkeys(out))

    @property
    def in_source(self) -> bool:
        return self.flag("Build", "insource_builds", False)

    @property
    def build_folder(self) -> str:
        return self.absolute(self.get("Build", "builddir", "build"))

    @property
    def expand_definitions(self) -> bool:
        return self.flag("Build", "expand_entity_defs", True)

    @property
    def output_format(self) -> str:
        value = self.get("Build", "output_format", "RDF/XML")
        if value.lower() not in {f.lower() for f in FORMATS}:
            raise ConfigError(f"Unsupported output format: {value}.")
        return value

    @property
    def imports_src(self) -> str:
        return self.absolute(self.get("Imports", "imports_src", "src/imports"))

    @property
    def imports_folder(self) -> str:
        return self.absolute(self.get("Imports", "imports_dir", os.path.join(self.build_folder, "imports") if not self.in_source else "imports"))

    @property
    def imports_file(self) -> str:
        value = self.get("Imports", "top_importsfile")
        if value:
            return value if os.path.isabs(value) else os.path.join(self.imports_src, value)
        return next(iter(sorted(glob(os.path.join(self.imports_src, "imported_ontologies.*")))), "")

    @property
    def import_suffix(self) -> str:
        return self.get("Imports", "import_mod_suffix", "_{}_import_module.owl".format(self.base_name))

    @property
    def annotate_merged(self) -> bool:
        return self.flag("Imports", "annotate_merged", True)

    @property
    def reasoner(self) -> str:
        value = self.get("Reasoning", "reasoner", "HermiT")
        if value.lower() not in PROFILES:
            raise ConfigError(f"Invalid reasoner: {value}.")
        return value.lower()

    @property
    def inferences(self) -> list[str]:
        asked = [v.strip().lower() for v in self.get("Reasoning", "inferences").split(",") if v.strip()]
        if unknown := [v for v in asked if v not in INFERENCES]:
            raise ConfigError(f"Invalid inference types: {', '.join(unknown)}.")
        return asked or list(DEFAULT_INFERENCES)

    @property
    def annotate_inferred(self) -> bool:
        return self.flag("Reasoning", "annotate_inferred", False)

    @property
    def preprocess_inverses(self) -> bool:
        return self.flag("Reasoning", "preprocess_inverses", False)

    @property
    def excluded_types_file(self) -> str:
        value = self.get("Reasoning", "excluded_types_file")
        return self.absolute(value) if value else ""

    @property
    def doc_specification(self) -> str:
        return self.absolute(self.get("Documentation", "doc_specification", "src/doc_specification.txt"))

    @property
    def docs_path(self) -> str:
        """Where documentation goes, without the format's extension."""
        value = self.get("Documentation", "docs_file_path")
        return os.path.splitext(self.absolute(value))[0] if value else os.path.join(self.folder if self.in_source else self.build_folder, "documentation", self.base_name)

    @property
    def doc_formats(self) -> list[str]:
        asked = [v.strip().lower() for v in self.get("Documentation", "doc_formats", "HTML").split(",") if v.strip()]
        if unknown := [v for v in asked if v not in ("html", "markdown")]:
            raise ConfigError(f"Invalid documentation formats: {', '.join(unknown)}.")
        return asked
