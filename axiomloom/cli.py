"""The command line: ``python -m axiomloom.cli [options] task [argument]``."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from .plans import targets
from .plans.config import Config

log = logging.getLogger("axiomloom")
#: Tasks and, for ``make``, what can be made.
TASKS = ("initialize", "make", "update_base", "error_check", "inference_pipeline", "ipl", "find_entities", "fe")
MAKES = ("imports", "ontology", "release", "documentation")


def chosen(text: str, names: tuple[str, ...]) -> str:
    """The one of ``names`` that ``text`` is or begins."""
    if text in names:
        return text
    found = [n for n in names if n.startswith(text)]
    if len(found) != 1:
        raise ValueError(f"{text!r} is " + ("ambiguous: " + ", ".join(found) if found else "unknown; known are: " + ", ".join(names)))
    return found[0]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axiomloom", description="Builds, checks, searches and documents ontologies on Spark.")
    p.add_argument("-c", "--config_file", default="project.conf", help="the project's configuration file")
    p.add_argument("-q", "--quiet", action="store_true", help="only print errors")
    p.add_argument("-f", "--force", action="store_true", help="run even if everything is up to date")
    p.add_argument("-m", "--merge_imports", action="store_true", help="merge the imports into the ontology")
    p.add_argument("-r", "--reason", action="store_true", help="add inferred axioms")
    p.add_argument("-d", "--release_date", default="", help="the date of a release, YYYY-MM-DD")
    p.add_argument("-i", "--input_data", default="", help="document or search terms to read; standard input without it")
    p.add_argument("-o", "--fileout", default="", help="file to write; standard output without it")
    p.add_argument("-s", "--search_ont", action="append", default=[], help="an ontology to search; may be repeated")
    p.add_argument("task", nargs="?", default="make", help=", ".join(TASKS))
    p.add_argument("taskarg", nargs="?", default="ontology", help="for make: " + ", ".join(MAKES) + "; for initialize: the ontology file's name")
    return p


def target(spark: SparkSession, args: argparse.Namespace) -> targets.Target:
    """The build target that the arguments ask for."""
    task = chosen(args.task, TASKS)
    if task == "initialize":
        return targets.Initialize(spark, args.taskarg)
    if task in ("find_entities", "fe"):
        return targets.FindEntities(spark, args.search_ont, args.input_data, args.fileout)
    config = Config(args.config_file)
    if task in ("inference_pipeline", "ipl"):
        return targets.Pipeline(spark, config, args.input_data, args.fileout)
    if task == "update_base":
        return targets.UpdateBase(spark, config)
    if task == "error_check":
        return targets.ErrorCheck(spark, config)
    what = chosen(args.taskarg, MAKES)
    if what == "imports":
        return targets.Imports(spark, config)
    if what == "release":
        return targets.Release(spark, config, args.release_date)
    if what == "documentation":
        return targets.Documentation(spark, config)
    if args.merge_imports or args.reason:
        return targets.Modified(spark, config, args.merge_imports, args.reason)
    return targets.Compiled(spark, config)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.INFO, format="%(message)s", stream=sys.stderr)
    spark = spark or SparkSession.builder.appName("axiomloom").getOrCreate()
    try:
        t, began = target(spark, args), time.time()
        if not args.force and not t.stale():
            log.info("Everything is up to date.")
            return 0
        for name, path in t.run(args.force).items():
            log.info("%s: %s", name, path)
        log.info("Done in %.1f s.", time.time() - began)
        return 0
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
