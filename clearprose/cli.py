"""clearprose FILE...: lints files with Spark and prints a report for each."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from clearprose import config as settings
from clearprose.operators import report
from clearprose.plans.lint import lint
from clearprose.sources import readers

VERSION = "0.1.0"


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="clearprose", description=__doc__)
    parser.add_argument("files", nargs="*", default=["-"], help="files or folders; - reads one text from the input")
    parser.add_argument("--version", action="version", version=f"clearprose {VERSION}")
    parser.add_argument("--json", action="store_true", help="one JSON object for each file")
    parser.add_argument("--hard-only", action="store_true", help="only hard violations fail")
    parser.add_argument("--kind", choices=["prose-file", "slash-source", "hash-source", "commit-message"])
    parser.add_argument("--config", help="a TOML file")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """0: clean, 1: violations, 2: a file can't be read or the usage is wrong."""
    try:
        args = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.appName("clearprose").getOrCreate()
    try:
        docs = None
        for name in args.files:
            one = readers.typed_text(spark, sys.stdin.read(), args.kind) if name == "-" else readers.text_files(spark, name, args.kind)
            docs = one if docs is None else docs.unionByName(one)
        found = lint(docs, settings.load(args.config))
        told = report.text_reports(docs, found, args.hard_only)
        shown = (told.drop("report").join(report.json_reports(docs, found), "doc_id") if args.json else told).orderBy("doc_id")
        failed = False
        for row in shown.toLocalIterator():
            print(row.report)
            failed |= row.failed
        return int(failed)
    except Exception as e:  # noqa: BLE001
        print(f"clearprose: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
