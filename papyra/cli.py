"""Command line: spark-submit papyra/cli.py extract|batch|detect|version ... with text or JSON output; batch runs the pipeline."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="papyra")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "batch", "detect"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--format", choices=("text", "json"), default="text")
        s.add_argument("--output", help="a folder to write to instead of standard output")
        s.add_argument("--glob", help="a pattern of file names")
        if name == "batch":
            s.add_argument("--config", help="a configuration file; without one the nearest papyra.toml")
    sub.add_parser("version")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        import papyra

        print(papyra.__version__)
        return 0
    from pyspark.sql import SparkSession

    from papyra import config
    from papyra.sources.files import extract_files, process_files, read_files

    spark = SparkSession.builder.appName("papyra").getOrCreate()
    files = read_files(spark, a.path, glob=a.glob)
    if a.command == "batch":  # with the pipeline
        out = process_files(files, config.load(a.config) if a.config else config.discover(".")).drop("tables")
    else:
        out = files.select("path", "mime_type") if a.command == "detect" else extract_files(files).drop("tables")
    if a.output:
        (out.write.json(a.output) if a.format == "json" else out.selectExpr(f"coalesce({out.columns[-1] if a.command == 'detect' else 'content'}, '') as value").write.text(a.output))
        return 0
    for row in out.toLocalIterator():  # one row at a time, as results come
        print(json.dumps(row.asDict(), default=str) if a.format == "json" else row.asDict().get("content") or f"{row.path}\t{row.asDict().get('mime_type', '')}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
