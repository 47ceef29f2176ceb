"""Command line: ``datasets list|info`` over a registry file, ``query NAME`` over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    parser = argparse.ArgumentParser(prog="netquarry")
    commands = parser.add_subparsers(dest="command", required=True)
    datasets = commands.add_parser("datasets")
    datasets.add_argument("action", choices=["list", "info"])
    datasets.add_argument("selector", nargs="?")
    datasets.add_argument("--registry", required=True)
    run = commands.add_parser("query")
    run.add_argument("name")
    run.add_argument("--tables", required=True)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("netquarry").getOrCreate()
    if args.command == "query":
        from .registry import QUERIES

        QUERIES[args.name](spark, args.tables).show(50, False)
        return
    from .sources.catalog import registry, select_datasets

    rows = registry(spark, args.registry)
    found = rows if args.selector is None else select_datasets(rows, args.selector)
    for r in found.collect():
        print(r["dataset_id"] if args.action == "list" else r.asDict(recursive=True))


if __name__ == "__main__":
    main()
