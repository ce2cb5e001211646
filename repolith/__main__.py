"""python -m repolith list | run QUERY DIR [--limit N] [--budget TOKENS]: the registered queries from a shell."""

from __future__ import annotations

import argparse
import json


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="repolith")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="a query's first rows as JSON lines")
    run.add_argument("query")
    run.add_argument("directory")
    run.add_argument("--limit", type=int, default=20)
    run.add_argument("--budget", type=int)
    asked = parser.parse_args(args)

    from repolith.plans import catalog, responses

    if asked.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if asked.query not in catalog.queries():
        parser.error(f"no such query: {asked.query}")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("repolith").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    said = responses.answer(asked.query, catalog.queries()[asked.query](spark, asked.directory), asked.limit, asked.budget)
    print(said["data"] or "")
    print(json.dumps(said["meta"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
