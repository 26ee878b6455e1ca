"""Command line: validate a configuration, index crawled documents, search."""

from __future__ import annotations

import argparse
import sys

from docloom import __version__
from docloom.functions.config import ConfigError, load_config, plan_lines


def flags(given: list[str]) -> list[str]:
    """Repeated flags and lists with commas as one list."""
    return [x for part in given for x in (y.strip() for y in part.split(",")) if x]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    v = sub.add_parser("validate")
    v.add_argument("config")
    v.add_argument("--source", action="append", default=[])
    i = sub.add_parser("index")
    i.add_argument("--docs", required=True, help="Parquet folder of crawled documents")
    i.add_argument("--out", required=True)
    i.add_argument("--config", help="lists the plan before the run")
    i.add_argument("--source", action="append", default=[])
    s = sub.add_parser("search")
    s.add_argument("--index", required=True)
    s.add_argument("--source", action="append", default=[])
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("query", nargs="+")
    a = p.parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "validate":
        try:
            print("\n".join(plan_lines(load_config(a.config), flags(a.source))))
        except ConfigError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    from docloom.operators.indexing import build_index, index_documents
    from docloom.operators.search import result_lines, search
    from docloom.session import local_session
    from docloom.sources.corpus import read_tables, write_tables

    spark = local_session("*")
    if a.command == "index":
        chosen = flags(a.source)
        docs = spark.read.parquet(a.docs)
        if a.config:
            try:
                print("\n".join(plan_lines(load_config(a.config), chosen)))
            except ConfigError as e:
                print(e, file=sys.stderr)
                return 1
        if chosen:
            docs = docs.filter(docs["source_id"].isin(chosen))
        write_tables(build_index(index_documents(docs)), a.out)
        return 0
    query = " ".join(a.query)
    if not query.strip():
        print("a query is needed", file=sys.stderr)
        return 2
    chosen, index = flags(a.source), read_tables(spark, a.index)
    known = {r["source_id"] for r in index.docs.select("source_id").distinct().collect()}  # a row a source
    if unknown := sorted(set(chosen) - known):
        print(f"unknown source: {', '.join(unknown)}", file=sys.stderr)
        return 2
    for r in result_lines(search(index, query, chosen or None, a.limit)).orderBy("rank").collect():
        print(r["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
