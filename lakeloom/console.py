"""A console for lineage: ``python -m lakeloom.console [catalog kind] [path]``; a query a line, help, exit or quit."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lakeloom.plans import report
from lakeloom.plans.lineage import lineage
from lakeloom.sources.catalog import Catalog, connect


def reply(spark: SparkSession, line: str, catalog: Catalog) -> str:
    """The text that answers a line."""
    line = line.strip().rstrip(";")
    if line.lower() in ("", "help"):
        return "type a query to see its lineage; exit or quit ends"
    try:
        found = lineage(spark, line, catalog)
    except Exception as e:  # the console goes on
        return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return f"{report.listing(found)}\n{report.drawing(found)}"


def main(args: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    catalog = connect(spark, args[0] if args else "mock", {"path": args[1]} if len(args) > 1 else None)
    for line in sys.stdin:
        if line.strip().lower() in ("exit", "quit"):
            return
        print(reply(spark, line, catalog), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
