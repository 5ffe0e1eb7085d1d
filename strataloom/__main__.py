"""``python -m strataloom audit ROOT`` prints the page of an audit; ``python -m strataloom query NAME DIR`` shows a query's rows."""

from __future__ import annotations

import argparse
import sys

from .audit import audit, markdown
from .session import local_session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("audit", help="audit a tree of sources")
    one.add_argument("root")
    one.add_argument("--exclude", action="append", default=[], help="a glob of paths to leave out")
    one.add_argument("--fail-under", type=float, default=None, help="exit with 1 if the lower bound of the score is less")
    two = commands.add_parser("query", help="run a query of the catalogue over Parquet tables")
    two.add_argument("name")
    two.add_argument("tables")
    two.add_argument("--rows", type=int, default=20)
    for parts in (one, two):
        parts.add_argument("--cores", default="*")
    given = parser.parse_args(arguments)
    spark = local_session(given.cores)
    if given.command == "query":
        from .plans import catalogue

        if given.name not in catalogue.QUERIES:
            print("no such query; there are: " + ", ".join(sorted(catalogue.QUERIES)), file=sys.stderr)
            return 2
        catalogue.QUERIES[given.name](spark, given.tables).show(given.rows, truncate=False)
        return 0
    root = given.root if "://" in given.root else "file://" + given.root
    tables = audit(spark, root, given.exclude)
    print(markdown(tables))
    return int(given.fail_under is not None and tables["card"].first()["low"] < given.fail_under)


if __name__ == "__main__":
    sys.exit(main())
