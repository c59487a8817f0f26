"""Command line: ``python -m pagewright``.

    extract SOURCE TARGET [--css SELECTOR] [--main]   a stored page, or a selection of it, in the target's format
    select SOURCE (--css S | --xpath X)               values of a selection, one a line
    curl COMMAND                                      a curl command as JSON
    queries [--sf DIR NAME]                           names of the registered queries, or the rows of one
    ledger FILE (rows | rollup)                       a ledger file as rows, or rolled up

Exit codes: 0 done, 1 failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("extract")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--css", default="")
    c.add_argument("--main", action="store_true")
    c = sub.add_parser("select")
    c.add_argument("source")
    how = c.add_mutually_exclusive_group(required=True)
    how.add_argument("--css")
    how.add_argument("--xpath")
    c = sub.add_parser("curl")
    c.add_argument("line")
    c = sub.add_parser("queries")
    c.add_argument("name", nargs="?")
    c.add_argument("--sf", default="")
    c = sub.add_parser("ledger")
    c.add_argument("file")
    c.add_argument("what", choices=["rows", "rollup"])
    return p


def run(args: argparse.Namespace) -> None:
    from pagewright import api

    if args.command == "extract":
        from pagewright.operators import views

        page = api.parse(Path(args.source).read_text(encoding="utf-8"))
        if args.main:
            page.root = views.main_content(page.root)
        out = api.render(page, args.target, args.css)
        Path(args.target).parent.mkdir(parents=True, exist_ok=True)
        Path(args.target).write_text(out, encoding="utf-8")
        print(f"wrote {args.target}")
    elif args.command == "select":
        page = api.parse(Path(args.source).read_text(encoding="utf-8"))
        for value in (page.css(args.css) if args.css else page.xpath(args.xpath)).get_all():
            print(value)
    elif args.command == "curl":
        from pagewright.sources import curl

        spark = _session()
        print(curl.curl_requests(spark.createDataFrame([(args.line,)], "command string")).toJSON().first())
    elif args.command == "queries":
        from pagewright import catalog

        if not args.name:
            print("\n".join(sorted(catalog.queries())))
            return
        for line in catalog.queries()[args.name](_session(), args.sf).toJSON().toLocalIterator():
            print(line)
    else:
        from pyspark.sql import functions as F

        from pagewright.operators import ledger

        spark = _session()
        rows = ledger.ledger_rows(spark.read.text(args.file, wholetext=True).select(F.col("value").alias("text")))
        if args.what == "rows":
            for r in rows.orderBy("phase", "subphase", "pos").toLocalIterator():
                print(json.dumps(r.asDict(), ensure_ascii=False))
        else:
            items = rows.select("phase", "subphase", F.try_element_at("item", F.lit("status")).alias("status"))
            for r in ledger.roll_up(items).orderBy("phase", F.col("subphase").asc_nulls_first()).toLocalIterator():
                print(json.dumps(r.asDict(), ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        run(args)
    except (OSError, ValueError, KeyError) as e:
        print(f"pagewright: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
