"""Command line: scan listings of a Parquet or JSON file, report on quality, list sources."""

from __future__ import annotations

import argparse
import contextlib
import sys
from datetime import date

from pyspark.sql import functions as F

from .functions.geo import ROWS
from .operators import filtering, output, quality, resolve
from .plans.scan import ScanOptions, scan
from .plans.session import local_session
from .sources import catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestrata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("input")
    s.add_argument("--keyword", action="append", default=[])
    s.add_argument("--prefecture")
    s.add_argument("--employment", action="append", default=[])
    s.add_argument("--language")
    s.add_argument("--days", type=int, default=7)
    s.add_argument("--as-of", type=date.fromisoformat, required=True)
    s.add_argument("--exclude-unknown-dates", action="store_true")
    s.add_argument("--no-dedup", action="store_true")
    s.add_argument("--format", choices=["json", "markdown", "table", "csv", "llm"], default="table")
    s.add_argument("--output")
    r = sub.add_parser("report")
    r.add_argument("input")
    r.add_argument("--start", type=date.fromisoformat, required=True)
    r.add_argument("--end", type=date.fromisoformat, required=True)
    sub.add_parser("sources")
    return p


def validate(args: argparse.Namespace) -> str | None:
    """What is wrong with the arguments, if anything."""
    if args.command == "scan":
        if args.prefecture and args.prefecture not in {x[1] for x in ROWS}:
            return f"unknown prefecture: {args.prefecture}"
        if args.days is not None and args.days < 0:
            return "--days must not be negative"
        if args.format == "csv" and not args.output:
            return "--format csv needs --output"
    if args.command == "report" and args.start > args.end:
        return "--start is behind --end"
    return None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if wrong := validate(args):
        print(wrong, file=sys.stderr)
        return 2
    spark = local_session()
    if args.command == "sources":
        catalog.list_sources(spark).show(100, truncate=False)
        return 0
    raw = spark.read.json(args.input) if args.input.endswith(".json") else spark.read.parquet(args.input)
    if args.command == "report":
        quality.report(raw, args.start, args.end).show(100, truncate=False)
        return 0
    o = filtering.FilterOptions(args.as_of, args.keyword, args.prefecture, args.days, args.employment, args.language, include_unknown_dates=not args.exclude_unknown_dates)
    result = scan(raw, ScanOptions(o, not args.no_dedup))
    found = resolve.numbered(result.listings)
    if args.format == "csv":
        output.write_csv(found, args.output)
        return 0
    stats = {"scanned_at": args.as_of.isoformat(), "total": found.count(), "names": [r["source"] for r in result.per_source.select("source").orderBy("source").collect()]}
    counts = result.per_source.agg(F.sum("raw_total").alias("raw"), F.sum("filtered").alias("filtered"), F.sum("raw_kept").alias("kept")).first()
    stats |= {"sources": len(stats["names"]), "raw_total": counts["raw"] or 0, "filtered": counts["filtered"] or 0, "merged": (counts["kept"] or 0) - stats["total"]}
    pieces = [output.briefing(found, stats) + "\n"] if args.format == "llm" else output.stream(found, args.format, stats)
    with open(args.output, "w") if args.output else contextlib.nullcontext(sys.stdout) as f:
        for piece in pieces:
            f.write(piece)
    return 0


if __name__ == "__main__":
    sys.exit(main())
