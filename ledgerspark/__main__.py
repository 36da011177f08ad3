"""Command line over a lake of canonical tables: python -m ledgerspark --lake DIR COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .collections import Lake
from .operators import storage, windows
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerspark")
    parser.add_argument("--lake", required=True)
    parser.add_argument("--limit", type=int, default=10)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arg in (("search", "query"), ("filings", "company"), ("facts", "company"), ("financials", "filing"), ("sections", "filing"), ("find", "query"), ("holders", "query"), ("disclosures", "query")):
        commands.add_parser(name).add_argument(arg)
    commands.add_parser("status")
    args = parser.parse_args(argv)
    if not 1 <= args.limit <= 1000:
        parser.error("limit must be 1 to 1000")
    lake = Lake(build_session(spark__ui__enabled="false"), args.lake)
    if args.command == "search":
        out = lake.companies.search(args.query, args.limit).df
    elif args.command == "filings":
        out = lake.filings.of_company(args.company).latest(args.limit).df
    elif args.command == "facts":
        out = windows.merge_company_facts(lake.facts.df.where(F.col("company_id") == args.company), args.limit)
    elif args.command == "financials":
        out = lake.facts.df.where(F.col("filing_id") == args.filing)
    elif args.command == "sections":
        out = lake.documents.sections().where(F.col("filing_id") == args.filing).drop("markdown").limit(args.limit)
    elif args.command == "find":
        out = lake.documents.search(args.query, args.limit)
    elif args.command == "holders":
        out = windows.holders(lake._read("holders"), args.query, args.limit)
    elif args.command == "disclosures":
        out = lake.filings.df.where(F.contains(F.lower("title"), F.lit(args.query.lower()))).orderBy(windows.filed_at().desc()).limit(args.limit)
    else:
        out = storage.stats(companies=(lake.companies.df, None), filings=(lake.filings.df, None), facts=(lake.facts.df, None), documents=(lake.documents.df, F.octet_length("markdown")))
    for row in out.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
