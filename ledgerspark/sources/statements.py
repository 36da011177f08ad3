"""Statements printed in text or Markdown tables.

Pages and tables are split natively; the reading of one filing's rows is
sequential and stays one Python function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineitems import STATEMENT_OF, code_of_label

# Headings by which statements are found.
HEADINGS = {
    "income_statement": ("income statement", "statement of profit or loss", "profit and loss account", "statement of operations", "statement of income", "demonstracao do resultado", "estado de resultados"),
    "comprehensive_income": ("statement of comprehensive income", "statement of other comprehensive income"),
    "balance_sheet": ("balance sheet", "statement of financial position", "balanco patrimonial", "estado de situacion financiera"),
    "cash_flow_statement": ("statement of cash flows", "cash flow statement", "demonstracao dos fluxos de caixa", "estado de flujos de efectivo"),
    "changes_in_equity": ("statement of changes in equity",),
}
LOOK_AHEAD = 14


def heading_of(line: str) -> str | None:
    """The statement that a short line names."""
    low = re.sub(r"[^\w\s]", " ", line.casefold()).strip()
    low = re.sub(r"\s+", " ", re.sub(r"\b(consolidated|group|company|condensed|interim|separate|the)\b", " ", low)).strip()
    if not low or len(low.split()) > 12:
        return None
    for statement in ("comprehensive_income", "changes_in_equity", "cash_flow_statement", "balance_sheet", "income_statement"):
        if any(low.startswith(h) or low.endswith(h) for h in (x.replace("consolidated ", "") for x in HEADINGS[statement])):
            return statement
    return None


def number(text: str) -> Decimal | None:
    """A printed number; the rules are those of functions.numbers.parse_number."""
    raw = re.sub(r"(?i)(?:us|hk|r)?[$£€¥₹]|[\s\xa0'’]", "", text.strip())
    negative = bool(re.fullmatch(r"\(.*\)", raw) or re.match(r"[-−–]", raw) or re.search(r"[-−]$", raw))
    body = re.sub(r"[()−–-]", "", raw)
    if re.fullmatch(r"\d{1,3}(?:,\d{2})*,\d{3}(?:\.\d+)?", body) and re.search(r",\d{2},", body):
        body = body.replace(",", "")
    elif "." in body and "," in body:
        body = body.replace(",", "") if body.rfind(".") > body.rfind(",") else body.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"\d{1,3}(?:,\d{3})+", body):
        body = body.replace(",", "")
    elif re.fullmatch(r"\d{1,3}(?:\.\d{3})+", body):
        body = body.replace(".", "")
    elif re.fullmatch(r"\d*,\d+", body):
        body = body.replace(",", ".")
    if not re.fullmatch(r"\d*\.?\d+|\d+\.", body):
        return None
    try:
        return -Decimal(body) if negative else Decimal(body)
    except InvalidOperation:
        return None


def scale_and_currency(text: str) -> tuple[int, str | None]:
    from ..functions.numbers import CURRENCIES, SCALES, mark_pattern

    low = text.casefold()
    scale = next((f for f, words in SCALES if any(w in low for w in words)), 1000 if re.search(r"(?<!\d)['’]?000(?!\d)", low) else 1)
    found = next((code for code, marks in CURRENCIES if any(re.search(mark_pattern(m), low) for m in marks)), None)
    return scale, found


def years_of(cells: list[str], most: int | None) -> list[int | None]:
    out = []
    for cell in cells:
        found = re.search(r"(?<!\d)(19|20)\d{2}(?!\d)", cell)
        year = int(found.group(0)) if found else None
        out.append(year if year and (most is None or year <= most) else None)
    return out


def tables_of(markdown: str) -> Iterator[tuple[str, list[list[str]]]]:
    """The text before, and the rows of, each run of two table lines or more."""
    before: list[str] = []
    rows: list[list[str]] = []
    for line in [*markdown.splitlines(), ""]:
        if line.lstrip().startswith("|"):
            cells = [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]
            if not all(re.fullmatch(r":?-*:?", c) for c in cells):
                rows.append(cells)
            continue
        if len(rows) >= 2:
            yield "\n".join(before[-8:]), rows
            before = []
        rows = []
        before.append(line)


def read_tables(markdown: str, period_year: int | None) -> list[dict]:
    """Line items of statements in Markdown tables: of each code the row with most values, the first of equals.

    Only tables with two known codes or more count. After the first current
    asset a balance sheet's codes of other statements are not read.
    """
    best: dict[str, dict] = {}
    statement = None
    for at, (before, rows) in enumerate(tables_of(markdown)):
        for line in before.splitlines():
            statement = heading_of(line.lstrip("# ")) or statement
        header = max(rows[:4], key=lambda r: sum(y is not None for y in years_of(r, period_year)))
        years = years_of(header, period_year)
        if not any(years):
            continue
        scale, currency = scale_and_currency(before + " " + " ".join(header))
        found = []
        for pos, cells in enumerate(rows):
            code = code_of_label(cells[0])
            if code is None:
                continue
            values = {y: v for y, c in zip(years, cells) if y and (v := number(c)) is not None}
            if values:
                per_share = code in ("basic_eps", "diluted_eps")
                found.append({"code": code, "name": cells[0], "values": {y: v if per_share else v * scale for y, v in values.items()}, "unit": currency, "decimals": None if per_share else -len(str(scale)) + 1, "pos": (at, pos)})
        if len({f["code"] for f in found}) < 2:
            continue
        for item in found:
            if item["code"] not in best or len(item["values"]) > len(best[item["code"]]["values"]):
                best[item["code"]] = item
    return [i | {"statement_type": STATEMENT_OF[i["code"]]} for i in best.values()]


def read_lines(text: str, period_year: int | None) -> list[dict]:
    """Line items of text with one label or number a line: the numbers that follow a label are its years'.

    The rows of the newer years win, then the larger numbers, then the first.
    """
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    head = next((i for i, x in enumerate(lines) if heading_of(x)), None)
    if head is None:
        return []
    own = heading_of(lines[head])
    for i in range(head + 12, len(lines)):
        other = heading_of(lines[i])
        if other and other != own and lines[i][:1].isupper():
            lines = lines[:i]
            break
    years = list(dict.fromkeys(y for x in lines[head : head + 30] for y in years_of(re.findall(r"\d{4}", x), period_year) if y))[:2]
    if not years:
        return []
    scale, currency = scale_and_currency(" ".join(lines[head : head + 30]))
    best: dict[str, dict] = {}
    for i in range(head, len(lines)):
        code = code_of_label(re.sub(r"\s*\(?note \d+\)?$", "", lines[i], flags=re.I))
        if code is None or STATEMENT_OF[code] != own and not (own == "income_statement" and STATEMENT_OF[code] == "comprehensive_income"):
            continue
        numbers: list[Decimal] = []
        for x in lines[i + 1 : i + 1 + LOOK_AHEAD]:
            value = number(x)
            if value is None:
                if re.fullmatch(r"[-–—]", x):
                    continue
                break
            numbers.append(value)
        if len(numbers) > len(years) and 0 <= numbers[0] <= 99 and numbers[0] == int(numbers[0]) and any(abs(n) >= 100 for n in numbers[1:]):
            numbers = numbers[1:]  # a note's number
        values = dict(zip(years, numbers))
        if not values:
            continue
        item = {"code": code, "name": lines[i], "values": {y: v * (1 if "eps" in code else scale) for y, v in values.items()}, "unit": currency, "decimals": -len(str(scale)) + 1, "statement_type": STATEMENT_OF[code], "pos": (0, i)}
        rank = lambda x: (len(x["values"]), max(x["values"]), sum(abs(v) for v in x["values"].values()))
        if code not in best or rank(item) > rank(best[code]):
            best[code] = item
    return list(best.values())


ITEMS_DDL = "filing_id string, statement_type string, code string, name string, year int, value decimal(38,10), unit string, decimals int, provenance string, confidence int, method string"


def read_statements(documents: DataFrame) -> DataFrame:
    """Line items of documents (filing_id, markdown, period_end date): tables first, else text."""

    def run(frames):
        for frame in frames:
            rows = []
            for filing, text, end in zip(frame["filing_id"], frame["markdown"], frame["period_end"]):
                year = None if end is None or pd.isna(end) else pd.Timestamp(end).year
                found, method = read_tables(text or "", year), "table"
                if not found:
                    found, method = read_lines(text or "", year), "text"
                rows += [(filing, i["statement_type"], i["code"], i["name"], y, v.quantize(Decimal(1).scaleb(-10)), i["unit"], i["decimals"], "pdf_table", 75, method) for i in found for y, v in i["values"].items()]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS_DDL.split(", ")])
            out["decimals"] = out["decimals"].astype("Int32")
            yield out

    return documents.select("filing_id", "markdown", "period_end").mapInPandas(run, ITEMS_DDL)


def statement_pages(pages: DataFrame) -> DataFrame:
    """Pages (filing_id, page, text) with a statement's heading near their top, each with the page after it."""
    order = Window.partitionBy("filing_id").orderBy("page")
    words = "|".join(re.escape(h) for hs in HEADINGS.values() for h in hs)
    top = F.array_join(F.slice(F.split("text", r"\R"), 1, 12), "\n")
    both = pages.withColumn("after", F.coalesce(F.lead("text").over(order), F.lit("")))
    return both.where(F.lower(top).rlike(words)).select("filing_id", "page", F.concat_ws("\n", "text", "after").alias("text"))


def choose_extraction(rows: DataFrame) -> DataFrame:
    """Native or OCR text of each document (filing_id, ocr_mode, native_text, native_score, ocr_text, ocr_score,
    ocr_available): OCR only where it is wanted, possible and better."""
    wanted = (F.col("ocr_mode") == "always") | ((F.col("ocr_mode") == "auto") & (F.coalesce("native_score", F.lit(0)) < 70))
    better = wanted & F.col("ocr_available") & F.col("ocr_text").isNotNull() & (F.coalesce("ocr_score", F.lit(0)) > F.coalesce("native_score", F.lit(0)))
    warning = F.when(~wanted, None).when(~F.col("ocr_available"), "ocr_unavailable").when(F.col("ocr_text").isNull(), "ocr_failed").when(~better, "ocr_not_better")
    return rows.withColumn("warning", warning).withColumn("method", F.when(better, "ocr").otherwise("native")).withColumn("text", F.when(better, F.col("ocr_text")).otherwise(F.col("native_text"))).withColumn("score", F.when(better, F.col("ocr_score")).otherwise(F.col("native_score")))


def route(documents: DataFrame) -> DataFrame:
    """documents (content, media_type, profile) with the route by which each is read."""
    head, kind = F.hex(F.substring("content", 1, 4)), F.lower(F.coalesce("media_type", F.lit("")))
    markup = F.lower(F.substring("content", 1, 1024).try_cast("string")).rlike(r"<(?:!doctype html|html|\?xml|ix:)")
    return documents.withColumn("route", F.when(F.contains(kind, F.lit("pdf")) | F.startswith(head, F.lit("25504446")), "pdf").when(F.contains(kind, F.lit("html")) | markup, "html").when(F.contains(kind, F.lit("zip")) | F.startswith(head, F.lit("504B")), F.coalesce(F.when(F.col("profile").isin("bmv-json", "edinet"), F.col("profile")), F.lit("zip"))).otherwise("unknown"))
