"""Ownership forms: major holdings and dealings of insiders, from their HTML."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.folds import KINDS
from .statements import number

_FORMATS = ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y-%m-%d", "%d %B %Y", "%d %b %Y", "%d-%b-%Y")


class _Cells(HTMLParser):
    """Texts of blocks and cells in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.now: list[str] = []
        self.skip = 0

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.now).replace("\xa0", " ")).strip()
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("td", "th", "tr", "p", "div", "li", "br", "table"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in ("td", "th", "tr", "p", "div", "li", "table"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def cells(html: str) -> list[str]:
    parser = _Cells()
    parser.feed(html)
    parser.flush()
    return parser.out


def parse_day(text: str | None) -> date | None:
    plain = re.sub(r"\b(\d{1,2})(?:st|nd|rd|th)\b", r"\1", (text or "").strip(), flags=re.I)
    for fmt in _FORMATS:
        try:
            return datetime.strptime(plain, fmt).date()
        except ValueError:
            continue
    return None


def after(tokens: list[str], *labels: str) -> str | None:
    """The text after the first one that begins as a label does."""
    keys = [KINDS["form"](x) for x in labels]
    folded = [KINDS["form"](re.sub(r"^[\divxa-z]{1,4}[.)]\s*", "", t, flags=re.I)) for t in tokens]
    for key in keys:
        for i, t in enumerate(folded[:-1]):
            if t.startswith(key):
                return tokens[i + 1]
    return None


def major_holding(html: str) -> dict | None:
    """A notice of major holdings; none if it does not name an issuer and a holder."""
    t = cells(html)
    issuer, holder = after(t, "identity of issuer", "issuer name", "name of issuer"), after(t, "name", "full name of person", "details of person subject to notification")
    if not issuer or not holder:
        return None
    percent = None
    for i, x in enumerate(t):
        if KINDS["form"](x).startswith("resulting situation"):
            values = [v for y in t[i + 1 : i + 6] if (v := number(y.replace("%", ""))) is not None]
            percent = values[2] if len(values) > 2 else values[-1] if values else None
            break
    return {"issuer_name": issuer, "holder_name": holder, "crossed_date": parse_day(after(t, "date on which threshold was crossed")), "notified_date": parse_day(after(t, "date on which issuer notified", "date issuer notified")), "percent": percent}


def _price(text: str) -> tuple[Decimal | None, str | None]:
    found = re.search(r"[\d.,]*\d", text)
    mark = next((c for m, c in (("£", "GBP"), ("€", "EUR"), ("$", "USD")) if m in text), None) or ("GBX" if re.search(r"\d\s*p(?:ence)?\b", text, re.I) else None)
    code = re.search(r"\b(GBP|EUR|USD|GBX)\b", text)
    return number(found.group(0)) if found else None, code.group(1) if code else mark


def dealings(html: str) -> list[dict]:
    """Dealings of a form: person, position, instrument, nature, date, and lots of price and volume."""
    t = cells(html)
    starts = [i for i, x in enumerate(t) if KINDS["form"](re.sub(r"^[\da-z][.)]\s*", "", x, flags=re.I)) in ("name", "name of natural person")]
    out = []
    for a, b in zip(starts, [*starts[1:], len(t)]):
        part = t[a:b]
        lots = []
        for i, x in enumerate(part):
            if KINDS["form"](re.sub(r"^[\da-z][.)]\s*", "", x, flags=re.I)).startswith("price s and volume s"):
                rest = [y for y in part[i + 1 : i + 40] if not re.match(r"(?i)price|volume", y)]
                for p, v in zip(rest[::2], rest[1::2]):
                    price, currency = _price(p)
                    volume = number(v)
                    if price is None or volume is None:
                        break
                    if (lot := {"price": price, "currency": currency, "volume": volume}) not in lots:
                        lots.append(lot)
                break
        isin = re.search(r"\b[A-Z]{2}[A-Z0-9]{9}\d\b", " ".join(part))
        out.append({"person": part[1] if len(part) > 1 else None, "position": after(part, "position status"), "instrument": isin.group(0) if isin else None, "nature": after(part, "nature of transaction"), "date": parse_day(after(part, "date of transaction")), "lots": lots})
    return [d for d in out if d["nature"] or d["lots"]]


def read_holdings(documents: DataFrame) -> DataFrame:
    """One row for each notice of documents (filing_id, html) that can be read."""

    def run(frames):
        for frame in frames:
            rows = [(f, *d.values()) for f, h in zip(frame["filing_id"], frame["html"]) if (d := major_holding(h or ""))]
            yield pd.DataFrame(rows, columns=["filing_id", "issuer_name", "holder_name", "crossed_date", "notified_date", "percent"])

    return documents.select("filing_id", "html").mapInPandas(run, "filing_id string, issuer_name string, holder_name string, crossed_date date, notified_date date, percent decimal(38,10)")


def read_dealings(documents: DataFrame) -> DataFrame:
    """filing_id and its dealings, one row each."""

    def run(frames):
        for frame in frames:
            rows = [(f, i, *d.values()) for f, h in zip(frame["filing_id"], frame["html"]) for i, d in enumerate(dealings(h or ""))]
            yield pd.DataFrame(rows, columns=["filing_id", "dealing_no", "person", "position", "instrument", "nature", "date", "lots"])

    return documents.select("filing_id", "html").mapInPandas(run, "filing_id string, dealing_no int, person string, position string, instrument string, nature string, date date, lots array<struct<price:decimal(38,10),currency:string,volume:decimal(38,10)>>")
