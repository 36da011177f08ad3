"""The contract of a source: one format for all landed feeds, and the questions that every source answers.

``spark.read.format("landed_feed").option("family", f).load(root)`` gives a
family's rows as the feed states them. A landing job keeps one folder for each
day, ``root/<family>/day=YYYY-MM-DD/``, of files with one JSON value a line: a
record, a list of records, or the feed's envelope around one. Predicates on
``day`` are pushed to the reader, which then lists and opens only those folders.

Files that cannot be read, and envelopes that report a failure, are rows with an
error and nothing else, so one bad file does not hide the rest.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import landed

#: Rows of an Arrow batch that the reader hands on.
BATCH_ROWS = 4096


@dataclass(frozen=True)
class Family:
    """A feed: its columns (all strings), where an envelope has its records, and what the rows mean."""

    columns: tuple[str, ...]
    records: str | None
    filings: Callable[[DataFrame], DataFrame]
    prefix: str


def _edinet(rows: DataFrame) -> DataFrame:
    return landed.edinet_filings(rows)


def _kap(rows: DataFrame) -> DataFrame:
    return landed.kap_filings(rows)


# Names of the feeds' fields.
FAMILIES = {
    "edinet": Family(("docID", "edinetCode", "docTypeCode", "docDescription", "submitDateTime", "periodEnd", "xbrlFlag", "pdfFlag", "withdrawalStatus", "disclosureStatus", "legalStatus"), "results", _edinet, "jp_e"),
    "kap": Family(("disclosureIndex", "companyOid", "kapTitle", "subject", "disclosureClass", "disclosureType", "publishDate"), None, _kap, "tr_kap_"),
}


def _records(family: Family, line: str):
    body = json.loads(line)
    if isinstance(body, dict) and family.records in body:
        status = str((body.get("metadata") or {}).get("status", "200"))
        if status != "200":
            raise ValueError(f"the feed reports {status}")
        body = body[family.records] or []
    body = body if isinstance(body, list) else [body]
    return [r for r in body if isinstance(r, dict)]


def read_file(family: Family, text: str, day: dt.date, number: int):
    """Rows of one file: its records in order, then an error if it ends in one."""
    seq = number << 32  # files of a day are in the order of their names
    for line in text.splitlines():
        if not line.strip():
            continue
        try:
            found = _records(family, line)
        except (ValueError, AttributeError) as e:
            yield {"day": day, "seq": seq, "error": str(e)[:200]}
            seq += 1
            continue
        for record in found:
            yield {"day": day, "seq": seq, "error": None} | {c: None if record.get(c) is None else str(record[c]) for c in family.columns}
            seq += 1


@dataclass
class DayFolder(InputPartition):
    path: str
    day: str


class FeedReader(DataSourceReader):
    """Plans one task for each day's folder that the pushed predicates leave."""

    def __init__(self, root: str, family: str):
        self.root, self.family = root, family
        self.least, self.most, self.days = dt.date.min, dt.date.max, None

    def pushFilters(self, filters):
        step = dt.timedelta(days=1)
        for f in filters:
            if getattr(f, "attribute", None) != ("day",):
                yield f
            elif isinstance(f, EqualTo):
                self.least, self.most = max(self.least, f.value), min(self.most, f.value)
            elif isinstance(f, In):
                self.days = set(f.value) if self.days is None else self.days & set(f.value)
            elif isinstance(f, GreaterThanOrEqual):
                self.least = max(self.least, f.value)
            elif isinstance(f, GreaterThan):
                self.least = max(self.least, f.value + step)
            elif isinstance(f, LessThanOrEqual):
                self.most = min(self.most, f.value)
            elif isinstance(f, LessThan):
                self.most = min(self.most, f.value - step)
            else:
                yield f

    def partitions(self):
        system, root = pafs.FileSystem.from_uri(self.root)
        found = []
        for info in system.get_file_info(pafs.FileSelector(f"{root}/{self.family}", allow_not_found=True)):
            name = info.base_name
            if info.type != pafs.FileType.Directory or not name.startswith("day="):
                continue
            day = dt.date.fromisoformat(name[4:])
            if self.least <= day <= self.most and (self.days is None or day in self.days):
                found.append(DayFolder(info.path, name[4:]))
        return sorted(found, key=lambda p: p.day) or [DayFolder("", "")]

    def read(self, partition: DayFolder):
        if not partition.path:
            return
        family = FAMILIES[self.family]
        schema = pa.schema([("day", pa.date32()), ("seq", pa.int64()), ("error", pa.string()), *((c, pa.string()) for c in family.columns)])
        system, _ = pafs.FileSystem.from_uri(self.root)
        day = dt.date.fromisoformat(partition.day)
        infos = sorted((i for i in system.get_file_info(pafs.FileSelector(partition.path)) if i.is_file and i.base_name[:1] not in "._"), key=lambda i: i.base_name)
        rows = []
        for number, info in enumerate(infos):
            try:
                with system.open_input_stream(info.path) as stream:
                    text = stream.read().decode()
                found = read_file(family, text, day, number)
            except (OSError, UnicodeDecodeError) as e:
                found = [{"day": day, "seq": number << 32, "error": str(e)[:200]}]
            for row in found:
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class LandedFeed(DataSource):
    """The format: option family, path the root of the landing."""

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return "day date, seq long, error string, " + ", ".join(f"{c} string" for c in FAMILIES[self.options["family"]].columns)

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"], self.options["family"])


def read_feed(spark: SparkSession, root: str, family: str) -> DataFrame:
    """The rows of a family's landing. Registers the format, and lets Spark push predicates into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedFeed)
    return spark.read.format("landed_feed").option("family", family).load(root)


def list_filings(spark: SparkSession, root: str, family: str, company_id: str | None = None, category: str | None = None, start: dt.date | None = None, end: dt.date | None = None, limit: int | None = None) -> DataFrame:
    """A family's filings, newest first: of one issuer, a category, the days from start to end.

    A source that does not know the issuer's id has none of its filings. Without a
    limit all are returned, in no order.
    """
    rows = read_feed(spark, root, family).where("error is null")
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end))
    out = FAMILIES[family].filings(rows.drop("day", "error"))
    if company_id is not None:
        out = out.where(F.lower("company_id") == company_id.lower()) if company_id.lower().startswith(FAMILIES[family].prefix) else out.limit(0)
    if category is not None:
        out = out.where(F.lower("category") == category.lower())
    return out.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(max(1, limit)) if limit is not None else out


def feed_status(spark: SparkSession, root: str, family: str) -> DataFrame:
    """day, n_rows, n_errors, first_error of a landing."""
    rows = read_feed(spark, root, family)
    return rows.groupBy("day").agg(F.count_if(F.col("error").isNull()).alias("n_rows"), F.count("error").alias("n_errors"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("first_error"))
