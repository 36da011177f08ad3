"""Bound collections: lazy tables with the methods that users of issuers, filings and facts expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import derive, documents, search, windows


class Table:
    """An immutable view of a DataFrame; slices and filters give new views."""

    def __init__(self, df: DataFrame):
        self.df = df

    def head(self, count: int):
        if count < 0:
            raise ValueError("count must be 0 or more")
        return type(self)(self.df.limit(count))

    def slice(self, start: int, count: int):
        return type(self)(self.df.offset(start).limit(count))

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def to_pandas(self):
        return self.df.toPandas()


class Companies(Table):
    FIELDS = ("id", "name", "lei", "ticker", "local_code")

    def filter(self, **conditions) -> Companies:
        return Companies(search.filter_companies(self.df, **conditions))

    def search(self, query: str, limit: int = 10) -> Companies:
        return Companies(search.three_tiers(self.df, query, [c for c in self.FIELDS if c in self.df.columns], "name", limit))

    def find(self, value: str) -> Companies:
        return Companies(search.find_first(self.df, value, [c for c in self.FIELDS if c in self.df.columns], "id"))

    def one(self, query: str) -> Companies:
        """An exact match, else the best of ten; an error if there is none."""
        found = self.find(query)
        found = found if not found.empty else self.search(query, 10).head(1)
        if found.empty:
            raise LookupError(f"no company matches {query!r}")
        return found

    def merged(self) -> Companies:
        return Companies(search.merge_companies(self.df))


class Filings(Table):
    def filter(self, **conditions) -> Filings:
        return Filings(windows.filter_filings(self.df, **conditions))

    def latest(self, count: int = 1) -> Filings:
        return Filings(self.df.orderBy(windows.filed_at().desc_nulls_last(), F.col("id").desc()).limit(count))

    def newest(self, count: int) -> Filings:
        return Filings(windows.newest_filings(self.df, count))

    def of_company(self, company_id: str) -> Filings:
        """Names the source too where the id tells it, so that only its partition is read."""
        out = self.df.where(F.col("company_id") == company_id)
        source = next((s for p, s in search.ID_SOURCES.items() if company_id.startswith(p)), None)
        return Filings(out.where(F.col("source") == source) if source and "source" in self.df.columns else out)


class Facts(Table):
    def history(self, **options) -> Facts:
        return Facts(windows.fact_history(self.df, **options))

    def codes(self, *codes: str) -> Facts:
        return Facts(self.df.where(F.col("code").isin(*codes)))

    def newest(self, periods: int) -> Facts:
        return Facts(windows.newest_values(self.df, periods))

    def quality(self) -> DataFrame:
        return derive.provenance_histogram(self.df)

    def audit(self) -> DataFrame:
        return derive.audit(self.df)

    def to_markdown(self, labels: Sequence[str]) -> DataFrame:
        """filing_id, statement_type and its table: one row for each item, one column for each label
        (end dates, as text); of several values of a label the last by seq shows."""
        cell = lambda x: F.coalesce(F.max_by(F.col("value").cast("string"), F.when(F.col("end_date").cast("string") == x, F.col("seq"))), F.lit(""))
        rows = self.df.groupBy("filing_id", "statement_type", "code").agg(F.min("seq").alias("first"), *[F.when(F.max((F.col("end_date").cast("string") == x).cast("int")) == 1, cell(x)).otherwise("").alias(f"v{i}") for i, x in enumerate(labels)])
        line = F.concat(F.lit("| "), F.concat_ws(" | ", F.replace("code", F.lit("|"), F.lit("\\|")), *[f"v{i}" for i in range(len(labels))]), F.lit(" |"))
        head = f"| Item | {' | '.join(labels)} |\n|{' --- |' * (len(labels) + 1)}\n"
        lines = F.transform(F.array_sort(F.collect_list(F.struct("first", line.alias("line")))), lambda x: x["line"])
        return rows.groupBy("filing_id", "statement_type").agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("markdown"))


class Documents(Table):
    def quality(self) -> DataFrame:
        scored = self.df.withColumn("score", documents.quality_score(F.col("markdown")))
        return scored.select("filing_id", "score", documents.quality_status(F.col("score")).alias("status"))

    def sections(self) -> DataFrame:
        return documents.sections(self.df)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best sections of each filing."""
        found = documents.bm25(self.sections(), query, ["filing_id"], ["filing_id", "section_no", "title", "start_line"], "markdown", "title")
        return windows.top_per_group(found, ["filing_id"], [F.col("score").desc(), F.col("start_line").asc()], limit)


class Lake:
    """The canonical tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @property
    def companies(self) -> Companies:
        return Companies(self._read("companies"))

    @property
    def filings(self) -> Filings:
        return Filings(self._read("filings"))

    @property
    def facts(self) -> Facts:
        return Facts(self._read("facts"))

    @property
    def documents(self) -> Documents:
        return Documents(self._read("documents"))

    def append_facts(self, facts: DataFrame) -> None:
        facts.write.mode("append").partitionBy("statement_type").parquet(f"{self.root}/facts")
