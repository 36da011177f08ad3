"""Documents: quality, sections, ranked search, windows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


def quality_score(text: Column, pages: Column | None = None) -> Column:
    """0 to 100: penalties for little text, few letters, broken characters, and text on one line."""
    body = F.coalesce(text, F.lit(""))
    size = F.length(body) - F.regexp_count(body, F.lit(r"(?U)\s"))
    alnum = (F.length(body) - F.regexp_count(body, F.lit(r"[^\p{L}\p{N}]"))) / size
    broken = (F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit("")))) / size
    lines = F.size(F.filter(F.split(body, r"\R"), lambda x: F.trim(x) != ""))
    score = F.lit(100) - F.when(size < 80, 60).when(size < 300, 25).otherwise(0) - F.when(alnum < 0.35, 30).when(alnum < 0.5, 15).otherwise(0)
    score = score - F.when(broken > 0.01, 30).when(broken > 0.001, 10).otherwise(0) - F.when((size > 500) & (lines <= 2), 20).otherwise(0)
    if pages is not None:
        each = size / F.greatest(pages, F.lit(1))
        score = score - F.when(pages.isNull(), 0).when(each < 40, 55).when(each < 120, 25).otherwise(0)
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def quality_status(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 35, "degraded").otherwise("unusable")


def sections(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """filing_id, section_no, title, level, start_line, end_line, markdown.

    A section runs from its heading to the next one of its level or a higher
    one, so sections hold their children's text too. Work stays within a
    document's own row until its sections are known.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\R")
    heads = F.filter(
        F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.+?)\s*$", 1).alias("title"))),
        lambda h: (h["level"] > 0) & (h["title"] != "") & ~h["title"].rlike(r"^[\d\s.,()%€$£+-]+$") & (F.size(F.split(h["title"], r"\s+")) <= 18),
    )
    rows = documents.select("filing_id", lines.alias("lines")).withColumn("heads", heads).select("filing_id", "lines", "heads", F.posexplode("heads").alias("section_no", "head"))
    end = F.coalesce(F.array_min(F.transform(F.filter("heads", lambda h: (h["at"] > F.col("head.at")) & (h["level"] <= F.col("head.level"))), lambda h: h["at"])), F.size("lines"))
    return rows.withColumn("end", end).select(
        "filing_id", "section_no", F.col("head.title").alias("title"), F.col("head.level").alias("level"), (F.col("head.at") + 1).alias("start_line"), F.col("end").alias("end_line"),
        F.concat_ws("\n", F.slice("lines", F.col("head.at") + 1, F.col("end") - F.col("head.at"))).alias("markdown"),
    )


def find_section(sections: DataFrame, title: str) -> DataFrame:
    """The first section of each filing whose title contains the text."""
    hit = sections.where(F.contains(F.lower("title"), F.lit(title.lower())))
    return hit.withColumn("__n", F.row_number().over(Window.partitionBy("filing_id").orderBy("section_no"))).where("__n = 1").drop("__n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), 1)


def bm25(parts: DataFrame, query: str, corpus: list[str], key: list[str], text: str, title: str | None = None, k1: float = 1.5, b: float = 0.75, title_bonus: float = 1.5) -> DataFrame:
    """parts that hold a term of the query, with their score among those of their corpus (columns).

    Terms are the distinct tokens of the query. Frequencies are counted inside
    each row, so no token is exploded and one small aggregate is shuffled.
    """
    import re

    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    count = lambda t: F.size(F.filter(F.col("__tokens"), lambda x: x == F.lit(t)))
    rows = parts.withColumn("__tokens", tokens(F.coalesce(F.col(text), F.lit("")))).withColumn("__length", F.size("__tokens")).withColumn("__tf", F.array(*[count(t) for t in terms]) if terms else F.array().cast("array<int>"))
    if title:
        rows = rows.withColumn("__title", tokens(F.coalesce(F.col(title), F.lit(""))))
    rows = rows.drop("__tokens")
    marks = [f"df{i}" for i in range(len(terms))]
    grand = rows.groupBy(*corpus).agg(F.count("*").alias("__n"), F.avg("__length").alias("__avg"), *[F.count_if(F.col("__tf")[i] > 0).alias(m) for i, m in enumerate(marks)])
    hit = rows.where(F.exists("__tf", lambda x: x > 0))
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in corpus]  # a null corpus is a corpus
    grand = grand.withColumnsRenamed({c: f"__{c}" for c in corpus})
    found = hit.join(grand, same).drop(*[f"__{c}" for c in corpus]) if corpus else hit.crossJoin(F.broadcast(grand))  # one row of totals
    score = F.lit(0.0)
    for i, (term, mark) in enumerate(zip(terms, marks)):
        idf = F.log(1 + (F.col("__n") - F.col(mark) + 0.5) / (F.col(mark) + 0.5))
        tf = F.col("__tf")[i].cast("double")
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__length") / F.col("__avg")))
        score = score + F.when(tf > 0, part).otherwise(0.0)
        if title:
            score = score + F.when((tf > 0) & F.array_contains("__title", F.lit(term)), title_bonus).otherwise(0.0)  # of terms that the text has
    return found.select(*key, F.round(score, 6).alias("score"))


def text_window(text: Column, offset: int, size: int) -> tuple[Column, Column]:
    """A window of the text, and where the next one begins (null at the end)."""
    if offset < 0 or not 200 <= size <= 24000:
        raise ValueError("offset must be 0 or more, size 200 to 24,000")
    return F.substring(text, offset + 1, size), F.when(F.length(text) > offset + size, F.lit(offset + size))


def excerpt(text: Column, query: str, size: int) -> Column:
    """Text around the first place of any query term, ellipses where it is cut."""
    import re

    terms = re.findall(r"\w+", query.lower())
    low, length = F.lower(text), F.length(text)
    places = F.filter(F.array(*[F.locate(t, low) for t in terms]) if terms else F.array().cast("array<int>"), lambda p: p > 0)
    centre = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), centre - size // 3), length - size))
    body = F.substring(text, start + 1, F.lit(size))
    body = F.when(start > 0, F.concat(F.lit("…"), F.substring(body, 2, size))).otherwise(body)
    cut = F.when(start + size < length, F.concat(F.substring(body, 1, size - 1), F.lit("…"))).otherwise(body)
    return F.when(length <= size, text).otherwise(cut)
