"""How far the sources of a language differ in their words, in exact integers.

Shares are fixed-point: p = 1 + floor(10^9 (count + 1) / (N + V)). The sum over
all kept terms of f(p, q) = floor((p - q)^2 / q) for each ordered pair of
sources is split by how many sources have a term:

- a term of many sources is a row of a dense tile, whose absent counts are
  filled in, and numpy sums the tile for all pairs at once;
- a rare term starts from the sum in which no source has it (V times one value
  for a pair) and corrects it: once for each posting, against all sources as if
  they lacked the term (equal counts of a source are one), and once for each
  pair of postings of a term, for what that took wrongly.

Both parts are integers of the same sum, so the split changes no digit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, binary_array, ranges, released, text_blocks, word_spans
from .store import cut, texts

#: Bytes of words: letters of ASCII and every non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Share of a language's sources from which on a term is summed in dense tiles.
HEAVY_SHARE = 0.5
#: Sources of a side of a tile, postings of a share of the terms, shares of a language at least.
TILE_SOURCES, SHARE_POSTINGS, LEAST_SHARES = 1024, 1 << 17, 8
#: Numbers that a step of numpy holds, and counts that a task holds before it hands them on.
_STEP, _HELD = 1 << 18, 1 << 19


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term) for each task; sum them up.

    Words are told apart by their bytes. A task adds up its blocks, so a term
    comes from it about once for each group, however frequent it is.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def combined(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(names)

    @released
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column("text")):
                own = tally(data, offsets, batch.column("lang").slice(low, high - low), batch.column("source").slice(low, high - low))
                parts.append(own)
                held += own.num_rows
                if held >= _HELD:
                    parts = [combined(parts)]
                    held = parts[0].num_rows
                    if held >= _HELD // 2:
                        yield from parts[0].to_batches(1 << 16)
                        parts, held = [], 0
        if held:
            yield from combined(parts).to_batches(1 << 16)

    def tally(data, offsets, lang, source) -> pa.Table:
        starts, ends, first = word_spans(data, offsets, LETTERS)
        words = binary_array(LOWER[data[LETTERS[data]]], np.r_[0, np.cumsum(ends - starts)]).dictionary_encode()
        size = max(1, len(words.dictionary))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        # One entry for each document and term of it, then one for each group and term.
        entry, n = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
        row, term = entry // size, entry % size
        own = pa.table({"lang": lang.take(pa.array(row)), "source": source.take(pa.array(row)), "term": words.dictionary.take(pa.array(term)).cast(pa.string()), "n": pa.array(n), "docs": pa.array(np.ones(len(n), np.int64))})
        return combined([own])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _f(p, q):
    return (p - q) ** 2 // q


def _steps(sizes: np.ndarray, limit: int):
    """Ranges of consecutive entries whose sizes stay within the limit, one entry at least."""
    total, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, total[low] - sizes[low] + limit, "right")))
        yield low, high
        low = high


def excess(term: np.ndarray, place: np.ndarray, p: np.ndarray, heavy: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, base_a: np.ndarray, base_b: np.ndarray, start_a: int = 0, start_b: int = 0) -> np.ndarray:
    """For each pair of a source of side a and one of side b the sum over the terms of f, less f of two
    sources without the term.

    Postings: term (a number), place (of the source), p, heavy (the same for all of a term), in_a and
    in_b (whose side has the source). base: the p of a source without the term, for the sources from start on.
    """
    none = _f(base_a[:, None], base_b[None, :])
    out = np.zeros(none.shape, np.int64)

    dense = np.unique(term[heavy])
    for low in range(0, len(dense), step := max(1, _STEP // max(none.shape))):
        own = dense[low : low + step]
        at = np.flatnonzero(heavy & (term >= own[0]) & (term <= own[-1]))
        line = np.searchsorted(own, term[at])
        pa_, qb = np.tile(base_a, (len(own), 1)), np.tile(base_b, (len(own), 1))
        a, b = in_a[at], in_b[at]
        pa_[line[a], place[at[a]] - start_a] = p[at[a]]
        qb[line[b], place[at[b]] - start_b] = p[at[b]]
        for j in range(len(base_b)):
            out[:, j] += _f(pa_, qb[:, j : j + 1]).sum(axis=0)
        out -= len(own) * none

    def alone(side, start, apply):
        key = np.stack([place[side] - start, p[side]])
        pairs, n = np.unique(key, axis=1, return_counts=True)
        for low in range(0, len(n), step := max(1, _STEP // max(none.shape))):
            apply(pairs[0, low : low + step], pairs[1, low : low + step, None], n[low : low + step, None])

    a, b = np.flatnonzero(in_a & ~heavy), np.flatnonzero(in_b & ~heavy)
    alone(a, start_a, lambda at, own, n: np.add.at(out, at, n * (_f(own, base_b[None, :]) - none[at])))
    alone(b, start_b, lambda at, own, n: np.add.at(out.T, at, n * (_f(base_a[None, :], own) - none.T[at])))

    a, b = a[np.argsort(term[a], kind="stable")], b[np.argsort(term[b], kind="stable")]
    first, last = np.searchsorted(term[b], term[a], "left"), np.searchsorted(term[b], term[a], "right")
    for low, high in _steps(last - first, _STEP):
        x = np.repeat(a[low:high], (last - first)[low:high])
        y = b[ranges(first[low:high], (last - first)[low:high])]
        i, j = place[x] - start_a, place[y] - start_b
        np.add.at(out.ravel(), i * none.shape[1] + j, _f(p[x], p[y]) - _f(p[x], base_b[j]) - _f(base_a[i], p[y]) + none[i, j])
    return out


def _tile(tile_sources: int):
    """The work on a share of a language's terms, for a block of its sources and another: what it adds to
    the sums of their pairs, as lang, source, item, value."""

    def run(key: tuple, postings: pa.Table, groups: pa.Table) -> pa.Table:
        lang, share, block_a, block_b = (x.as_py() for x in key)
        groups = groups.sort_by("place")
        place, base, names = groups["place"].to_numpy(), groups["base"].to_numpy(), groups["source"]
        a, b = np.flatnonzero(place // tile_sources == block_a), np.flatnonzero(place // tile_sources == block_b)
        where = postings["place"].to_numpy()
        term = pc.dictionary_encode(postings["term"].combine_chunks()).indices.to_numpy() if len(where) else np.zeros(0, np.int64)
        heavy = postings["heavy"].to_numpy(zero_copy_only=False).astype(bool)
        side = where // tile_sources
        out = excess(term, where, postings["p"].to_numpy(), heavy, side == block_a, side == block_b, base[a], base[b], block_a * tile_sources, block_b * tile_sources)
        if share == 0:
            out += groups["kept"][0].as_py() * _f(base[a][:, None], base[b][None, :])
        told = (place[a][:, None] != place[b][None, :]) & ((out != 0) | (share == 0))
        i, j = np.nonzero(told)
        source, item = (names.take(pa.array(x)).combine_chunks() for x in (a[i], b[j]))
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": source, "item": item, "value": pa.array(out[i, j])})

    return run


def _share(n: str, total: str) -> str:
    return f"1 + cast({n} + 1 as decimal(20, 0)) * 1000000000 div cast({total} as decimal(20, 0))"


def source_divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, tile_sources: int = TILE_SOURCES, share_postings: int = SHARE_POSTINGS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language departs from the others.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; null
    texts, langs and sources are ''. A language keeps the V terms that at least
    least_docs of its documents (rows) have. With N the occurrences of kept terms,
    a share is p = 1 + floor(10^9 (count + 1) / (N + V)) and f(p, q) =
    floor((p - q)^2 / q).

    part `pair`: for each other source of the language the sum of f(p, its p) over all
    kept terms, 0 if none is kept. part `term`: for each kept term that the source has and of which its share
    exceeds the whole language's, f(p, the language's p), the first most_terms.
    Ranks run from 1 in each source and part by value, ties by item in the order of UTF-8 bytes.

    A source of a language counts even where its texts have no term; an empty
    table gives no rows. Repeated rows count as often as they stand. Further
    columns are not read. Sums of pairs are added up in decimals before they become
    longs; shares are exact up to 10^19 occurrences.

    Texts do not move. Counts are added up in each task, then by (language,
    source, term); after that one row for each source of a term moves. Terms are dealt out
    in shares, and sources in blocks of tile_sources, so a task holds a bounded
    part however many terms or sources a language has.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts(docs)  # bounds the batches
    source = docs.select(text("text"), text("lang"), text("source"))
    counted = count_terms(source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    kept = counted.select(
        "lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"), F.count("*").over(by_term).alias("sources"),
        (F.col("source") == F.min("source").over(by_term)).alias("first"),
    ).where(F.col("lang_docs") >= least_docs)
    kept = cut(kept.drop("lang_docs"), "terms")

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("postings"), F.sum(F.col("first").cast("long")).alias("new"))
    groups = source.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(own, ["lang", "source"], "left")
    by_lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("total").over(by_lang), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("new").over(by_lang), F.lit(0)).alias("kept"),
        F.coalesce(F.sum("postings").over(by_lang), F.lit(0)).alias("lang_postings"), (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("place"), F.count("*").over(by_lang).alias("of"),
    )
    groups = groups.withColumns({
        "base": F.when(F.col("kept") > 0, F.expr(_share("0", "total + kept"))).otherwise(1),
        "blocks": F.ceil(F.col("of") / tile_sources),
        "block": F.expr(f"place div {tile_sources}"),
    }).withColumn("shares", F.greatest(F.lit(LEAST_SHARES), F.ceil(F.col("lang_postings") / (share_postings * F.col("blocks")))))
    groups = cut(groups, "groups")

    posted = kept.join(groups.drop("base"), ["lang", "source"]).withColumns({"p": F.expr(_share("n", "total + kept")), "q": F.expr(_share("lang_n", "lang_total + kept"))})

    order = [F.col("value").desc(), F.col("item")]
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    terms = posted.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.select("*", ranked).where(F.col("rank") <= most_terms)

    other = F.expr("sequence(0L, blocks - 1)")
    meets = F.explode(F.array_distinct(F.concat(F.transform(other, lambda y: F.struct(F.col("block").alias("a"), y.alias("b"))), F.transform(other, lambda y: F.struct(y.alias("a"), F.col("block").alias("b"))))))
    dealt = ["lang", "share", "a", "b"]
    postings = posted.select("lang", F.expr("pmod(xxhash64(term), shares)").alias("share"), "term", "place", "p", (F.col("sources") >= HEAVY_SHARE * F.col("of")).alias("heavy"), meets.alias("meets"))
    again = groups.select(*(F.col(c).alias(c) for c in groups.columns))  # the postings hold the same columns
    sides = again.select("lang", "source", "place", "base", "kept", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"), "block", "blocks").select("lang", "share", "source", "place", "base", "kept", meets.alias("meets"))
    postings, sides = (x.select("*", "meets.a", "meets.b").drop("meets") for x in (postings, sides))
    tiles = postings.groupBy(*dealt).cogroup(sides.groupBy(*dealt)).applyInArrow(_tile(tile_sources), "lang string, source string, item string, value long")
    pairs = tiles.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20, 0)")).cast("long").alias("value")).select("*", ranked)

    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionAll(part(terms, "term"))
