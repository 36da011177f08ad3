"""Infilling, exact duplicates and divergence of sources against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerspark.llm import recipes
from ledgerspark.llm.divergence import excess, source_divergence
from ledgerspark.llm.infill import UNITS, count_units, fill_in_middle, infill, restored
from ledgerspark.llm.recipes import chunk_ends, exact_duplicates

from .conftest import DDL
from .test_texts import LOWER, same, sha

MARKED = [("a <P> b",), ("<S>",), ("x<M>",), ("<P",), ("< P > and <S",), ("P><S",)]


def test_infill(spark, docs, rows, empty):
    more = spark.createDataFrame([(5000 + i, t, None, None, None, None, None) for i, (t,) in enumerate(MARKED)], DDL)
    own = rows + [(5000 + i, t) for i, (t,) in enumerate(MARKED)]
    want = []
    for r in own:
        text, units = r[1] or "", re.findall(UNITS, r[1] or "")
        n = len(units)
        h = [int(hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((r[0], n, "plain", text, None, None, text))
        elif h[3] % 100 < 20:
            want.append((r[0], n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m), text))
        else:
            want.append((r[0], n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m), text))
    assert {w[2] for w in want} == {"plain", "psm", "spm"} and any(w[4] == 0 for w in want)
    found = fill_in_middle(docs.unionAll(more)).withColumn("text", restored())
    same(found, ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars", "text"], want)
    assert fill_in_middle(empty).count() == 0


def test_infill_keeps_no_units():
    import tracemalloc

    text = "ab, " * 500_000
    tracemalloc.start()
    n, form, output, a, b = infill(text, 3, percent=100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_500_000 and form != "plain"
    assert peak < 4 * len(text)  # the parts and the output; units would be 70 bytes each
    assert count_units(iter(())) == 0


def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(-1 if r[0] is None else r[0])
    for text, ids in groups.items():
        for i in ids:
            yield (None if i < 0 else i, None if max(ids) < 0 else max(ids), len(ids), sha(text.encode()))


@pytest.mark.parametrize("size", [16, 1])
def test_exact(docs, rows, empty, size):
    # One byte of digest: nearly all digests stand for several chunks, which are then spelled out.
    found = exact_duplicates(docs.selectExpr("*", "sha2(coalesce(text, ''), 256) as rest", "0 as tk", "1 as recipe"), carry=["rest", "component"], digest_bytes=size).persist()
    want = list(brute_copies(rows))
    same(found.select("doc_id", "keep_id", "group_size", "rest.rest"), ["doc_id", "keep_id", "group_size", "rest"], want)
    kept = found.where("kept").select("doc_id", "keep_id", "rest.rest").collect()
    assert sorted(r["rest"] for r in kept) == sorted({w[3] for w in want}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_duplicates(empty).count() == 0


def test_exact_spells_all_out(docs, rows, monkeypatch):
    monkeypatch.setattr(recipes, "MOST_SPELLED", 3)
    monkeypatch.setattr("ledgerspark.llm.copies.BROADCAST_BYTES", 0)
    monkeypatch.setattr(recipes, "BROADCAST_BYTES", 0)
    same(exact_duplicates(docs, digest_bytes=1), ["doc_id", "keep_id", "group_size"], [w[:3] for w in brute_copies(rows)])


def test_chunks_follow_the_text():
    r = np.random.default_rng(3)
    text, before = (r.integers(0, 256, n, np.uint8) for n in (2_500_000, 999_983))
    ends = lambda *parts: [(start, own) for start, own in chunk_ends(np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])])]
    ((_, alone),) = ends(text)
    (_, _), (start, beside), (_, _) = ends(before, text, before)
    assert [e - start for e in beside] == alone and alone[-1] == len(text)
    sizes = np.diff([0, *alone])
    assert sizes.max() <= recipes.MOST_CHUNK and sizes[:-1].min() >= recipes.LEAST_CHUNK and 500 < sizes.mean() < 3000
    # A byte in the middle changes few chunks: the cuts meet again.
    changed = text.copy()
    changed[1_000_000] ^= 1
    ((_, other),) = ends(changed)
    assert len(set(alone) ^ set(other)) < 12
    ((_, zeros),) = ends(np.zeros(20_000, np.uint8))
    assert zeros[-1] == 20_000
    assert list(chunk_ends(np.zeros(0, np.uint8), np.array([0, 0, 0]))) == [(0, []), (0, [])]


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least=3, most=200):
    counts, has, groups = Counter(), Counter(), set()
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        words = LETTERS.findall((r[1] or "").translate(LOWER))
        for w in words:
            counts[lang, source, w] += 1
        for w in set(words):
            has[lang, w] += 1
    for lang in {g[0] for g in groups}:
        terms = [t for (x, t), n in has.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s, t] for t in terms) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s, t] + 1) // (total[s] + len(terms)) for t in terms} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 1) // (sum(total.values()) + len(terms)) for t in terms}
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in terms if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:most])):
                yield from ((lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found))


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence(spark, docs, rows, empty):
    # Languages of one source, without terms, with ties of values, and many sources that share little.
    r = random.Random(2)
    some = ["".join(r.choice("abcé") for _ in range(r.randint(1, 3))) for _ in range(40)]
    more = [(i, " ".join(r.choice(some) + "  Tie9tie" for _ in range(r.randint(0, 30))), "xx", f"s{i % 23}", None, None, None) for i in range(160)]
    more += [(900, "12 34", "none", "a", None, None, None), (901, None, "none", "b", None, None, None), (902, "one one", "few", "", None, None, None)]
    want = list(brute_divergence(rows + more))
    assert any(w[4] == 0 and w[0] == "none" for w in want) and {w[2] for w in want} == {"pair", "term"}
    same(source_divergence(docs.unionAll(spark.createDataFrame(more, DDL))), COLUMNS, want)
    assert source_divergence(empty).count() == 0


def test_divergence_in_blocks(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) for _ in range(12)), r.choice(["en", "de", None]), r.choice("tuvwxyz"), None, None, None) for i in range(90)]
    same(source_divergence(spark.createDataFrame(rows, DDL), most_terms=5, tile_sources=3, share_postings=50), COLUMNS, list(brute_divergence(rows, most=5)))


@pytest.mark.parametrize("heavy_from", [0, 3, 99])
def test_excess_is_the_same_however_it_is_split(heavy_from):
    r = np.random.default_rng(heavy_from)
    terms, a, b = 60, 5, 4
    has = r.random((terms, a + b)) < 0.4
    p = r.integers(1, 10**9, (terms, a + b))
    base = r.integers(1, 1000, a + b)
    term, place = np.nonzero(has)
    filled = np.where(has, p, base)
    f = lambda x, y: (x - y) ** 2 // y
    want = f(filled[:, :a, None], filled[:, None, a:]).sum(0) - terms * f(base[:a, None], base[None, a:])
    heavy = has.sum(1)[term] >= heavy_from
    got = excess(term, place, p[has], heavy, place < a, place >= a, base[:a], base[a:], 0, a)
    assert (got == want).all()
