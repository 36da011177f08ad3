"""Phrase automata and merged suffix shards in small pieces: chunks that cut anchors, several automata, batches that cut ranges."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerspark.llm import phrases, suffix

from .test_texts import brute_phrases, brute_repeats


def pieces_of(r, n_pieces):
    words = [b"%d" % i for i in range(6)]
    return [[r.choice(words) for _ in range(r.randint(1, 14))] for _ in range(n_pieces)], np.array(sorted(r.randrange(20) for _ in range(n_pieces)))


def brute_locate(pieces, doc, n, earlier):
    first = dict(earlier)
    for p, d in zip(pieces, doc.tolist()):
        for i in range(len(p) - n + 1):
            key = b" ".join(p[i : i + n])
            first[key] = min(first.get(key, d), d)
    return {(k, i) for k, (p, d) in enumerate(zip(pieces, doc.tolist())) for i in range(len(p) - n + 1) if first[b" ".join(p[i : i + n])] < d}


@pytest.mark.parametrize("seed", range(5))
def test_located_phrases(seed):
    r = random.Random(seed)
    pieces, doc = pieces_of(r, 60)
    earlier = phrases._phrases_of(pieces[:5], [-1] * 5, 4, {})
    earlier = {k: v[0] for k, v in earlier.items()}
    for known in ({}, earlier):
        piece, at = phrases._locate(pieces, doc, 4, known)
        found = set(zip(piece.tolist(), at.tolist()))
        assert found == brute_locate(pieces, doc, 4, known) and found


def test_the_automaton_decides(monkeypatch):
    pieces, doc = pieces_of(random.Random(1), 60)
    monkeypatch.setattr(phrases, "_compile", lambda found: phrases.ahocorasick.Automaton(phrases.ahocorasick.STORE_INTS, phrases.ahocorasick.KEY_SEQUENCE))
    with pytest.raises(AttributeError):  # an empty automaton finds nothing
        phrases._locate(pieces, doc, 4, {})


@pytest.mark.parametrize(("chunk", "per_anchor", "most"), [(3, 4096, 1 << 16), (8192, 2, 5), (2, 3, 7)])
def test_chunks_and_automata(spark, docs, rows, monkeypatch, chunk, per_anchor, most):
    monkeypatch.setattr(phrases, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(phrases, "ROWS_PER_ANCHOR", per_anchor)
    monkeypatch.setattr(phrases, "PHRASES", most)
    got = Counter(tuple(x) for x in phrases.remove_phrases(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == Counter(brute_phrases(rows, 13))


def test_repeated_rows_have_spans_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] + [(2, "x " + text)] * 30 + [(3, text)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    source = phrases.keyed(df)
    most = phrases.with_spans(source, phrases.find_spans(source, 13)).selectExpr("max(size(spans)) n").first()["n"]
    assert most <= 60
    assert Counter(tuple(x) for x in phrases.remove_phrases(df).collect()) == Counter(brute_phrases(rows, 13))
    assert Counter(tuple(x) for x in suffix.remove_repeats(df).collect()) == Counter(brute_repeats(rows, 200))


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_merged_shards(size):
    r = random.Random(size)
    windows = sorted(bytes(r.choices(b"\x00\x7f\x80", k=3)) for _ in range(40)) + [b"\xff\xff\xff"] * 9 + [b"\xff\xff\xff\xff"]
    lo = np.arange(len(windows))
    hi = np.array([a if r.random() < 0.3 else a + 200 for a in lo])
    table = pa.table({"doc_id": lo, "rk": lo, "lo": lo, "hi": hi, "window": pa.array(windows, pa.binary())})
    found = [x for b in suffix._merge_shards(iter(table.to_batches(max_chunksize=size))) for x in b.column("lo").to_pylist()]
    count = Counter(windows)
    assert sorted(found) == [i for i, w in enumerate(windows) if count[w] > 1 and hi[i] > i]
