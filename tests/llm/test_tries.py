"""Prefix trees against brute force, and the join with every way of dealing sets out."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import jaccard, tries

from .test_texts import brute_classes


def near_sets(r, families, members):
    """Sorted sets in families of different likeness; equal and empty-handed ones among them."""
    out = []
    for f in range(families):
        base = [r.randrange(1 << 40) for _ in range(r.randint(1, 60))]
        for _ in range(members):
            out.append(np.array(sorted({x if r.random() > f / (3 * families) else r.randrange(1 << 40) for x in base}), np.uint64))
    return out + [out[0]]


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_similar(percent):
    r = random.Random(percent)
    sets = near_sets(r, 12, 8)
    sizes = np.array([len(s) for s in sets])
    trie = tries.Trie(sets, sizes)
    some = 0
    for i, s in enumerate(sets):
        skip = np.array([r.random() < 0.3 for _ in sets])
        want = {j for j, o in enumerate(sets) if not skip[j] and 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o))}
        assert set(trie.similar(s, len(s), percent, skip).tolist()) == want
        some += len(want)
    assert some > len(sets) // 2


def test_classes_of_a_share():
    r = random.Random(4)
    sets = near_sets(r, 10, 9)
    rows = [(i, i, len(s), s) for i, s in enumerate(sets)]
    found = tries.link(rows, [], 75, True)
    assert len(found) < len(sets)  # a forest, not all pairs
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert root(a) != root(b)
        parent[root(a)] = root(b)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                assert root(i) == root(j)


@pytest.mark.parametrize(("classes", "held", "shares"), [(256, 2, 2), (1, 3, 1), (1, 1024, 2)])
def test_dealt_out(spark, docs, rows, monkeypatch, classes, held, shares):
    monkeypatch.setattr(jaccard, "MOST_CLASSES", classes)
    monkeypatch.setattr(jaccard, "TRIE_SETS", held)
    monkeypatch.setattr(jaccard, "FIRST_SHARES", shares)
    got = Counter(tuple(r) for r in jaccard.jaccard_classes(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(brute_classes(rows, 5, 75))


@pytest.mark.parametrize(("classes", "held"), [(256, 4000), (1, 4000), (256, 1)])
def test_dealt_by_bytes(spark, docs, rows, monkeypatch, classes, held):
    """Tries of few bytes: long sets are dealt out, and probes are looked up in portions."""
    monkeypatch.setattr(jaccard, "MOST_CLASSES", classes)
    monkeypatch.setattr(jaccard, "TRIE_BYTES", held)
    got = Counter(tuple(r) for r in jaccard.jaccard_classes(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(brute_classes(rows, 5, 75))


def test_a_trie_holds_bounded_bytes(spark):
    """A thousand sets of 20,000 n-grams meet in one share: no trie is given much more than its bytes."""
    rows = spark.range(1000).select(F.col("id"), F.lit(20000).cast("long").alias("size"), F.lit(7).alias("share"))
    held = jaccard._deal(rows, ["share"]).groupBy("salt").agg(F.sum(F.col("size") * 8).alias("bytes")).collect()
    assert len(held) == 10 and max(r["bytes"] for r in held) < 1.5 * jaccard.TRIE_BYTES
    short = jaccard._deal(rows.withColumn("size", F.lit(400).cast("long")), ["share"])
    assert {r["n"] for r in short.select("n").distinct().collect()} == {1}


def test_chains_and_hubs(spark):
    """Families whose members differ step by step, over a passage that all texts share."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    shared, rows = [r.choice(words) for _ in range(40)], []
    for _ in range(12):
        text = [r.choice(words) for _ in range(r.randint(20, 120))]
        for _ in range(9):
            rows.append((len(rows), " ".join(text + shared)))
            text[r.randrange(len(text))] = r.choice(words)
    rows += [(len(rows) + i, " ".join(shared + [w])) for i, w in enumerate(words[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(x) for x in jaccard.jaccard_classes(df).collect())
    assert got == Counter(brute_classes(rows, 5, 75))
