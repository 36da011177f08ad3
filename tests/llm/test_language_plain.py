"""Language ID against a plain form of its method, and what it may learn from."""

import math
import zlib

import numpy as np
import pytest

from ledgerspark.llm import language as L


def plain_trigrams(text: bytes) -> list[int]:
    fold = [b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in text]
    out = []
    for a, b, c in zip(fold, fold[1:], fold[2:]):
        if (a, b, c) != (0x20, 0x20, 0x20):
            out.append(((a << 16 | b << 8 | c) * 0x9E3779B1 % (1 << 32)) >> 16)
    return out


def plain_em(weights, allowed, start, rounds):
    theta = [s if k in allowed else 0.0 for k, s in enumerate(start)]
    total = sum(theta)
    theta = [t / total for t in theta]
    for _ in range(rounds):
        new = [0.0] * len(theta)
        for w in weights:
            part = [x * t for x, t in zip(w, theta)]
            whole = max(sum(part), 1e-300)
            new = [n + p / whole / len(weights) for n, p in zip(new, part)]
        theta = new
    return theta, sum(math.log(max(sum(x * t for x, t in zip(w, theta)), 1e-300)) for w in weights)


def plain_infer(grams, table, prior):
    n = len(prior)
    if not grams:
        return [*map(math.exp, prior), 0.0]
    weights = []
    for low in range(0, len(grams), L.SEGMENT):
        part = grams[low : low + L.SEGMENT]
        logs = [sum(table[k][g] for g in part) for k in range(n)] + [-len(part) * math.log(L.BUCKETS)]
        weights.append([math.exp(x - max(logs)) for x in logs])
    full, _ = plain_em(weights, set(range(n + 1)), [1.0] * (n + 1), L.ROUNDS)
    order = sorted(range(n + 1), key=lambda k: (-full[k], k))
    best, chosen = -math.inf, full
    for k in range(1, n + 2):
        theta, value = plain_em(weights, set(order[:k]), [f + 1e-6 for f in full], 0 if k == 1 else 3)
        value -= (0.5 * math.log(len(weights) + 1) + 2) * k
        if value > best:
            best, chosen = value, theta
    return chosen


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_shares_row_by_row(labelled, docs, rows):
    languages, prior, table = L.learn(labelled)
    texts = [(r[1] or "").encode() for r in rows if len(r[1] or "") < 4000]
    by_lang = {r["lang"]: r["text"][:700].encode() for r in labelled.where("length(text) > 700 and lang is not null").dropDuplicates(["lang"]).collect()}
    texts += [b" ".join(by_lang.values()), by_lang["de"] + b" " + by_lang["fr"][:200], b"zq" * 200, "日本語 テキスト".encode() * 20]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    buckets, first = L.trigrams(data, offsets)
    theta = L.infer(buckets, first, table, prior)
    for i, text in enumerate(texts):
        grams = plain_trigrams(text)
        assert buckets[first[i] : first[i + 1]].tolist() == grams
        assert np.allclose(theta[i], plain_infer(grams, table, prior), atol=1e-6)


def test_counts_of_what_is_learned(spark):
    rows = [(1, "aaa bbb", "x"), (2, "AAA", "x"), (3, "ccc", "y"), (4, None, "y"), (5, "ddd", None)]
    languages, prior, table = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == ["x", "y"] and np.allclose(np.exp(prior), [2 / 3, 1 / 3])
    for k, texts in enumerate((["aaa bbb", "AAA"], ["ccc"])):
        want = np.full(L.BUCKETS, 0.05)
        for t in texts:
            np.add.at(want, plain_trigrams(t.encode()), 1)
        assert np.allclose(table[k], np.log(want / want.sum()))


def test_held_out_rows_teach_nothing(spark, labelled):
    remainder = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in labelled.select("doc_id").collect()}
    found = {r["doc_id"]: tuple(r) for r in L.identify_languages(labelled).collect()}
    assert all(found[k][1] == (v == 1) for k, v in remainder.items())
    # Other labels on held-out rows, or none, change no row of the result.
    changed = labelled.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'zz' else lang end lang")
    assert {r["doc_id"]: tuple(r) for r in L.identify_languages(changed).collect()} == found
    # Ids decide what is learned, never what is predicted: any order and source give the same.
    shuffled = labelled.selectExpr("'s' source", "lang", "text", "doc_id").repartition(7)
    assert {r["doc_id"]: tuple(r) for r in L.identify_languages(shuffled).collect()} == found


def test_ties_take_the_first_language(spark):
    rows = [(i, "aaa bbb ccc", k) for i, k in enumerate(["x", "y"] * 10)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = L.identify(spark.createDataFrame([(1, "aaa bbb ccc"), (1, "aaa bbb ccc")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in found] == ["x", "x"]
