"""Language ID, WARC archives and vectors: held-out accuracy, round trips, brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerspark.llm import language, warc
from ledgerspark.llm.components import components
from ledgerspark.llm.vectors import near_duplicates

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 250
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(docs, rows, empty, spark):
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify_languages(docs).collect()}
    texts = {r[0]: r[1] for r in rows}
    for doc, lang in found:
        if doc is not None and doc not in (1014,):
            letters = any(c.isalpha() for c in texts[doc] or "")
            assert (lang == "und") != letters, doc
    assert language.identify_languages(docs).count() == len(rows)
    assert language.identify_languages(empty).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r[0] for r in language.identify_languages(unlabelled).select("lang_pred").distinct().collect()} == {"und"}


def test_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    text = {r["lang"]: r["t"] for r in docs.where("length(text) between 1000 and 4000").groupBy("lang").agg({"text": "min"}).toDF("lang", "t").collect()}
    both = spark.createDataFrame([(1, text["en"][:1500] + " " + text["de"][:500]), (2, "zq" * 500)], "doc_id long, text string")
    mixed, noise = language.identify(both, model).orderBy("doc_id").collect()
    assert mixed["languages"].split(",")[:2] == ["en", "de"] and 0.6 < mixed["score"] < 0.9
    assert noise["background"] > 0.5


def pages(spark):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (4, "u", "short"), (6, "u", "short"), (7, "bad\r\nX: y", None), (8, "u", ""), (None, "u", same), (10, "u", "é" * 60), (11, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 100), (3, "again", same)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")


def test_warc_round_trip(spark, tmp_path):
    rows, table = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_archives(table, path)
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).where("kind = 'record'").collect()), key=str)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        other = min((p for p, _, h in rows if h == html and p is not None), default=None) if len(body) >= 100 else None
        revisit = other is not None and page is not None and page > other
        want.append((page if page is not None else -1, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(spark, path).where("kind = 'gap'").count() == 0
    full = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, path, payloads=True).where("record_type = 'response'").collect()}
    assert full[10] == ("é" * 60).encode()
    warc.write_archives(table.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    r = random.Random(3)
    records = [warc.build_record(i, "http://x", "response", bytes(r.randrange(256) for _ in range(300)), "d", 300, None) for i in range(12)]
    parts = [warc.member(x) if packed else x for x in records]
    assert [k for k, *_ in warc.salvage(b"".join(parts))] == ["record"] * 12
    broken = bytearray(b"".join(parts))
    starts = [sum(map(len, parts[:i])) for i in range(12)]
    broken[starts[5] - 100] ^= 0xFF  # one record fails its check
    del broken[starts[9] - 160 : starts[9] - 110]  # another loses bytes
    damaged = b"JUNK" + bytes(broken[:-20])  # and the last one its end
    found = list(warc.salvage(damaged))
    assert [h["warc-page-id"] for k, _, _, h, _ in found if k == "record"] == [str(i) for i in range(11) if i not in (4, 8)]
    gaps = [(o, n) for k, o, n, *_ in found if k == "gap"]
    assert gaps[0] == (0, 4) and len(gaps) == 4 and sum(n for _, n in gaps) < 4 + 3 * max(map(len, parts))


def brute_links(rows, threshold):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    links = defaultdict(set)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
    low = lambda x: -1 if x is None else x
    out = []
    for i, (vec, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        least = min(low(rows[j][0]) for j in reach)
        out.append((vec, len(links[i]), None if least == -1 else least, low(vec) == least))
    return out


def test_vectors(spark, monkeypatch):
    from ledgerspark.llm import vectors

    monkeypatch.setattr(vectors, "SHARD_NODES", 60)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(i + 400, rows[7][1]) for i in range(5)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [float("nan")] * 16), (505, [float("inf")] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[3][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, component long, vec int")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(table).collect()}
    want = set(brute_links(rows, 0.95))
    assert len(got & want) >= 0.97 * len(want), list(want - got)[:5]
    assert near_duplicates(table.limit(0)).count() == 0


def test_vectors_tiles(spark, monkeypatch):
    from ledgerspark.llm import vectors

    monkeypatch.setattr(vectors, "MOST_NODES", 50)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.1).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(table).collect()}
    assert got == set(brute_links(rows, 0.95))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(7, 7), (None, 3)]
    got = {(x["id"], x["component"]) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {(x, root(x)) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
