"""Each stage of the pipeline against brute force on its own input."""

import pytest

import corpus_pipeline as cp

from .test_texts import brute_classes, brute_contamination, brute_repeats, sha


@pytest.fixture(scope="module")
def staged(spark, docs, sf_dir):
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
    return out


def listed(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(staged, docs):
    for df in staged[1:5]:
        assert df.columns == docs.columns


def test_language(staged, rows):
    kept = listed(staged[1])
    ids = {i for i, _ in kept}
    for r in rows[:120]:
        assert r[0] in ids
    # Rows go, not ids: of the rows without an id the one without a text goes, that with a clean one stays.
    assert (None, None) not in kept and any(i is None for i in ids) and 1001 not in ids and 1008 not in ids


def test_similar(staged):
    before, after = listed(staged[1]), listed(staged[2])
    low = lambda i: (i is not None, i or 0)
    members = {}
    for row, (_, _, component) in zip(before, brute_classes([(i, t) for i, (_, t) in enumerate(before)], 5, 75)):
        members.setdefault(component, set()).add(row)
    # A text without words is like none, but rows of one id and text are one.
    left = set(after)
    assert len(after) == len(left) < len(before) and left <= set(before)
    for own in members.values():
        (stays,) = own & left
        assert low(stays[0]) == min(low(i) for i, _ in own)


def test_passages(staged):
    before, after = listed(staged[2]), dict(listed(staged[3]))
    want = {w[0]: w for w in brute_repeats(before, 200)}
    assert len(after) == len(want)
    assert all(sha(after[k].encode()) == w[4] for k, w in want.items())
    assert any(w[2] for w in want.values())


def test_benchmark(staged, spark, sf_dir):
    before, after = listed(staged[3]), listed(staged[4])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {r for r, w in zip(before, brute_contamination(before, items, 10)) if not w[-1]}


def test_encode(staged):
    texts = dict(listed(staged[4]))
    found = staged[5].collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode()) and r["n_tokens"] == len(r["ids"])


def test_empty(spark, empty, sf_dir):
    df = empty
    for _, stage in cp.STAGES:
        df = stage(spark, df, sf_dir)
        assert df.count() == 0
