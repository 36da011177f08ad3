"""Stages of the pipeline decide on rows: others of the same or of no doc_id stay."""

import random

import duckdb
import pytest

import corpus_pipeline as cp

DDL = "doc_id long, text string, lang string, source string"


def listed(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def prose():
    return duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 120").fetchall()


def test_language(spark, prose, sf_dir):
    clean = [(None, *r[1:]) for r in prose[:40]] + [(7, *r[1:]) for r in prose[40:50]] + prose[50:]
    junk = [(None, None, "en", "s"), (None, "12 34", "en", "s"), (7, "!!!", None, "s")]
    found = cp.keep_known_languages(spark, spark.createDataFrame(clean + junk, DDL).repartition(3), sf_dir)
    assert listed(found) == sorted([r[:2] for r in clean], key=str)


def test_similar(spark, sf_dir):
    r = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    run = lambda: " ".join(r.choice(words) for _ in range(80))
    a, b, c, d, alone = run(), run(), run(), run(), run()
    rows = [(3, a), (5, a + " tail"), (5, alone), (None, b), (None, b + " x"), (None, c), (8, d), (8, d + " y"), (9, d + " z"), (11, ""), (11, None), (12, c + " q"), (3, a)]
    found = listed(cp.keep_one_of_similar(spark, table(spark, rows), sf_dir))
    assert len(found) == 7
    assert {(3, a), (5, alone), (None, c), (11, ""), (11, None)} <= set(found)
    assert len({(None, b), (None, b + " x")} & set(found)) == 1
    assert len({(8, d), (8, d + " y")} & set(found)) == 1


def test_benchmark(spark, sf_dir):
    item = duckdb.sql(f"select text from '{sf_dir}/benchmark.parquet' where item_id is not null and len(text) > 100 limit 1").fetchall()[0][0]
    clean = [(None, "nothing of it here"), (None, None), (4, "nor there")]
    found = cp.drop_contaminated(spark, table(spark, [*clean, (None, item), (4, "before " + item)]), sf_dir)
    assert listed(found) == sorted(clean, key=str)
