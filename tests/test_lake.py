"""Versioned tables, cascades and extraction that happens once."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import versions
from ledgerspark.operators.cascade import Reference, cascade, cascade_counts, order
from ledgerspark.operators.extraction import Extracted, Extractor
from ledgerspark.operators.versions import Conflict, VersionedTable

DDL = "id long, v string, year int, seq int"


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def folders(path):
    return sorted(os.listdir(path / "data")) if (path / "data").exists() else []


@pytest.fixture
def lake(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), ["id"], part_by="year")


def test_upsert_rewrites_its_parts_only(spark, lake):
    rows = [(i, "old", 2000 + i % 6, 0) for i in range(30)]
    assert lake.upsert(spark.createDataFrame(rows, DDL)) == 1
    before = lake.manifest()
    new = [(i, "new", 2000 + i % 6, s) for i in range(60) for s in (1, 2) if i % 6 < 3 and i % 2]
    assert lake.upsert(spark.createDataFrame(new, DDL).selectExpr("seq", "year", "v", "id")) == 2
    after = lake.manifest()
    assert {p for p in after.partitions if before.partitions.get(p) != after.partitions[p]} == {"2001"}
    want = {r[0]: r for r in rows} | {r[0]: r for r in new}
    assert listed(lake.read()) == sorted(want.values()) and lake.read().columns == ["id", "v", "year", "seq"]
    assert listed(lake.read(1)) == rows
    with pytest.raises(ValueError):
        lake.read(3)
    with pytest.raises(ValueError):
        lake.upsert(spark.createDataFrame([(1,)], "id long"))


def test_a_failed_write_leaves_the_version_before(spark, lake, tmp_path):
    rows = spark.createDataFrame([(i, "a", 2000, 0) for i in range(10)], DDL)
    lake.upsert(rows, {"s": "2024-01-01"})
    broken = rows.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("b"))
    with pytest.raises(Exception, match="no"):
        lake.upsert(broken, {"s": "2024-02-01"})
    assert lake.versions() == [1] and listed(lake.read()) == listed(rows) and lake.watermark("s") == "2024-01-01"
    os.makedirs(tmp_path / "t" / "data" / "left")
    assert lake.vacuum() == 1
    assert len(folders(tmp_path / "t")) == 1 and listed(lake.read()) == listed(rows)


def test_watermarks_and_versions(spark, lake):
    assert lake.watermark("a") is None and lake.manifest() is None
    with pytest.raises(ValueError):
        lake.read()
    none = spark.createDataFrame([], DDL)
    lake.upsert(none, {"a": "2024-05-01", "b": "1"})
    assert lake.read().count() == 0
    lake.upsert(none, {"a": "2024-03-01"})
    assert lake.watermark("a") == "2024-05-01" and lake.watermark("b") == "1" and lake.watermark("c") is None
    newer = lake.manifest().__dict__ | {"version": 3, "schema_version": versions.SCHEMA_VERSION + 1}
    with open(f"{lake.path}/versions/{3:010d}.json", "w") as f:
        json.dump(newer, f)
    with pytest.raises(ValueError, match="schema"):
        lake.read()


def test_of_two_writers_one_is_told(spark, lake, monkeypatch):
    lake.upsert(spark.createDataFrame([(1, "a", 2000, 0)], DDL))
    other = VersionedTable(spark, lake.path, ["id"], part_by="year")
    write = other._write

    def late(rows):
        out = write(rows)
        lake.upsert(spark.createDataFrame([(1, "first", 2000, 0)], DDL))
        return out

    monkeypatch.setattr(other, "_write", late)
    with pytest.raises(Conflict):
        other.upsert(spark.createDataFrame([(1, "second", 2000, 0)], DDL))
    assert listed(lake.read()) == [(1, "first", 2000, 0)] and lake.versions() == [1, 2]
    assert not [n for n in os.listdir(f"{lake.path}/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_append_delete_vacuum(spark, tmp_path):
    lake = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=8)
    rows = [(i, None if i % 3 else "x", None if i % 2 else 1, i) for i in range(100)]
    lake.append(spark.createDataFrame(rows[:60], DDL))
    lake.append(spark.createDataFrame(rows[60:], DDL))
    assert listed(lake.read().select("id", "seq")) == [(i, i) for i in range(100)]
    old = lake.manifest().partitions
    lake.delete(spark.createDataFrame([(5,), (5,), (999,)], "id long"))
    assert listed(lake.read().select("id")) == [(i,) for i in range(100) if i != 5]
    assert sum(old[p] != lake.manifest().partitions.get(p) for p in old) == 1
    lake.delete(spark.createDataFrame([(999,)], "id long"))
    lake.delete(spark.range(100))
    assert lake.read().count() == 0 and lake.versions() == [1, 2, 3, 4, 5]
    assert lake.vacuum(keep=1) > 0 and lake.versions() == [5] and lake.read().count() == 0


def test_null_and_odd_parts(spark, lake):
    odd = VersionedTable(spark, lake.path + "-odd", ["id"], part_by="v")
    rows = [(1, None, 1, 0), (2, "a/b c=ü", 1, 0), (3, "none", 1, 0)]
    odd.upsert(spark.createDataFrame(rows, DDL))
    odd.upsert(spark.createDataFrame([(1, None, 2, 1)], DDL))
    assert listed(odd.read().select("id", "year")) == [(1, 2), (2, 1), (3, 1)]


def test_cascade(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a int")
    b = spark.createDataFrame([(10, 1), (20, 2), (30, None), (40, 9)], "b int, a int")
    c = spark.createDataFrame([(1, 10, 20), (2, 30, 10), (3, 20, 30), (4, None, None), (4, 10, 10)], "c int, b int, other int")
    e = spark.createDataFrame([(5,)], "x int")
    refs = (Reference("a", "a", "b", "a"), Reference("b", "b", "c", "b"), Reference("b", "b", "c", "other"), Reference("nowhere", "x", "c", "c"))
    result = cascade({"c": c, "a": a, "e": e, "b": b}, refs, "a", spark.createDataFrame([(1,), (1,), (7,)], "a int"))
    assert listed(result["a"][1]) == [(1,)] and listed(result["b"][1]) == [(10, 1)]
    assert sorted(r["c"] for r in result["c"][1].collect()) == [1, 2, 4] and sorted(str(tuple(r)) for r in result["c"][0].collect()) == ["(3, 20, 30)", "(4, None, None)"]
    assert {r["table_name"]: (r["n_kept"], r["n_removed"]) for r in cascade_counts(result).collect()} == {"a": (3, 1), "b": (3, 1), "c": (2, 3), "e": (1, 0)}
    plan = result["c"][1]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    with pytest.raises(ValueError):
        order(["a", "b"], (Reference("a", "x", "b", "x"), Reference("b", "x", "a", "x")))


def test_extraction_happens_once(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def run(contents):
        def own(batches):
            for b in batches:
                counter.add(b.num_rows)
                yield b

        return contents.mapInArrow(own, contents.schema).where("content <> 'empty'").select("sha256", F.length("content").alias("n"))

    store = Extracted(VersionedTable(spark, str(tmp_path / "r"), ["sha256"], 4), VersionedTable(spark, str(tmp_path / "s"), ["sha256"], 4))
    docs = spark.createDataFrame([(i, ["aa", "b", "empty", None][i % 4]) for i in range(20)], "filing_id int, content string")
    first = Extractor("n", "1", run)
    assert store.extract(docs, first) == 3 and counter.value == 3
    assert store.extract(docs, first) == 0 and counter.value == 3
    more = docs.unionAll(spark.createDataFrame([(99, "ccc")], docs.schema))
    assert store.extract(more, first) == 1 and counter.value == 4
    assert listed(store.of(more, first).select("filing_id", "n")) == sorted([(i, 2) for i in range(0, 20, 4)] + [(i, 1) for i in range(1, 20, 4)] + [(99, 3)])
    # Another version is another extractor.
    assert store.extract(docs, Extractor("n", "2", run)) == 3 and counter.value == 7


def test_an_attempt_that_ended_between_does_not_count(spark, tmp_path, monkeypatch):
    store = Extracted(VersionedTable(spark, str(tmp_path / "r"), ["sha256"], 4), VersionedTable(spark, str(tmp_path / "s"), ["sha256"], 4))
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "filing_id int, content string")
    n = Extractor("n", "1", lambda c: c.select("sha256", F.length("content").alias("n")))
    with monkeypatch.context() as m:
        m.setattr(store.seen, "append", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.extract(docs, n)
    assert store.extract(docs, n) == 2
    assert listed(store.of(docs, n).select("filing_id", "n")) == [(1, 1), (2, 2)]


def test_commits_from_threads(spark, tmp_path):
    lake = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=2)
    told = []

    def work(i):
        for _ in range(20):
            try:
                VersionedTable(spark, lake.path, ["id"], parts=2).append(spark.createDataFrame([(i, "a", 1, 0)], DDL))
                return
            except Conflict:
                told.append(i)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert listed(lake.read().select("id")) == [(0,), (1,), (2,)]
