"""Archives are bounded by bytes."""

import os

from ledgerspark.llm.warc import read_archives, write_archives


def test_files_by_bytes(spark, tmp_path):
    rows = [(i, f"http://a/{i}", os.urandom(600).hex()) for i in range(60)] + [(99, None, os.urandom(30000).hex()), (None, "u", None), (5, "again", "x" * 150), (6, "again", "x" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    write_archives(df, path, 8000)
    sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")]
    assert sum(s > 8001 for s in sizes) == 1 and len(sizes) > 8
    found = read_archives(spark, path, payloads=True).collect()
    assert {r["kind"] for r in found} == {"record"} and len(found) == len(rows)
    whole = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response" and r["page_id"] not in (5, 6)}
    assert all(whole[k] == (h or "").encode() for k, _, h in rows if k not in (5, 6))


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0
