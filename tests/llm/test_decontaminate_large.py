"""The path of large benchmarks with neighbouring empty texts."""

from ledgerspark.llm.decontaminate import decontaminate


def test_adjacent_empty_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", "x", "", "", None, "y", None, None, "before " + item, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(map(tuple, decontaminate(docs, items).collect()))
    with_shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(tuple, decontaminate(docs, items, broadcast_bytes=0).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_shuffle)
    assert [w[1] for w in want] == [0, 0, 1, 0, 0, 0, 1, 0, 0, 12, 0]
