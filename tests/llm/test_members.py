"""op8: the sets of classes that are met are chosen from a table of one row a set, not from one row an n-gram."""

from ledgerspark.llm import jaccard


def test_one_row_for_each_set(spark, monkeypatch):
    seen, cut = {}, jaccard.cut

    def kept(df, name="t"):
        back = cut(df, name)
        seen[name] = [tuple(r) for r in back.collect()]
        return back

    monkeypatch.setattr(jaccard, "cut", kept)
    docs = [(i, " ".join(f"common{j}" for j in range(12)) + " " + " ".join(f"own{i}x{j}" for j in range(60 if i % 2 else 1))) for i in range(20)]
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 20 and len(seen["mixed"]) >= len(seen["members"]) == len({r[0] for r in seen["members"]})
