"""Packed registries, the fragment index and the inverted index."""

import io
import os
import random
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerspark.operators import documents, fragments, inverted, search
from ledgerspark.sources import registries

from .test_scans import files_read


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_archive_rows(spark):
    good = packed(a__csv="h\r\n1,\"x, y\", z \n2\n,,\n".encode(), dir__txt=b"x")
    rows = [(1, good), (2, b"no zip"), (3, packed()), (4, packed(a__csv=b"a", b__CSV=b"b")), (5, packed(a__csv="h\nß,ok\n".encode("cp1252"))), (6, None), (7, good[:-30])]
    df = registries.archive_rows(spark.createDataFrame(rows, "k int, data binary"), "data", "one:0,two:1,three:2", "utf-8", 1)
    assert df.columns == ["k", "seq", "error", "one", "two", "three"]
    found = {}
    for r in df.collect():
        found.setdefault(r["k"], []).append(tuple(r)[1:])
    assert found[1] == [(0, None, "1", "x, y", "z"), (1, None, "2", None, None), (2, None, None, None, None)]
    assert 6 not in found and all(len(found[k]) == 1 and found[k][0][1] and found[k][0][2:] == (None,) * 3 for k in (2, 3, 4, 5, 7))
    assert "0" in found[3][0][1] and "2" in found[4][0][1] and "UnicodeDecodeError" in found[5][0][1]


def test_archive_rows_in_sql(spark):
    registries.register(spark)
    spark.createDataFrame([(packed(a__csv="E00001;会社\n".encode("cp932")),)], "data binary").createOrReplaceTempView("packed_lists")
    text = "select r.* from packed_lists, lateral archive_rows(data, columns => {}, encoding => 'cp932', delimiter => ';') r"
    assert [tuple(r) for r in spark.sql(text.format("'code:0,name:1'")).collect()] == [(0, None, "E00001", "会社")]
    for bad in ("'code'", "'a:0,a:1'", "'seq:0'", "'a b:0'", "concat('a:', cast(rand() as string))"):
        with pytest.raises(AnalysisException):
            spark.sql(text.format(bad)).schema


def test_a_member_may_not_unpack_to_more():
    data = packed(a__csv=b"x,y\n" * 100_000)
    assert len(list(registries.table_rows(data, "utf-8", 0, most=400_000))) == 100_000
    with pytest.raises(ValueError):
        list(registries.table_rows(data, "utf-8", 0, most=399_999))


NAMES = ["Ørsted A/S", "Jerónimo Martins", "Martin & Söhne GmbH", "株式会社 日本", "AB", "A", "", None, "Ab-Inbev", "INBEV (AB)", "mart"]


@pytest.fixture(scope="module")
def issuers(spark):
    r = random.Random(1)
    names = NAMES + ["".join(r.choice("abc é-") for _ in range(r.randint(1, 9))) for _ in range(150)]
    rows = [(f"x_{i}", n, [None, "ab", f"t{i}"][i % 3], [n[::-1], None] if n and i % 2 else None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id string, name string, ticker string, aliases array<string>").persist()


@pytest.fixture(scope="module")
def index(spark, issuers, tmp_path_factory):
    return fragments.build_fragments(issuers, str(tmp_path_factory.mktemp("index")), ["id", "ticker"], ["name", "aliases"], folders=16)


QUERIES = ["ab", "A", "abc", "martin", "jeronimo", "JERÓNIMO m", "orsted a s", "日本", "x 7", "inbev", "c a", "nothing like it", " ", "", "!?", "é"]


@pytest.mark.parametrize("query", QUERIES)
def test_fragments_rank_as_the_scan_does(index, issuers, query):
    # R1 over the same fields, aliases as columns of their own.
    flat = issuers.withColumns({"a0": F.get("aliases", F.lit(0)), "a1": F.get("aliases", F.lit(1))})
    want = sorted((r["id"], r["match_rank"]) for r in search.three_tiers(flat, query, ["id", "ticker", "name", "a0", "a1"], "name").collect())
    got = sorted((r["id"], r["match_rank"]) for r in index.search(query, identities_first=False).collect())
    assert got == want


def test_identities_and_names_have_their_own_ranks(index):
    rank = {r["id"]: r["match_rank"] for r in index.search("ab").collect()}
    assert rank["x_4"] == 0 and rank["x_8"] == 1  # by its ticker, by its name
    assert rank["x_9"] == 2  # a part of the name only
    assert [r["id"] for r in index.search("martin", limit=2).collect()] == ["x_2", "x_1"]
    assert index.search("martin").columns == ["id", "name", "ticker", "aliases", "match_rank"]


def test_no_search_reads_all_issuers(index, issuers):
    found = index.search("orsted")
    assert [r["id"] for r in found.collect()] == ["x_0"]
    plan = found._jdf.queryExecution().executedPlan()
    assert files_read(plan, "numPartitions") <= 1 + len(fragments.fragments_of("orsted")) < 16


TEXTS = ["the license of the house", "license license", "", None, "the", "nothing", "The LICENSE, the License."]


def test_inverted(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, ["en", None, "de"][i % 3], " ".join(r.choice(["the", "license", "house", "a"]) for _ in range(i % 9)) if i >= len(TEXTS) else TEXTS[i], f"T {'license' if i % 4 else 'x'}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, lang string, text string, title string").persist()
    index = inverted.open_index(spark, str(tmp_path / "i"), ["id"], ["lang"], title="title", buckets=8)
    assert index.add(docs.where("id < 20")) == 20
    # What a failed addition leaves has no corpora, and does not count.
    os.makedirs(tmp_path / "i" / "add-000001" / "postings")
    assert index.add(docs) == 40 and index.add(docs) == 0
    for query in ("the License", "house", "absent", "license a the a"):
        want = {x["id"]: x["score"] for x in documents.bm25(docs, query, ["lang"], ["id", "lang"], "text", "title").collect()}
        got = {x["id"]: (x["score"], x["lang"], x["matched_terms"]) for x in index.search(query).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k]) < 2e-6 for k in want)
    hit = {x["id"]: x for x in index.search_texts("license house", docs, snippet=200).collect()}
    assert hit[0]["snippet"] == TEXTS[0] and hit[0]["matched_terms"] == ["house", "license"]
    best = index.search_texts("license", docs, limit=3).collect()
    assert len(best) == 3 and min(x["score"] for x in best) >= sorted((x["score"] for x in index.search("license").collect()), reverse=True)[2]


def test_one_corpus_for_all(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, "")], "id int, text string")
    index = inverted.open_index(spark, str(tmp_path / "i"), ["id"], buckets=4)
    index.add(docs)
    want = {x["id"]: x["score"] for x in documents.bm25(docs, "b c", [], ["id"], "text").collect()}
    assert {x["id"]: x["score"] for x in index.search("b c").collect()} == pytest.approx(want)


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), "id")).alias("text"))
    index = inverted.open_index(spark, str(tmp_path / "i"), ["id"], buckets=32)
    index.add(docs)
    hits = index._read("postings").where(F.col("shard").isin([1, 2])).select("term")
    hits.collect()
    assert files_read(hits._jdf.queryExecution().executedPlan(), "numPartitions") == 2
    assert [x["id"] for x in index.search("w17").collect()] == [17]
