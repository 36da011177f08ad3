"""Holders, changes between filings, and eviction of whole filings, against plain forms."""

import datetime as dt
import random

import pytest

from ledgerspark.operators import changes, holdings, storage

DAY = dt.date(2024, 1, 1)
POSITIONS = "filing_id string, company_id string, holder_key string, holder_name string, position_date date, year int, seq int"


def notices(spark, rows):
    filings = spark.createDataFrame([(i, c, None, d) for i, c, d, _ in rows], "id string, company_id string, published_at timestamp, filing_date date")
    read = spark.createDataFrame([(i, name, None, d, None) for i, _, d, name in rows if name is not None], "filing_id string, holder_name string, position_date date, notified_date date, crossed_date date")
    return filings, read


def test_search_holders(spark):
    told = [("n1", "a", DAY, "BIG  Fund"), ("n2", "a", DAY + dt.timedelta(1), None), ("n3", "b", DAY + dt.timedelta(2), "other"), ("n4", "b", DAY + dt.timedelta(3), "Bíg fund")]
    held = [("p1", "c", "1", "Bíg Fund SA", dt.date(2023, 5, 1), 2023, 1), ("p1", "c", "1", "Bíg Fund SA", dt.date(2023, 6, 1), 2023, 2), ("p0", "c", "1", "big fund", dt.date(2021, 1, 1), 2021, 1), ("p9", "c", "2", None, dt.date(2024, 1, 1), 2024, 1)]
    filings, read = notices(spark, told)
    positions = spark.createDataFrame(held, POSITIONS)
    found = lambda *a, **k: [(r["filing_id"], r["position_date"] or r["notified_date"]) for r in holdings.search_holders(filings, read, positions, *a, **k).collect()]
    assert found(" big FUND ") == [("n1", DAY), ("p1", dt.date(2023, 6, 1)), ("p0", dt.date(2021, 1, 1))]
    # One holder is enough: the years before are not taken; a notice outside the newest ones is not looked at.
    assert found("big fund", scan_limit=3, limit=1) == [("p1", dt.date(2023, 6, 1))]
    assert found("  ") == [] and found(None) == [] and found("big fund", limit=0) == []
    assert holdings.search_holders(filings.limit(0), read, positions.limit(0), "big").count() == 0


def plain_years(rows, limit):
    """Years from the newest on, each whole, until limit holders of a filing are there."""
    out = {}
    for year in sorted({r[5] for r in rows}, reverse=True):
        for r in sorted((r for r in rows if r[5] == year), key=lambda r: r[6]):
            out[r[0], r[2]] = r
        if len(out) >= limit:
            break
    return out.values()


@pytest.mark.parametrize("limit", [1, 4, 50])
def test_company_holders(spark, limit):
    r = random.Random(limit)
    rows = [(f"f{r.randrange(9)}", f"c{r.randrange(3)}", str(r.randrange(6)), f"h{r.randrange(6)}", DAY + dt.timedelta(i), 2018 + r.randrange(6), i) for i in range(120)]
    filings, read = notices(spark, [(f"n{i}", "u", DAY + dt.timedelta(i // 2), f"h{i}" if i != 6 else None) for i in range(8)])
    got = {}
    for x in holdings.company_holders(filings, read, spark.createDataFrame(rows, POSITIONS).repartition(3), limit).collect():
        got.setdefault(x["company_id"], []).append((x["filing_id"], x["holder_name"], x["position_date"]))
    for c in ("c0", "c1", "c2"):
        want = sorted(((x[0], x[3], x[4]) for x in plain_years([x for x in rows if x[1] == c], limit)), key=lambda t: (t[2], t[0], t[1]), reverse=True)
        assert sorted(got[c], key=lambda t: (t[2], t[0], t[1]), reverse=True) == want[:limit]
    newest = sorted((f"n{i}" for i in range(8)), reverse=True)[:limit]
    assert sorted(t[0] for t in got["u"]) == sorted(n for n in newest if n != "n6")


FACTS = "filing_id string, statement_type string, code string, label string, value double, unit string, provenance string, confidence int, seq int"


def test_filing_changes(spark):
    r = random.Random(3)
    rows = [(f"f{r.randrange(6)}", r.choice("AB"), f"x{r.randrange(5)}", r.choice(["FY2023", "FY2024", None]), r.choice([1.0, 2.0, None]), r.choice(["EUR", None]), "p", 100, i) for i in range(400)]
    pairs = [("f0", "f1"), ("f1", "f2"), ("f1", "f2"), ("f3", "f3"), ("f4", "gone"), ("gone", "gone too")]
    items = {}
    for x in rows:  # the last of an item counts
        items.setdefault(x[0], {})[x[1:4]] = x[4:8]
    facts, asked = spark.createDataFrame(rows, FACTS).repartition(5), spark.createDataFrame(pairs, "first_id string, second_id string")
    for limit in (3, 1000):
        got = {}
        for x in changes.filing_changes(asked, facts, limit).orderBy("change_no").collect():
            got.setdefault((x["first_id"], x["second_id"]), []).append(((x["statement_type"], x["code"], x["label"]), x["first"] and tuple(x["first"]), x["second"] and tuple(x["second"]), x["truncated"]))
        for pair in set(pairs):
            a, b = (items.get(i, {}) for i in pair)
            keys = sorted((k for k in {*a, *b} if a.get(k) != b.get(k)), key=lambda k: (k[0], k[1], k[2] is not None, k[2] or ""))
            assert got.get(pair, []) == [(k, a.get(k), b.get(k), len(keys) > limit) for k in keys[:limit]]
    with pytest.raises(ValueError):
        changes.filing_changes(asked, facts, 0)
    assert changes.filing_changes(asked.limit(0), facts).count() == 0


def test_following(spark):
    rows = spark.createDataFrame([("a", "c", DAY), ("b", "c", DAY), ("d", "e", DAY), ("f", "c", None)], "id string, company_id string, filing_date date")
    assert {tuple(x) for x in changes.following(rows).collect()} == {("f", "a"), ("a", "b")}


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_eviction(spark, monkeypatch, ranges):
    monkeypatch.setattr(storage, "RANGES", ranges)
    monkeypatch.setattr(storage, "BOUND_ROWS", 40)
    r = random.Random(ranges)
    rows = [(r.randrange(30), i, r.choice([None, 0, r.randrange(100)])) for i in range(300)] + [(None, 300, 5)]
    df = spark.createDataFrame(rows, "at int, id int, size long").repartition(6)
    for budget in (-1, 0, 900, 10**6):
        total, want = 0, {}
        for x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True):
            total += x[2] or 0
            if total > budget:
                want[x[1]] = total
        assert {x["id"]: x["kept_bytes"] for x in storage.evict_to_budget(df, budget, "size", ["at", "id"]).collect()} == want
    assert storage.evict_to_budget(df.limit(0), 0, "size", ["at", "id"]).count() == 0


def test_whole_filings(spark):
    filings = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, cached_at int")
    text = spark.createDataFrame([("a", 10), ("b", 20), ("c", None), ("d", 40), ("lost", 7), (None, 3)], "filing_id string, n long")
    items = spark.createDataFrame([("b", 5), ("b", 5), ("d", 1)], "filing_id string, size int")
    gone = lambda budget, **k: {x["id"] for x in storage.evict_filings(filings, [(text, "n"), (items, "size")], budget, **k).collect()}
    # d holds 41, c nothing, b 30, a 10; 10 bytes belong to no filing.
    assert gone(91) == set() and gone(90) == {"a"} and gone(51) == {"a", "b"} and gone(50) == {"a", "b", "c", "d"}
    assert gone(91, fixed=1) == {"a"} and gone(0) == {"a", "b", "c", "d"}
    with pytest.raises(ValueError):
        gone(-1)
