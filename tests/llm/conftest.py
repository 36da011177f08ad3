import random

import duckdb
import pytest

DDL = "doc_id long, text string, lang string, source string, n_words string, spans string, component string"


def edge_texts() -> list:
    """Texts of every awkward kind: null, empty, blank, very long, repeated, cut, many scripts."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    run = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, other = run(60), run(45)
    base = run(300)
    out = [None, "", " ", "\n\t  \r\n", "x", "Ä", "😀", "12 34", "!!!", "a" * 1500, "ab" * 700, "the same line\n" * 60, base, base, base + " tail", run(2) + " " + base]
    changed = base.split()
    for step in (17, 40, 90):
        copy = list(changed)
        for i in range(0, len(copy), step):
            copy[i] = r.choice(words)
        out.append(" ".join(copy))
    for _ in range(6):
        out.append(f"{run(30)} {passage} {run(30)}")
        out.append(f"{run(10)}\n{passage}\t{run(3)}  {other} {run(5)}")
    out += [passage, other, passage[:199], passage[:200], passage[:201], run(12), run(13), run(4), run(4).upper(), run(20000), "é" * 400, "日本語 テキスト" * 50]
    out += ["Released under the MIT License. the mit license mit license", "CC BY-NC 4.0", "licensed under cc by", "This work is licensed under the GNU\nGeneral Public License, version 3.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."]
    out += ["permission is hereby granted free of charge to any person obtaining a copy of software and associated documentation files the software to deal in software without restriction"]
    out += ["I'll don't we've 're  they'd x's 'S  \n  end  ", "<|endoftext|> and <|startoftext|>", "ΣΑΣ İstanbul ǅ ﬁ"]
    return out


@pytest.fixture(scope="session")
def rows():
    own = duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 120").fetchall()
    extra = [(1000 + i, t, ["en", None][i % 2], None) for i, t in enumerate(edge_texts())]
    repeated = [extra[12], extra[12], (extra[14][0], "another text of one id " * 12, None, None), (None, extra[14][1], "en", "s"), (None, None, None, None)]
    return [(*r, "clash", "clash", "clash") for r in own + extra + repeated]


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DDL).repartition(5)
    return df.persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def benchmark(spark):
    own = [(i, t) for i, t in duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall()]
    texts = edge_texts()
    return own + [(900, None), (901, ""), (902, texts[12][40:400]), (903, "mit license"), (904, "mit license"), (None, texts[20]), (905, texts[-4].split()[0]), (906, texts[19])]
