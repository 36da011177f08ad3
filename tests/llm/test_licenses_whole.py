"""License templates over line ends: every window of a text counts, by brute force."""

import random
import textwrap

from ledgerspark.llm import licenses

from .test_texts import ALNUM, LOWER


def brute_windows(text, templates, threshold):
    words, labels, score = ALNUM.findall((text or "").translate(LOWER)), set(), 0.0
    for label, template in templates.items():
        own = licenses._words(template)
        width = max(licenses.BLOCK_WORDS, 2 * len(own))
        share = max(len(set(own) & set(words[i : i + width])) / len(set(own)) for i in range(max(1, len(words) - width + 1)))
        if share >= threshold - 1e-12:
            labels.add(label)
            score = max(score, share)
    return labels, score


def scanned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r["doc_id"]: r for r in licenses.scan_licenses(df, **options).collect()}


def test_wrapped_notices(spark):
    names = list(licenses.TEMPLATES)
    found = scanned(spark, ["# " + "\n# ".join(textwrap.wrap(licenses.TEMPLATES[k], 30)) for k in names])
    for i, name in enumerate(names):
        assert name in found[i]["labels"].split(",") and found[i]["score"] == 1.0


def test_windows_by_brute_force(spark):
    r = random.Random(3)
    filler = [f"w{i}" for i in range(50)]
    texts = [None, "", "\n"]
    for name in licenses.TEMPLATES:
        own = licenses.TEMPLATES[name].split()
        for gap in (0, 1, 2, 4, 8, 16):
            kept = [w for w in own if r.random() > 0.12]
            body = [w for x in kept for w in [x, *r.choices(filler, k=r.randint(0, gap))]]
            text = r.choices(filler, k=r.randint(0, 300)) + body + r.choices(filler, k=r.randint(0, 300))
            texts.append("".join(w + r.choice(" \n ") for w in text))
    found, some = scanned(spark, texts), 0
    for i, text in enumerate(texts):
        labels, score = brute_windows(text, licenses.TEMPLATES, 0.8)
        base = set(filter(None, found[i]["base_labels"].split(",")))
        assert set(filter(None, found[i]["labels"].split(","))) == labels | base
        assert found[i]["score"] == (1.0 if base else score)
        some += bool(labels)
    assert 10 < some < len(texts) - 10


def test_long_template(spark):
    words = [f"t{i}" for i in range(400)]
    found = scanned(spark, ["\n".join(words), "\n".join(words[:330]), "\n".join(words[:310])], templates={"whole": " ".join(words)})
    assert [found[i]["score"] for i in range(3)] == [1.0, 330 / 400, 0.0]
