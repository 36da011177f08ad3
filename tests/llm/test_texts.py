"""Text operators against brute force, row for row."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerspark.llm import licenses
from ledgerspark.llm.byte_bpe import ByteBPE, encode_documents, load_ranks
from ledgerspark.llm.decontaminate import decontaminate
from ledgerspark.llm.jaccard import jaccard_classes
from ledgerspark.llm.phrases import remove_phrases
from ledgerspark.llm.suffix import remove_repeats
from ledgerspark.llm.token_counts import count_tokens

sha = lambda b: hashlib.sha256(b).hexdigest()
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def same(df, columns, expected):
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    want = Counter(expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_byte_bpe(docs, rows, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    want = []
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    same(encode_documents(docs, path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)
    assert encode_documents(empty, path).count() == 0
    kept = encode_documents(docs, path, keep_ids=True).where("doc_id = 1012").first()
    text = next(r[1] for r in rows if r[0] == 1012)
    assert ByteBPE(path).decode(kept["ids"]) == text.encode()
    pieces = [a + b for a, b in zip(kept["piece_offsets"], [0] * 9)]
    assert pieces[0] == 0 and list(kept["piece_offsets"]) == sorted(kept["piece_offsets"])


@pytest.mark.parametrize("text", ["abc abcabc " * 30, "ingthethe'll", "a" * 700, "x'", "'", "it's 'tis", " \n\n x  y", "１２³ ⅷ"])
def test_byte_bpe_pieces(text):
    path = P.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    assert ByteBPE(path).encode(text) == coder.encode_ordinary(text)


def test_token_counts(docs, rows, empty):
    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    want = []
    for r in rows:
        n = len(model.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    same(count_tokens(docs, path), ["doc_id", "n_bytes", "n_tokens", "over_limit"], want)
    assert count_tokens(empty, path).count() == 0


def brute_contamination(rows, items, n):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        if item is None or not words:
            continue
        k = min(n, len(words))
        for i in range(len(words) - k + 1):
            windows[k, tuple(words[i : i + k])].add(item)
    sizes = {k for k, _ in windows}
    for r in rows:
        words = ALNUM.findall((r[1] or "").translate(LOWER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if own := windows.get((k, tuple(words[i : i + k]))):
                    found |= own
                    hit.update(range(i, i + k))
        yield r[0], len(words), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, docs, rows, empty, benchmark, limit):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = list(brute_contamination(rows, benchmark, 10))
    assert sum(w[-1] for w in want) > 5
    same(decontaminate(docs, items, 10, limit), columns, want)
    assert decontaminate(empty, items, 10, limit).count() == 0
    if limit:
        assert decontaminate(docs, items.limit(0), 10).where("contaminated").count() == 0


def brute_classes(rows, n, percent):
    sets = []
    for r in rows:
        words = SPACED.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    low = lambda x: -1 if x is None else x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(low(rows[i][0])), root(low(rows[j][0]))
                parent[max(x, y)] = min(x, y)
    return [(r[0], len(s), None if root(low(r[0])) == -1 else root(low(r[0]))) for r, s in zip(rows, sets)]


def test_jaccard(docs, rows, empty):
    want = brute_classes(rows, 5, 75)
    assert len({w[2] for w in want}) < len(rows) - 8
    same(jaccard_classes(docs), ["doc_id", "n_shingles", "component_id"], want)
    assert jaccard_classes(empty).count() == 0


def brute_phrases(rows, n):
    first = {}
    low = lambda x: -1 if x is None else x
    words = [SPACED.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words):
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, low(r[0])), low(r[0]))
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < low(r[0]):
                gone.update(range(i, i + n))
        yield r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())


def brute_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        yield r[0], len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))


@pytest.mark.parametrize("deal", [4096, 2])
def test_phrases(docs, rows, empty, monkeypatch, deal):
    from ledgerspark.llm import phrases

    monkeypatch.setattr(phrases, "ROWS_PER_ANCHOR", deal)
    monkeypatch.setattr(phrases, "BROADCAST_SPANS", 0 if deal == 2 else 1 << 20)
    want = list(brute_phrases(rows, 13))
    assert sum(w[2] > 0 for w in want) > 20
    same(remove_phrases(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], want)
    assert remove_phrases(empty).count() == 0
    assert remove_phrases(docs, keep_text=True).where("sha2(kept_text, 256) <> kept_sha256").count() == 0


@pytest.mark.parametrize("deal", [4096, 2])
def test_suffix(docs, rows, empty, monkeypatch, deal):
    from ledgerspark.llm import suffix

    monkeypatch.setattr(suffix, "ROWS_PER_ANCHOR", deal)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1 << 14)
    want = list(brute_repeats(rows, 200))
    assert sum(w[2] > 0 for w in want) > 20
    same(remove_repeats(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], want)
    assert remove_repeats(empty).count() == 0


def brute_licenses(rows, templates, threshold):
    for r in rows:
        text = (r[1] or "").translate(LOWER)
        words = ALNUM.findall(text)
        starts, labels, score = [], set(), 0.0
        for phrase, label in licenses.BASE.items():
            own = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            starts += found
            labels |= {label} if found else set()
        base = sorted(labels)
        score = 1.0 if starts else 0.0
        for label, template in templates.items():
            own = licenses._words(template)
            width = max(licenses.BLOCK_WORDS, 2 * len(own))
            share = max(len(set(own) & set(words[i : i + width])) / len(set(own)) for i in range(max(1, len(words) - width + 1)))
            if share >= threshold - 1e-12:
                labels.add(label)
                score = max(score, share)
        yield r[0], len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), score


def test_licenses(docs, rows, empty):
    want = list(brute_licenses(rows, licenses.TEMPLATES, 0.8))
    assert any("mit-text" in w[6] and not w[2] for w in want)
    same(licenses.scan_licenses(docs), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], want)
    assert licenses.scan_licenses(empty).count() == 0
