"""License scan: an exact set-similarity join of text windows with templates.

The blocks of a text are all its windows of as many consecutive words as
Templates.widths gives for the template; line ends do not count. Tokens are
ordered by their frequency in the whole corpus, rare ones first. A window can
contain a share t of a template's tokens only if it has one of the template's
first |T| - ceil(t |T|) + 1 tokens (prefix filter) and if its text has enough of
the template's tokens at all (length filter). In the texts that pass, the
distinct tokens of every window are counted, so every window that meets the
threshold is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, released, span_hashes, text_blocks, word_spans
from .store import given_id, texts

# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known sentences of licences and notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-2.0-notice": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
}

#: Words of a window at least; templates of more than half as many words get windows of twice their words.
BLOCK_WORDS = 128


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NON_BLANK)
    return span_hashes(data, starts, ends)


NON_BLANK = np.ones(256, bool)
NON_BLANK[0x20] = False


def _words(text: str) -> list[str]:
    """The words of a template, by the rule for documents."""
    return "".join(c if ALNUM[min(ord(c), 255)] else " " for c in text.lower()).split()


class Templates:
    """Templates as token numbers in global order, with their prefixes and window widths."""

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[int, int]):
        self.labels = list(templates)
        hashes = [_hash(_words(t)).tolist() for t in templates.values()]
        order = {h: i for i, h in enumerate(sorted({h for own in hashes for h in own}, key=lambda h: (frequency.get(h, 0), h)))}
        self.tokens = [np.array(sorted({order[h] for h in own}), np.int64) for own in hashes]
        self.widths = [max(BLOCK_WORDS, 2 * len(own)) for own in hashes]
        self.least = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.prefix = [t[: max(0, len(t) - least + 1)] for t, least in zip(self.tokens, self.least)]
        self.vocabulary = np.array(sorted(order), np.uint64)
        self.numbers = np.array([order[h] for h in sorted(order)], np.int64)

    def find(self, places: np.ndarray, tokens: np.ndarray, row: np.ndarray, rows: int):
        """(row, template, containment) of each template that some window of a row meets, at its best window.

        places: in words, ascending, of the words that are in the vocabulary; tokens: their numbers.
        """
        for number, own in enumerate(self.tokens):
            least, width = self.least[number], self.widths[number]
            if not len(self.prefix[number]):
                continue
            rare, mine = np.zeros(len(self.numbers), bool), np.zeros(len(self.numbers), bool)
            rare[self.prefix[number]], mine[own] = True, True
            some = np.zeros(rows, bool)
            some[row[rare[tokens]]] = True
            at = np.flatnonzero(mine[tokens] & some[row])
            some = np.bincount(np.unique(row[at] * len(self.numbers) + tokens[at]) // len(self.numbers), minlength=rows) >= max(1, least)
            at = at[some[row[at]]]
            if not len(at):
                continue
            # Rows lie a window apart, so no window holds words of two.
            place = places[at] + row[at] * width
            by_token = np.lexsort((place, tokens[at]))
            before = np.full(len(at), -1)
            again = tokens[at][by_token[1:]] == tokens[at][by_token[:-1]]
            before[by_token[1:][again]] = place[by_token[:-1][again]]
            # A word is the first of its token in windows that begin after the one before it, up to itself.
            # The best window begins at some word: count there the ranges that have begun and not ended.
            begins = np.sort(np.maximum(before + 1, place - width + 1))
            shared = np.searchsorted(begins, place, "right") - np.arange(len(at))
            best = np.zeros(rows, np.int64)
            np.maximum.at(best, row[at], shared)
            for r in np.flatnonzero(best >= max(1, least)).tolist():
                yield r, number, int(best[r]) / len(own)


def _members(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(words), bool)
    return table[np.minimum(np.searchsorted(table, words), len(table) - 1)] == words


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases; first_word and last_word are
    their least and greatest start (null without one). labels adds those of
    templates that a window of the text (max(128, twice the template's words)
    consecutive words, over line ends) contains to the threshold. score is 1 with a base phrase, else the greatest containment
    of a template that was met, else 0. A null text is empty: no words, empty
    labels, score 0. Repeated rows repeat, a null doc_id stays null, an empty
    table gives no rows, further columns are not read.

    Two passes, without a shuffle of texts: token frequencies over all
    documents (a few hundred counts reach the driver, as many as templates have
    tokens), then the scan.
    """
    templates = TEMPLATES if templates is None else templates
    source = texts(docs)
    known = Templates(templates, threshold, {}).vocabulary

    @released
    def count(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                starts, ends, _ = word_spans(data, offsets, ALNUM)
                words = span_hashes(LOWER[data], starts, ends)
                total += np.bincount(np.searchsorted(known, words[_members(words, known)]), minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(total[at])], names=["token", "n"])

    counted = source.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    index = Templates(templates, threshold, {r["token"] % (1 << 64): r["n"] for r in counted})
    phrases = [(_hash(p.split()), label) for p, label in BASE.items()]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    @released
    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, data, offsets in text_blocks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets, ALNUM)
                words = span_hashes(LOWER[data], starts, ends)
                rows = high - low
                row_of = np.repeat(np.arange(rows), np.diff(first))
                n_base = np.zeros(rows, np.int64)
                least, most = np.full(rows, len(words) + 1), np.full(rows, -1)
                labels: dict[int, set[str]] = {}
                for phrase, label in phrases:
                    k = len(phrase)
                    at = np.flatnonzero(words[: max(0, len(words) - k + 1)] == phrase[0])
                    for j in range(1, k):
                        at = at[words[at + j] == phrase[j]]
                    at = at[row_of[at] == row_of[at + k - 1]]
                    row = row_of[at]
                    n_base += np.bincount(row, minlength=rows)
                    np.minimum.at(least, row, at - first[row])
                    np.maximum.at(most, row, at - first[row])
                    for r in np.unique(row).tolist():
                        labels.setdefault(r, set()).add(label)
                base = {r: sorted(x) for r, x in labels.items()}
                score = (n_base > 0).astype(float)
                hit = np.flatnonzero(_members(words, index.vocabulary))
                tokens = index.numbers[np.searchsorted(index.vocabulary, words[hit])]
                for r, number, share in index.find(hit, tokens, row_of[hit], rows):
                    labels.setdefault(r, set()).add(index.labels[number])
                    score[r] = max(score[r], share)
                none = most < 0
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, rows), pa.array(np.diff(first)), pa.array(n_base), pa.array(least, mask=none), pa.array(most, mask=none),
                    pa.array([",".join(base.get(r, ())) for r in range(rows)], pa.string()),
                    pa.array([",".join(sorted(labels.get(r, ()))) for r in range(rows)], pa.string()), pa.array(score),
                ], schema=schema)

    return source.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumn("doc_id", given_id())
