"""Token counts by rank-synchronous merging of batched pre-tokens.

Distinct pre-tokens of a block that the worker has not met before are laid into
ragged numpy arrays. In each round every sequence applies its own lowest-rank
pair, all sequences at once, until none has a pair left; the surviving symbols
are counted. A bounded cache keeps the counts of pre-tokens.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import kept_by_worker, released, text_blocks
from .merging import PairTable, merge_all
from .store import given_id, texts

CACHE_TOKENS = 500_000
#: Lower-casing goes character by character, so a final sigma has no form of its own;
#: the other two letters are newer than Python's character table.
_LOWER = (("Σ", "σ"), (chr(0xA7CB), chr(0x264)), (chr(0xA7DC), chr(0x19B)))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the others follow from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Counts tokens as the library does for a JSON file with a Split pattern, byte level and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.plain = np.array([vocabulary[c] for c in alphabet], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in alphabet], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        new = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.pairs = PairTable(left, right, np.arange(len(new)), new)
        names = sorted((t["content"] for t in spec["added_tokens"] if t.get("special")), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        # White space is only ever dropped, so the file's rule that makes it a space needs no step.
        if text.isascii():
            return self.pattern.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        for upper, lower in _LOWER:
            text = text.replace(upper, lower)
        return self.pattern.findall(text.lower())

    def merge_counts(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each token; all sequences merge in step."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.plain[data]
        end = np.cumsum(length)
        symbols[end - 1] = self.last[data[end - 1]]
        _, row = merge_all(symbols, np.repeat(np.arange(len(tokens)), length), self.pairs, every=True)
        return np.bincount(row, minlength=len(tokens))

    def count_batch(self, whole: list[str]) -> list[int]:
        out, lists = [], []
        for text in whole:
            extra = 0
            if self.special is not None and "<|" in text:
                parts = self.special.split(text)
                extra = len(parts) - 1
                found = [t for part in parts for t in self.pretokens(part)]
            else:
                found = self.pretokens(text)
            lists.append(found)
            out.append(extra)
        if len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
        fresh = list(set().union(*lists).difference(self.cache))
        for low in range(0, len(fresh), 20_000):
            part = fresh[low : low + 20_000]
            self.cache.update(zip(part, self.merge_counts(part).tolist()))
        get = self.cache.__getitem__
        return [extra + sum(map(get, found)) for extra, found in zip(out, lists)]


@kept_by_worker
def word_bpe(path: str) -> WordBPE:
    """One for each Python worker, which keeps its cache from task to task."""
    return WordBPE(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    A null text is empty: 0 bytes, 0 tokens. Rows are independent: repeated rows
    repeat, a null doc_id stays null, an empty table gives none, further columns
    are not read. One pass without a shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    @released
    def run(batches):
        model = word_bpe(path)
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, data, offsets in text_blocks(batch.column("text")):
                raw = data.tobytes()
                bounds = offsets.tolist()
                n = np.array(model.count_batch([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(bounds, bounds[1:])]), np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").withColumn("doc_id", given_id())
