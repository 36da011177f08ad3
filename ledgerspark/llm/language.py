"""Language identification as inference of a mixture.

A document is a run of short segments, each written in one language. Segment
likelihoods come from byte trigrams; expectation-maximisation estimates the
share of each language in the document, over all segments of a batch at once.
The languages of a document are the nested set (by share) of greatest
penalised likelihood. A uniform background joins the mixture: text that no
language explains better than chance belongs to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import released, text_blocks
from .store import given_id, texts

UNKNOWN = "und"
#: Documents that the model learns from are a hash sample of about so many for each language.
TRAIN_PER_LANGUAGE = 4000
BUCKETS = 1 << 16
SEGMENT = 32
ROUNDS = 6
_STEP = 1 << 20

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams that hold a letter, and for each row its first (one more closes)."""
    fold = _FOLD[data].astype(np.uint32)
    if len(fold) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = fold[:-2] << np.uint32(16) | fold[1:-1] << np.uint32(8) | fold[2:]
    good = code != 0x202020
    for back in (1, 2):  # trigrams that run over a row's end
        edge = offsets[1:] - back
        good[edge[(edge >= 0) & (edge < len(good))]] = False
    at = np.flatnonzero(good)
    bucket = ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return bucket, np.searchsorted(at, offsets)


def learn(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log shares, and log likelihoods [language, bucket], from text and non-null lang.

    The sample is bounded by per_language; its trigrams are summed where they
    are, and at most languages x 65,536 counts reach the driver.
    """
    rows = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros(0), np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    sample = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(_STEP)) < share[F.col("lang")] * _STEP).select("lang", "text")

    @released
    def count(batches):
        for batch in batches:
            lang = batch.column("lang").cast(pa.string())
            for name in pc.unique(lang).to_pylist():
                own = batch.column("text").filter(pc.equal(lang, name))
                total = np.zeros(BUCKETS, np.int64)
                for _, _, data, offsets in text_blocks(own):
                    total += np.bincount(trigrams(data, offsets)[0], minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), BUCKETS), 0.05)
    row = np.searchsorted(languages, counted.column("lang").to_numpy())
    table[row, counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    table = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values()))
    return languages, prior, table


def mixture(weight: np.ndarray, row: np.ndarray, first: np.ndarray, allowed: np.ndarray, start: np.ndarray, rounds: int):
    """EM: shares [row, language] and log likelihood of each row, given each segment's relative likelihoods.

    row: of each segment; first: where the rows' segments begin; rows all have some.
    """
    theta = np.where(allowed, start, 0)
    theta /= np.maximum(theta.sum(axis=1, keepdims=True), 1e-300)
    size = np.diff(np.append(first, len(row)))[:, None]
    for _ in range(rounds):
        part = weight * theta[row]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        theta = np.add.reduceat(part, first, axis=0) / size
    total = np.log(np.maximum((weight * theta[row]).sum(axis=1), 1e-300))
    return theta, np.add.reduceat(total, first)


def infer(buckets: np.ndarray, first: np.ndarray, table: np.ndarray, prior: np.ndarray):
    """Shares [row, language] (the background last) of each row in its chosen set."""
    rows, n_lang = len(first) - 1, len(prior)
    theta = np.zeros((rows, n_lang + 1))
    theta[:, :n_lang] = np.exp(prior)  # what is known of a text without trigrams
    grams = np.diff(first)
    some = np.flatnonzero(grams)
    if not len(some):
        return theta
    # Segments of SEGMENT trigrams; a row's last one is shorter.
    count = -(-grams[some] // SEGMENT)
    seg_row = np.repeat(np.arange(len(some)), count)
    seg_first = np.cumsum(count) - count
    seg_at = first[some][seg_row] + (np.arange(len(seg_row)) - seg_first[seg_row]) * SEGMENT
    size = np.diff(np.append(seg_at, first[-1]))
    logs = np.empty((len(seg_row), n_lang + 1))
    for k in range(n_lang):
        logs[:, k] = np.add.reduceat(table[k][buckets], seg_at)
    logs[:, n_lang] = -size * np.log(BUCKETS)
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    start = np.full((len(some), n_lang + 1), 1 / (n_lang + 1))
    full, _ = mixture(weight, seg_row, seg_first, np.ones_like(start, bool), start, ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, chosen = np.full(len(some), -np.inf), full
    penalty = 0.5 * np.log(count + 1) + 2
    for k in range(1, n_lang + 2):
        # The set of one language needs no rounds; the nested sets start from the full estimate.
        part, value = mixture(weight, seg_row, seg_first, rank < k, full + 1e-6, 0 if k == 1 else 3)
        value = value - penalty * k
        better = value > best
        best = np.where(better, value, best)
        chosen = np.where(better[:, None], part, chosen)
    theta[some] = chosen
    return theta


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = (_FOLD[data] >= 0x61) & (data < 0x80)
    at = np.flatnonzero(plain)
    found = np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])
    for row in np.flatnonzero(~found).tolist():
        found[row] = any(c.isalpha() for c in data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, model, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, background, languages of every whole text; with
    keep all columns of docs too, which must not have these names.

    lang_pred: the learned language of the greatest share, `und` if the text is
    null or has no letter, or if nothing was learned. score: its share among
    learned languages. background: the share of text that is in no learned
    language. languages: the chosen set, by share, comma-joined. Rows are
    independent, so repeated rows repeat; a null doc_id stays null; an empty
    table gives none. One pass without a shuffle.
    """
    languages, prior, table = model
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(table), np.asarray(prior)))
    source = docs.withColumn("text", F.col("text").cast("string")) if keep else texts(docs)
    added = "lang_pred string, score double, background double, languages string"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) if keep else "doc_id long"

    @released
    def run(batches):
        table, prior = shared.value
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column("text"), 1 << 20):
                letters = has_letter(data, offsets) if len(languages) else np.zeros(high - low, bool)
                theta = infer(*trigrams(data, offsets), table, prior)
                own = theta[:, :-1]
                if len(languages):
                    total = own.sum(axis=1)
                    own = np.where(total[:, None] > 1e-9, own, np.exp(prior))
                    best = np.where(letters, own.argmax(axis=1), len(languages))
                    score = np.where(letters, own.max(axis=1) / np.maximum(own.sum(axis=1), 1e-300), 0.0)
                else:
                    best, score = np.zeros(high - low, np.int64), np.zeros(high - low)
                order = np.argsort(-own, axis=1, kind="stable")
                sets = [",".join(languages[k] for k in o if row[k] > 1e-3) for o, row in zip(order.tolist(), own)]
                new = [pa.array(names[best], pa.string()), pa.array(score), pa.array(np.where(letters, theta[:, -1], 1.0)), pa.array(sets, pa.string())]
                kept = batch.slice(low, high - low)
                old = list(kept.columns) if keep else [kept.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*(kept.schema.names if keep else ["doc_id"]), "lang_pred", "score", "background", "languages"])

    found = source.mapInArrow(run, f"{ddl}, {added}")
    return found if keep else found.withColumn("doc_id", given_id())


def held_out(doc_id="doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and more of every document, by a model
    learned from the documents that are not held out. A null doc_id has no
    remainder: such a row counts as not held out."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    found = identify(docs, learn(rows.where(~held_out()), per_language))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "background", "languages")
