"""N-gram Jaccard join with prefix trees.

N-grams have one global order: those that occur in one document only come
first, the most frequent last. Two sets of the wanted similarity share one of
their first |S| - ceil(t |S|) + 1 n-grams, so sets that share none never meet;
n-grams of one document are not even sent. Equal sets are one node.

Similar sets are found in tries (see tries.py): the sets of a share lie in a
trie along the global order; a probe goes down all of it at once, shares the
overlap of common paths, and leaves subtrees in which the remaining lengths
cannot reach the need.

A set is not sent for each of its n-grams. First it goes to the shares of two
of them, chosen by hash, where near copies meet; that joins most of what
belongs together. Of n-grams that then still hold several classes, a set goes
once to the trie of each other class that it meets, from the smaller class to
the larger; where an n-gram holds very many classes, its sets go to the tries
of that n-gram instead. So every pair of classes that can be similar is
compared, and no row is made for a pair of sets within a class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .copies import collapse, keyed
from .kernels import LOWER, NON_SPACE, gram_hashes, released, span_hashes, text_blocks, window_rows, word_spans
from .repeats import Repeats, find_repeats
from .store import cut, drop, given_id, shards
from .tries import link

#: Sets in one trie, and bytes of their n-grams; a share of more is dealt to several. A trie takes about seven
#: times the bytes of its sets.
TRIE_SETS, TRIE_BYTES = 1024, 16 << 20
#: Shares that every set goes to in the first round.
FIRST_SHARES = 2
#: Classes of one n-gram up to which a set goes to the trie of each.
MOST_CLASSES = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text's whole sequence is one n-gram."""
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    words = span_hashes(LOWER[data], starts, ends)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(words[:0])
    return out


def in_order(tokens: np.ndarray, repeats: Repeats) -> np.ndarray:
    """The n-grams that other documents may have too, in global order. All others stand before them."""
    level = repeats.level(tokens) + repeats.hot_count(tokens)
    order = np.lexsort((tokens, level))
    return tokens[order[np.searchsorted(level[order], 1) :]]


def _deal(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with n, the tries that the sets of a key are dealt to, and salt, the one of this set. Rows have the
    size of their set, of which every n-gram may be sent."""
    full = F.greatest(F.count("*") / F.lit(TRIE_SETS), F.sum("size") * 8 / F.lit(TRIE_BYTES))
    many = rows.groupBy(*key).agg(F.ceil(full).cast("int").alias("n")).where("n > 1")
    return rows.join(many, key, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))


#: Columns of a set in a share: the share's names, kind 0 (stored), 1 (probe) or 2 (both), and the set.
_ROW = ["share", "salt", "other", "kind", "id", "class", "size", "tokens"]


def _search(rows: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (a, b) that the tries of all shares give. rows: share, salt, other, kind, node, id, class."""
    rows = rows.join(sets.select("node", "size", "tokens"), "node").select(*_ROW)
    rows = rows.repartition(parts, "share", "salt", "other").sortWithinPartitions("share", "salt", "other", "kind")

    @released
    def run(batches):
        key, stored, probes, held = None, [], [], 0

        def flush():
            both = bool(stored) and not probes
            found = link(stored, probes, percent, both) if stored and (both and len(stored) > 1 or probes) else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("share", "salt", "other", "kind", "id", "class", "size")]
            for *share, kind, own, known, n, blob in zip(*names, batch.column("tokens")):
                if share != key or len(probes) >= TRIE_SETS or held >= TRIE_BYTES:
                    if stored:
                        yield flush()
                    probes, held = [], 0
                    if share != key:
                        key, stored = share, []
                # A copy: the batch's buffer must not outlive the batch.
                row = (own, known, n, np.frombuffer(blob.as_buffer(), np.uint64).copy())
                (probes if kind == 1 else stored).append(row)
                held += row[3].nbytes if kind == 1 else 0
        if stored:
            yield flush()

    # Few links come of many tasks: they are gathered, so that the next table has few files.
    return rows.mapInArrow(run, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are what ASCII white space separates, after lower-casing A-Z. A set is
    the distinct n-word shingles; of fewer words, the whole sequence; of none,
    empty and linked with nothing. Documents link when 100 * intersection >=
    percent * union. component_id: the least doc_id that links reach. Null texts
    are empty. Rows of one doc_id are one node of the links; a null doc_id is
    such an id and stays null. An empty table gives no rows; further columns are
    not read.
    """
    source = keyed(docs)

    def fingerprints(data, offsets):
        return np.concatenate([np.zeros(0, np.uint64), *shingle_sets(data, offsets, n)])

    # Equal texts count once: what only they share is not repeated.
    repeats = source.sparkSession.sparkContext.broadcast(find_repeats(collapse(source)[0], fingerprints, 1 / 6.5))
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("node", pa.binary()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])

    @released
    def build(batches):
        found, given = repeats.value, set()
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, data, offsets in text_blocks(batch.column("text")):
                size, node, prefix, tokens = [], [], [], []
                for own in shingle_sets(data, offsets, n):
                    name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    size.append(len(own))
                    node.append(name)
                    shared, most = own[:0], len(own) - -(-percent * len(own) // 100)
                    if name not in given:  # a set goes on once from a task
                        shared = in_order(own, found)
                    met = shared[: max(0, most + 1 - (len(own) - len(shared)))]
                    prefix.append(met.view(np.int64) if len(met) else None)
                    tokens.append(shared.tobytes() if len(met) else None)
                    if len(met) and len(given) < 1 << 16:
                        given.add(name)
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(prefix, schema.field("prefix").type), pa.array(tokens, pa.binary())], schema=schema)

    table = cut(source.select("doc_id", "text").mapInArrow(build, "doc_id long, size long, node binary, prefix array<long>, tokens binary"), "table")
    least = table.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    sets = table.where("tokens is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"))
    sets = cut(sets.join(least, "node"), "sets")
    # The least doc_id of equal sets stands for them.
    equal = table.where("size > 0").select("node", "doc_id").join(least, "node").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    classes = class_links(sets, equal, shards(source, 8, 16), percent)
    drop(sets)
    out = table.select("doc_id", "size").join(classes, F.col("doc_id") == F.col("id"), "left")
    return out.select(given_id(), F.col("size").alias("n_shingles"), F.when(F.coalesce("component", "doc_id") != F.lit(-(1 << 63)), F.coalesce("component", "doc_id")).alias("component_id"))


def class_links(sets: DataFrame, equal: DataFrame, parts: int, percent: int) -> DataFrame:
    """id, component of the documents that have links; equal: links (a, b) that are known.
    sets: node, id (the document that stands for it), size, prefix, tokens."""
    picks = [F.array_min(F.transform("prefix", lambda g, i=i: F.xxhash64(g, F.lit(i)))) for i in range(FIRST_SHARES)]
    shares = _deal(sets.select("node", "id", "size", F.explode(F.array_distinct(F.array(*picks))).alias("share")), ["share"])
    first = shares.select("share", "salt", F.lit(0).alias("other"), F.lit(2).alias("kind"), "node", "id", F.col("id").alias("class"))
    known = cut(components(cut(_search(first, sets, parts, percent), "links").unionAll(equal)), "classes")
    # N-grams that still hold several classes.
    entries = sets.select("node", "id", "size", F.explode("prefix").alias("gram")).join(known.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    entries = cut(entries, "entries")
    mixed = entries.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("gram")
    mixed = cut(entries.join(mixed, "gram", "left_semi"), "mixed")
    # One row for each set from here on: a table, lest the joins below be made on its n-grams' rows.
    members = cut(mixed.select("node", "id", "size", "class").distinct(), "members")
    weight = members.groupBy("class").agg(F.count("*").alias("weight"))
    held = mixed.groupBy("gram", "class").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).join(weight, "class")
    held = cut(held, "held")
    drop(entries)
    count = held.groupBy("gram").agg(F.count("*").alias("k"))
    light, heavy = count.where(F.col("k") <= MOST_CLASSES).select("gram"), count.where(F.col("k") > MOST_CLASSES).select("gram")
    # A set and another, larger class that has its n-gram: it goes to the trie of that class, once.
    light_held = held.join(light, "gram", "left_semi")
    mine = mixed.join(light_held.select("gram", "class", "weight"), ["gram", "class"])
    other = light_held.select("gram", F.col("class").alias("share"), F.col("weight").alias("most"), "lo", "hi")
    meet = mine.join(other, "gram").where("weight < most or (weight = most and class < share)").where(f"100 * size >= {percent} * lo and 100 * hi >= {percent} * size")
    meet = cut(meet.select("node", "id", "class", "share").distinct(), "meet")
    stored = members.join(meet.select(F.col("share").alias("class")).distinct(), "class", "left_semi")
    stored = _deal(stored.withColumn("share", F.col("class")), ["share"])
    tries = stored.select("share", "n").distinct()
    probes = meet.join(tries, "share").select("share", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("other"), F.lit(1).alias("kind"), "node", "id", "class")
    rows = stored.select("share", "salt", F.lit(0).alias("other"), F.lit(0).alias("kind"), "node", "id", "class").unionAll(probes)
    # Sets of an n-gram with very many classes: each trie of it meets each other one.
    dealt = _deal(mixed.join(heavy, "gram", "left_semi").select("node", "id", "size", "class", F.col("gram").alias("share")), ["share"])
    dealt = dealt.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    kind = F.when(F.col("at") == F.col("salt"), 2).when(F.col("at") > F.col("salt"), 0).otherwise(1)
    many = dealt.select("share", F.least("salt", "at").alias("salt"), F.greatest("salt", "at").alias("other"), kind.alias("kind"), "node", "id", "class")
    more = _search(rows, sets, parts, percent).unionAll(_search(many, sets, parts, percent))
    # Links of the second round join classes of the first.
    name = known.select("id", "component")
    more = cut(more, "links")
    drop(mixed, members, held, meet)
    side = lambda c: F.coalesce(F.col(f"{c}c"), F.col(c)).alias(c)
    more = more.join(name.toDF("a", "ac"), "a", "left").join(name.toDF("b", "bc"), "b", "left").select(side("a"), side("b"))
    joined = cut(components(more), "joined").toDF("component", "whole")
    old = known.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    alone = joined.join(known, joined["component"] == known["id"], "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
    return old.unionAll(alone)
