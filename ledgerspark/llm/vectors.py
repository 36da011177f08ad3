"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes go to the shards of their nearest centres, so
that shards overlap. Each shard builds a graph: of a node's nearest candidates
robust pruning keeps those that no kept one is much closer to. The adjacency
lists of all shards are united. Then every node of a shard is searched for,
greedily from the shard's medoids along the united graph, and a search that has
come within range expands through everything in range. What is found is
verified in double precision and counted by the one task that owns the pair, so
tasks hand on counts and the least node of each local group, never pairs.
Recall is audited against brute force for sampled queries, more of them until they have enough true links. If it falls
short, the build repeats with more overlap; if that is not enough either, all
pairs are compared in blocks. Too few true links leave the graph not audited,
which a warning and a null recall say.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import NULL_ID, released
from .store import cut

#: Nodes of a shard on average, before overlap; centres at most (they are broadcast, as is the sample for them).
SHARD_NODES = 600
MOST_CENTRES = 1 << 16
SAMPLE_PER_CENTRE = 16
MOST_SAMPLE = 1 << 16
#: Nodes that one task takes; a larger shard is dealt into tiles, and each two tiles meet in one task.
MOST_NODES = 2048
#: Nodes whose neighbours a range search looks at together.
FRONTIER = 1 << 14
#: Candidates, kept neighbours and the slack of robust pruning; nodes that a search holds.
CANDIDATES, NEIGHBOURS, ALPHA, BEAM = 48, 24, 1.2, 32
MEDOIDS = 8
AUDIT_QUERIES, LEAST_RECALL = 256, 0.97
#: True links that an audit needs, and queries up to which it looks for them.
AUDIT_LINKS, MOST_AUDIT_QUERIES = 100, 1 << 14
MOST_OVERLAP = 12
#: Nodes of a block where all pairs are compared.
EXACT_NODES = 4096
#: What a task says of a node that it found links of: the least node that these reach, how many
#: links, and how many vectors (copies included) they lead to. Pairs are not handed on.
FOUND = "a long, b long, links long, others long"


# ---- graphs ----------------------------------------------------------------


def nearest(x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar others of each unit vector, and their similarities, best first."""
    n = len(x)
    k = min(k, n - 1)
    ids, sims = np.empty((n, k), np.int64), np.empty((n, k), np.float32)
    for low in range(0, n, block):
        s = x[low : low + block] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n else np.argsort(-s, axis=1)[:, :k]
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        ids[low : low + block], sims[low : low + block] = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return ids, sims


def robust_prune(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int, alpha: float, block: int = 128) -> np.ndarray:
    """Kept candidates of each node, -1 where there are fewer: the nearest one stays, and those
    that it is alpha times closer to than the node is go; and so on with what is left."""
    n, k = ids.shape
    out = np.full((n, keep), -1)
    for low in range(0, n, block):
        own = x[ids[low : low + block]]
        between = np.einsum("ikd,ild->ikl", own, own)
        far = np.sqrt(np.maximum(0, 2 - 2 * sims[low : low + block]))
        apart = np.sqrt(np.maximum(0, 2 - 2 * between))
        alive = np.ones(far.shape, bool)
        lane = np.arange(len(own))
        for j in range(keep):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)  # candidates stand best first
            out[low : low + block, j][some] = ids[low : low + block][lane, pick][some]
            alive &= alpha * apart[lane, pick] > far
            alive[lane, pick] = False
    return out


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned graph, both ways."""
    if len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = robust_prune(x, *nearest(x, CANDIDATES), NEIGHBOURS, ALPHA)
    a, j = np.nonzero(kept >= 0)
    b = kept[a, j]
    pairs = np.unique(np.concatenate((a * len(x) + b, b * len(x) + a)))
    return pairs // len(x), pairs % len(x)


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The node nearest to the mean, then each time the one least like those before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(chosen)


def padded(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Neighbours of each node in rows of one width, -1 where there are fewer; a ascends."""
    count = np.bincount(a, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1)
    out[a, np.arange(len(a)) - (np.cumsum(count) - count)[a]] = b
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all that the searches find within range. x: unit vectors; graph: padded lists."""
    n, q = len(x), len(queries)
    beam = min(max(beam, len(start)), n)
    goal = x[queries]
    seen = np.zeros((q, n), bool)
    inside = np.zeros((q, n), bool)
    seen[:, start] = True
    held = np.full((q, beam), -1)
    value = np.full((q, beam), -np.inf, np.float32)
    sims = goal @ x[start].T
    order = np.argsort(-sims, axis=1)[:, :beam]
    held[:, : order.shape[1]], value[:, : order.shape[1]] = start[order], np.take_along_axis(sims, order, 1)
    inside[:, start] = sims >= least
    open_ = held >= 0

    def visit(rows, nodes):
        """New (row, node, similarity) among neighbours of nodes."""
        near = graph[nodes]
        r = np.repeat(rows, near.shape[1])
        near = near.ravel()
        ok = near >= 0
        r, near = r[ok], near[ok]
        fresh = ~seen[r, near]
        pair = np.unique(r[fresh] * n + near[fresh])
        r, near = pair // n, pair % n
        seen[r, near] = True
        s = np.einsum("ij,ij->i", goal[r], x[near]) if len(r) else np.zeros(0, np.float32)
        hit = s >= least
        inside[r[hit], near[hit]] = True
        return r, near, s

    # Greedy: each search opens the best node that it holds and has not opened.
    while (rows := np.flatnonzero(open_.any(axis=1))).size:
        pick = np.where(open_[rows], value[rows], -np.inf).argmax(axis=1)
        open_[rows, pick] = False
        r, near, s = visit(rows, held[rows, pick])
        if not len(r):
            continue
        width = np.bincount(r, minlength=q)
        more = np.full((q, int(width.max())), -1)
        more_s = np.full(more.shape, -np.inf, np.float32)
        place = np.arange(len(r)) - (np.cumsum(width) - width)[r]
        more[r, place], more_s[r, place] = near, s
        touched = np.unique(r)
        ids = np.concatenate((held[touched], more[touched]), axis=1)
        vals = np.concatenate((value[touched], more_s[touched]), axis=1)
        opens = np.concatenate((open_[touched], more[touched] >= 0), axis=1)
        order = np.argsort(-vals, axis=1, kind="stable")[:, :beam]
        held[touched], value[touched], open_[touched] = (np.take_along_axis(y, order, 1) for y in (ids, vals, opens))
    # Range: from everything in range on through all that is in range, so many nodes at a time.
    rows, nodes = np.nonzero(inside)
    while len(rows):
        more = []
        for low in range(0, len(rows), FRONTIER):
            r, near, s = visit(rows[low : low + FRONTIER], nodes[low : low + FRONTIER])
            hit = s >= least
            more.append((r[hit], near[hit]))
        rows, nodes = (np.concatenate(x) for x in zip(*more))
    return np.nonzero(inside)


def search_shard(x64: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i < j) of a shard; x64: unit vectors; a, b: edges."""
    x = x64.astype(np.float32)
    graph = padded(a, b, len(x))
    start = medoids(x, MEDOIDS)
    left, right = [], []
    for low in range(0, len(x), 256):
        queries = np.arange(low, min(len(x), low + 256))
        q, node = range_search(x, graph, queries, start, threshold - 1e-4, beam)
        i, j = np.minimum(queries[q], node), np.maximum(queries[q], node)
        left.append(i[i < j])
        right.append(j[i < j])
    pair = np.unique(np.concatenate(left) * len(x) + np.concatenate(right))
    i, j = pair // len(x), pair % len(x)
    good = np.concatenate([np.einsum("ij,ij->i", x64[i[k : k + 65536]], x64[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    return i[good], j[good]


# ---- Spark -----------------------------------------------------------------


def _unit(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parse(batches):
    """vec_id, key (of the exact contents; null if it links with nothing), vec (doubles)."""
    for batch in batches:
        column = batch.column("embedding")
        width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN there
        first = np.cumsum(width) - width
        keys, vecs = [None] * len(width), [None] * len(width)
        for w in np.unique(width[width > 0]):  # usually one
            rows = np.flatnonzero(width == w)
            x = values[first[rows][:, None] + np.arange(w)]
            some = np.isfinite(x).all(axis=1) & x.any(axis=1)
            rows, x = rows[some], x[some]
            x = x / np.abs(x).max(axis=1, keepdims=True) + 0.0  # far from overflow; directions stay; no negative zero
            for row, one in zip(rows, x):
                vecs[row] = one.tobytes()
                keys[row] = hashlib.blake2b(vecs[row], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])


def _centres(nodes: DataFrame, count: int) -> np.ndarray:
    """Centres by a few rounds of k-means over a bounded hash sample."""
    k = max(1, min(MOST_CENTRES, math.ceil(count / SHARD_NODES)))
    rows = nodes.orderBy(F.xxhash64("id", F.lit(7))).limit(min(MOST_SAMPLE, max(k, SAMPLE_PER_CENTRE * k))).select("vec").toArrow()
    x = _unit(rows.column("vec")).astype(np.float32)
    c = x[:k].copy()
    for _ in range(4):
        own = np.concatenate([(x[i : i + 1024] @ c.T).argmax(axis=1) for i in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _assign(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """shard, shards, id, copies, vec: each node in the shards of its nearest centres, all of which it names."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    @released
    def run(batches):
        c = shared.value
        take = min(overlap, len(c))
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                s = _unit(batch.column("vec")).astype(np.float32) @ c.T
                top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
                at = pa.array(np.repeat(np.arange(len(s)), take))
                each = np.repeat(np.sort(top, axis=1).astype(np.int64), take, axis=0)
                every = pa.ListArray.from_arrays(pa.array(np.arange(0, each.size + 1, take, dtype=np.int32)), pa.array(each.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int64)), every, *[batch.column(c).take(at) for c in ("id", "copies", "vec")]], names=["shard", "shards", "id", "copies", "vec"])

    return nodes.select("id", "copies", "vec").mapInArrow(run, "shard long, shards array<long>, id long, copies long, vec binary")


def _tiled(assigned: DataFrame) -> DataFrame:
    """task, shard, tile, alone, shards, id, copies, vec: a shard is one task, unless it is too large: then
    each two of its tiles are one. tile: the node's; alone: both tiles of the task are the same."""
    sizes = assigned.groupBy("shard").agg(F.count("*").alias("n"))
    rows = assigned.join(sizes, "shard").withColumn("tiles", F.when(F.col("n") <= MOST_NODES, 1).otherwise(F.ceil(F.col("n") * 2 / F.lit(MOST_NODES)))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    return rows.select(F.concat_ws("-", "shard", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "shard", F.col("own").alias("tile"), (F.col("own") == F.col("other")).alias("alone"), "shards", "id", "copies", "vec")


def roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least node that the links i, j (and the groups of root, where given) reach from each of n nodes."""
    root = np.arange(n) if root is None else root
    while True:
        least = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, root[i], least)
        np.minimum.at(now, root[j], least)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            return root
        root = now[root]


def owned(shards: np.ndarray, tile: np.ndarray, alone: bool, shard: int, i: np.ndarray, j: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Which pairs i, j this task counts: of all tasks that hold both, the one of their least common
    shard, and there the one of just their tiles. shards: ascending rows."""
    out = np.zeros(len(i), bool)
    for low in range(0, len(i), block):
        p, q = i[low : low + block], j[low : low + block]
        common = (shards[p][:, :, None] == shards[q][:, None, :]).any(axis=2)
        out[low : low + block] = shards[p, common.argmax(axis=1)] == shard
    return out & (alone | (tile[i] != tile[j]))


def _counted(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """FOUND's rows of the links i, j between ids, each link given once; ids ascend."""
    n = len(ids)
    links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    others = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    some = np.flatnonzero(links)
    return pa.table({"a": ids[some], "b": ids[roots(n, i, j)[some]], "links": links[some].astype(np.int64), "others": others[some].astype(np.int64)})


def _link(nodes: DataFrame, threshold: float, count: int, overlap: int, beam: int) -> DataFrame:
    """FOUND's rows: what each task found of its nodes' links. Every link is counted in one task."""
    tasks = cut(_tiled(_assign(nodes, _centres(nodes, count), overlap)), "shards")

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        a, b = build_graph(_unit(table.column("vec")).astype(np.float32))
        first = np.searchsorted(a, np.arange(len(ids) + 1))
        return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids[b]))})

    lists = tasks.select("task", "id", "vec").groupBy("task").applyInArrow(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        near = table.column("near").combine_chunks()
        a = np.repeat(np.arange(len(ids)), np.asarray(near.value_lengths()))
        to = np.asarray(near.flatten())
        b = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = ids[b] == to  # other shards' nodes are met there
        i, j = search_shard(_unit(table.column("vec")), a[here], b[here], threshold, beam)
        shards = np.asarray(table.column("shards").combine_chunks().flatten()).reshape(len(ids), -1)
        mine = owned(shards, table.column("tile").to_numpy(), table.column("alone")[0].as_py(), table.column("shard")[0].as_py(), i, j)
        return _counted(ids, table.column("copies").to_numpy(), i[mine], j[mine])

    return tasks.join(united, "id").groupBy("task").applyInArrow(search, FOUND)


def totals(found: DataFrame) -> DataFrame:
    """a, links, others: the links of every linked node, summed up over tasks."""
    whole = found.sparkSession.createDataFrame([], FOUND).unionByName(found, allowMissingColumns=True)
    return whole.groupBy("a").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum("others"), F.lit(0)).alias("others"))


def audit_links(nodes: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT_QUERIES, among: DataFrame | None = None) -> tuple[int, int]:
    """(found, true): links of a bounded hash sample of nodes, or of those among, as counted and by brute force over all nodes."""
    rows = (nodes if among is None else among).orderBy(F.xxhash64("id", F.lit(11))).limit(queries).select("id", "vec").toArrow()
    if not rows.num_rows:
        return 0, 0
    ids, x = rows.column("id").to_numpy(), _unit(rows.column("vec"))
    shared = nodes.sparkSession.sparkContext.broadcast((ids, x))

    @released
    def scan(batches):
        ids, x = shared.value
        true = np.zeros(len(ids), np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                near = x @ _unit(batch.column("vec")).T >= threshold
                true += (near & (ids[:, None] != batch.column("id").to_numpy()[None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true)], names=["q", "near"])

    true = nodes.select("id", "vec").mapInArrow(scan, "q long, near long").groupBy("q").agg(F.sum("near").alias("near")).where("near > 0")
    seen, total = true.join(totals(found), F.col("q") == F.col("a"), "left").agg(F.sum(F.coalesce("links", F.lit(0))), F.sum("near")).first()
    return seen or 0, total or 0


def audit_recall(nodes: DataFrame, found: DataFrame, threshold: float, count: int) -> float | None:
    """Share of true links that are found, from as many queries as give AUDIT_LINKS true
    links, or from all count nodes.

    Where MOST_AUDIT_QUERIES give fewer, nodes that have found links are asked as well, since these have true
    links; the lesser share counts. A node all of whose links are lost is only met by the first kind of query. None
    where both kinds have fewer than AUDIT_LINKS true links.
    """
    queries = AUDIT_QUERIES
    while True:
        seen, total = audit_links(nodes, found, threshold, queries)
        if queries >= count:
            return seen / total if total else 1.0  # all nodes were compared
        if total >= AUDIT_LINKS:
            return seen / total
        if queries >= MOST_AUDIT_QUERIES:
            break
        queries = min(MOST_AUDIT_QUERIES, queries * 8)
    linked = nodes.join(totals(found).where("links > 0").select(F.col("a").alias("id")), "id", "left_semi")
    met, real = audit_links(nodes, found, threshold, AUDIT_QUERIES, linked)
    return min(met / real, seen / total if total else 1.0) if real >= AUDIT_LINKS else None


def exact_links(nodes: DataFrame, threshold: float, count: int) -> DataFrame:
    """FOUND's rows with every pair compared in double precision; each two blocks are a task."""
    parts = max(1, math.ceil(count / EXACT_NODES))
    rows = nodes.select("id", "copies", "vec").withColumn("own", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(parts)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rows = rows.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "copies", "vec")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, own = (table.column(c).to_numpy() for c in ("id", "copies", "own"))
        x = _unit(table.column("vec"))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        n = len(ids)
        links, others, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        for low in range(0, len(left), 512):  # what is held is these rows' links
            i, j = np.nonzero(x[left[low : low + 512]] @ x[right].T >= threshold)
            i, j = left[low + i], right[j]
            some = i < j if p == q else i != j
            i, j = i[some], j[some]
            links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            others += (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
            root = roots(n, i, j, root)
        some = np.flatnonzero(links)
        return pa.table({"a": ids[some], "b": ids[root[some]], "links": links[some], "others": others[some]})

    return rows.groupBy("p", "q").applyInArrow(compare, FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for every row of vectors (vec_id, embedding).

    Two vectors link if their cosine is threshold at least, in double precision.
    n_links counts the other vectors linked directly, equal ones included;
    component_id is the least vec_id that links reach; kept: vec_id is that.
    recall is the audited share of true links. Null, empty, zero vectors and
    those with null or non-finite components link with nothing, as do vectors of
    different lengths. A null vec_id counts as least and stays null. Repeated
    rows are vectors of their own. An empty table gives no rows; further columns
    are not read.
    """
    source = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parsed = cut(source.mapInArrow(_parse, "vec_id long, key binary, vec binary"), "vectors")
    classes = cut(parsed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "nodes")
    found, recall = None, 1.0
    # Vectors of one length are compared with each other; usually there is one length.
    for (width,) in classes.select(F.octet_length("vec")).distinct().collect():
        nodes = classes.where(F.octet_length("vec") == width)
        own, part = _audited(nodes, threshold)
        found, recall = own if found is None else found.unionAll(own), min(recall, part)
    spark = vectors.sparkSession
    if found is None:
        found = spark.createDataFrame([], FOUND)
    groups = components(found.select("a", "b"))
    known = classes.select("key", "id", "copies").join(totals(found), F.col("id") == F.col("a"), "left").join(groups.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    known = known.select("key", F.coalesce("component", "id").alias("least"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    out = parsed.select("vec_id", "key").join(known, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("least"))
    given = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(given("vec_id").alias("vec_id"), "n_links", given("least").alias("component_id"), (F.col("vec_id") == F.col("least")).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def _audited(nodes: DataFrame, threshold: float) -> tuple[DataFrame, float]:
    """The links and their measured recall. Links whose recall cannot be measured are never taken: all pairs are compared."""
    count = nodes.count()
    overlap, beam = 3, BEAM
    while True:
        found = cut(_link(nodes, threshold, count, overlap, beam), "links")
        recall = audit_recall(nodes, found, threshold, count)
        if recall is not None and recall >= LEAST_RECALL:
            return found, recall
        if recall is None or overlap >= MOST_OVERLAP:  # not measured, or not enough
            return cut(exact_links(nodes, threshold, count), "links"), 1.0
        overlap, beam = overlap * 2, beam * 2
