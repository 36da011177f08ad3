"""Every pair of vectors is counted in one of the tasks that hold both, however shards and tiles overlap."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerspark.llm import vectors


def test_one_task_owns_a_pair():
    r = random.Random(6)
    shards = np.array([sorted(r.sample(range(5), 3)) for _ in range(40)])
    tiles = {3: 4}  # shard 3 is dealt into 4 tiles; the others are one task
    seen = Counter()
    for shard in range(5):
        inside = np.flatnonzero((shards == shard).any(axis=1))
        count = tiles.get(shard, 1)
        for p in range(count):
            for q in range(p, count):
                node = np.array([k for k in inside if k % count in (p, q)])
                i, j = np.triu_indices(len(node), 1)
                mine = vectors.owned(shards[node], node % count, p == q, shard, i, j, block=7)
                seen.update((int(node[a]), int(node[b])) for a, b in zip(i[mine], j[mine]))
    meet = {(a, b) for a in range(40) for b in range(a + 1, 40) if set(shards[a]) & set(shards[b])}
    assert set(seen) == meet and set(seen.values()) == {1}


def test_roots_are_least_of_their_groups():
    r = random.Random(8)
    for _ in range(50):
        n = r.randrange(1, 40)
        links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(40))]
        i, j = (np.array(x, np.int64) for x in (zip(*links) if links else ((), ())))
        want = list(range(n))
        while (now := [min([want[k]] + [want[b] for a, b in links if a == k] + [want[a] for a, b in links if b == k]) for k in range(n)]) != want:
            want = now
        assert vectors.roots(n, i, j).tolist() == want
        half = len(i) // 2
        assert vectors.roots(n, i[half:], j[half:], vectors.roots(n, i[:half], j[:half])).tolist() == want


def test_parse_edges():
    """Nulls, empty, zero and non-finite vectors have no key; scale and the sign of zero do not matter; slices are read right."""
    rows = [[9.0, 9.0], None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], [1.0, 2.0, 3.0], [5e-324, 0.0], [1e308, 1e308]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    (out,) = vectors._parse([batch.slice(1)])
    keys = out.column("key").to_pylist()
    assert out.column("vec_id").to_pylist() == list(range(1, len(rows)))
    assert [k is None for k in keys] == [True] * 6 + [False] * 7
    assert keys[6] == keys[7] and keys[8] == keys[9] and len(set(keys[6:])) == 5
    assert [None if v is None else len(v) for v in out.column("vec").to_pylist()][6:] == [16, 16, 16, 16, 24, 16, 16]
    (none,) = vectors._parse([batch.slice(0, 0)])
    assert none.num_rows == 0
