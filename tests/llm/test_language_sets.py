"""Sets of languages have no size of their own: the penalty ends them."""

import numpy as np

from ledgerspark.llm.language import BUCKETS, infer


def test_many_languages():
    n, r = 7, np.random.default_rng(2)
    table = np.full((n, BUCKETS), 0.05)
    for k in range(n):
        table[k, 100 * k : 100 * k + 100] += 1000
    table = np.log(table / table.sum(axis=1, keepdims=True))
    runs = [np.concatenate([r.integers(100 * k, 100 * k + 100, 640) for k in range(size)]) for size in (1, 4, 7)]
    theta = infer(np.concatenate(runs), np.cumsum([0, *map(len, runs)]), table, np.log(np.full(n, 1 / n)))
    assert (theta > 1e-3).sum(axis=1).tolist() == [1, 4, 7]
    assert np.allclose(theta[2, :n], 1 / n, atol=0.01)
