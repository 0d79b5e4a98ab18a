"""Ties beyond the number of candidates that are ranked again."""

import numpy as np
import pytest
from test_neighbors import brute, frame

from termweave.llm import neighbors as nb


@pytest.mark.parametrize("exact", [True, False])
def test_many_copies_of_one_direction(spark, exact):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(3, 64))
    order = rng.permutation(1500)
    vectors = {int(i): (centres[i % 3] + 0.3 * rng.normal(size=64)).astype(np.float32) for i in order}
    copies = order[:400]
    for n, i in enumerate(copies):  # powers of two keep the direction exactly; other factors are rounded
        factor = 2.0 ** (n % 40 - 20) if exact else rng.uniform(0.1, 10)
        vectors[int(i)] = (vectors[int(copies[0])].astype(np.float64) * factor).astype(np.float32)
    rows = [(i, "m", v.tolist(), 1, "x") for i, v in vectors.items()]
    got = {r.emb_id: list(r.neighbours) for r in nb.neighbours(frame(spark, rows), "emb_id", "model", "embedding", 5).collect()}
    want = brute({i: v.tolist() for i, v in vectors.items()}, 5)
    assert [i for i in map(int, copies) if got[i] != want[i]] == []


def test_scan_keeps_ties():
    rng = np.random.default_rng(1)
    books = rng.normal(size=(nb.SPLITS, 16, nb.SUB)).astype(np.float32)
    codes = np.repeat(rng.integers(0, 256, (4, nb.SPLITS // 2)).astype(np.uint8), 200, axis=0)
    for places in nb.scan(rng.normal(size=(9, 64)).astype(np.float32), codes, books, 64):
        assert len(places) % 200 == 0 and len(places)
