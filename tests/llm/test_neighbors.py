import numpy as np
import pyarrow as pa
import pytest

from termweave.llm import neighbors as nb


def brute(vectors, k):
    out = {}
    items = sorted((i, np.array(v, float) / np.linalg.norm(v)) for i, v in vectors.items())
    ids, x = np.array([i for i, _ in items]), np.stack([v for _, v in items])
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    for row, i in enumerate(ids):
        out[int(i)] = [int(ids[j]) for j in np.argsort(-s[row], kind="stable")[: min(k, len(ids) - 1)]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "emb_id long, model string, embedding array<float>, part int, class string")


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    vectors = {i: (centres[i % 12] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist() for i in range(2400)}
    for i in range(2400, 2420):  # equal and scaled copies: ties go to the smaller id
        vectors[i] = [x * (1 if i % 2 else 2) for x in vectors[7]]
    got = {r.emb_id: list(r.neighbours) for r in nb.neighbours(frame(spark, [(i, "m", v, 1, "x") for i, v in vectors.items()]), "emb_id", "model", "embedding", 5).collect()}
    want = brute(vectors, 5)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.97
    assert got[2415] == want[2415] and got[7] == want[7]


def test_parts_of_parts(spark, monkeypatch):
    """More parts than centroids: each is parted again, and 16 of 60 parts are searched."""
    monkeypatch.setattr(nb, "COARSE", 6)
    monkeypatch.setattr(nb, "PART", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    vectors = {i: (centres[i % 40] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist() for i in range(2400)}
    index = nb.learn(nb._matrix(pa.array(vectors.values(), pa.list_(pa.float32()))).astype(np.float32), 60)
    assert len(index.centroids) * len(index.fine) == 60
    got = {r.emb_id: list(r.neighbours) for r in nb.neighbours(frame(spark, [(i, "m", v, 1, "x") for i, v in vectors.items()]), "emb_id", "model", "embedding", 5).collect()}
    want = brute(vectors, 5)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.95


def test_recall_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    frame(spark, [(i, "ab"[i % 2], rng.normal(size=64).tolist(), 1, "x") for i in range(400)]).write.parquet(f"{tmp_path}/embedding_store.parquet")
    got = {r.model: r for r in nb.p2_recall(spark, str(tmp_path)).collect()}
    assert got["a"].queries == 8 and got["a"].true == 40 and got["a"].recall >= 0.95 and set(got) == {"a"}


def test_unusable_and_small(spark):
    nan, inf = float("nan"), float("inf")
    e = [0.0] * 64
    unit = lambda i: [*e[:i], 1.0, *e[i + 1 :]]
    rows = [(1, "a", unit(0), 1, ""), (2, "a", unit(1), 1, ""), (3, "b", unit(0), 1, ""), (4, "a", None, 1, ""), (5, "a", e, 1, ""), (6, "a", [nan, *e[1:]], 1, ""), (7, "a", [inf, *e[1:]], 1, ""), (8, "a", [1.0] * 63, 1, ""), (9, "a", [None, *e[1:]], 1, ""), (10, None, unit(2), 1, ""), (11, "a", [-0.0 if x == 0 else x for x in unit(1)], 1, "")]
    got = {r.emb_id: list(r.neighbours) for r in nb.neighbours(frame(spark, rows), "emb_id", "model", "embedding", 5).collect()}
    assert got == {1: [2, 11], 2: [11, 1], 3: [], 11: [2, 1]}


def test_codes_favour_the_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = nb.learn(x, 4)
    rest = x - index.centroids[nb.nearest(x, index.centroids)[:, 0]]
    along = {}
    for w in (1.0, nb.parallel_weight()):
        codes = nb.encode(rest, x, index.books, w)
        error = rest.reshape(len(x), nb.SPLITS, nb.SUB) - index.books[np.arange(nb.SPLITS), codes]
        along[w] = float((((error.reshape(len(x), -1)) * x).sum(1) ** 2).mean())
    assert along[nb.parallel_weight()] < along[1.0]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_scan_keeps_all_of_a_small_part(n):
    rng = np.random.default_rng(n)
    q, codes, books = rng.normal(size=(5, 64)).astype(np.float32), rng.integers(0, 256, (n, nb.SPLITS // 2)).astype(np.uint8), rng.normal(size=(nb.SPLITS, 16, nb.SUB)).astype(np.float32)
    assert sorted(nb.scan(q, codes, books, 64)[0].tolist()) == list(range(n))
