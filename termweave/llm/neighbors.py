"""Problem 2: the k most similar vectors of the same model for every vector.

Score-aware anisotropic quantisation. Each model's unit vectors are parted by k-means; the rest of a vector behind its centroid is
coded in four bits for every component, the codes chosen by coordinate descent so that the error parallel to the vector, which
moves large inner products, costs more than the error across it. A query scans the codes of its nearest parts through lookup
tables (two four-bit codes share one table of 256 sums, sixteen-bit, added for a block of queries at a time); the best of each
part are ranked again by exact cosine in double precision.

Parts stay near PART vectors however many there are: beyond COARSE centroids each part is parted again by a second set of centroids, learnt
from what the first leave over and shared by all parts, so that their number is a product while a vector is compared with a sum. The work
per vector is then bounded, and the whole grows with the number of vectors.

The index is trained on a bounded sample (about SAMPLE vectors per model and SAMPLES in all, by a hash of the id) but holds every vector that can
be an answer: of vectors of exactly one direction only the k + 1 smallest ids can be, as ties go to the smaller id; all of them are queries.
Parts are cut into blocks of vectors and of queries, so that a hot part is many small tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.let import let
from termweave.operators.channels import nearest_vectors
from termweave.session import cut_lineage, materialised, table
from termweave.skew import join_on_skewed_key

WIDTH = 64
#: Vectors per model, and of all models together, from which centroids and codebooks are learnt; more models than MODELS are a mistake.
SAMPLE, SAMPLES, MODELS = 20_000, 200_000, 1_000
#: Vectors per part aimed at, and the most centroids of each of the two sets.
PART, COARSE, FINE = 1_000, 2_048, 4_096
#: Parts that a query scans, and those of a model whose parts are parted again.
PROBES, FINE_PROBES = 4, 16
#: Candidates per part that are ranked again exactly.
RERANK = 64
#: Vectors compared exactly in one step.
CELLS = 32_768
#: Vectors and queries in one block.
BLOCK = 16_384
#: Inner products from this threshold on are to be exact; gives the weight of the parallel error.
THRESHOLD = 0.2
CODES, SUB = 16, 1
SPLITS = WIDTH // SUB


@dataclass(frozen=True)
class Index:
    """What is learnt of one model: centroids (n x WIDTH), what is added to them in the parts of a part (m x WIDTH, one of zeros if parts are not parted), codebooks (SPLITS x CODES x SUB)."""

    centroids: np.ndarray
    books: np.ndarray
    fine: np.ndarray

    def parts(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        """The k nearest parts of each row, nearest first: the nearest of all pairs of one of the k nearest centroids with what is added."""
        if len(self.fine) == 1:
            return nearest(x, self.centroids, k)
        k = min(k, len(self.centroids) * len(self.fine))
        out = np.empty((len(x), k), np.int64)
        for a in range(0, len(x), 256):
            some = x[a : a + 256]
            first = nearest(some, self.centroids, k)
            rest = some[:, None, :] - self.centroids[first]  # rows x k x WIDTH
            score = rest @ self.fine.T - 0.5 * (self.fine * self.fine).sum(1) - 0.5 * (rest * rest).sum(2, keepdims=True)
            flat = score.reshape(len(some), -1)
            top = np.argpartition(-flat, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(flat, top, 1), axis=1), 1)
            coarse = np.take_along_axis(first, top // len(self.fine), 1)
            out[a : a + 256] = coarse * len(self.fine) + top % len(self.fine)
        return out

    def centres(self, parts: np.ndarray) -> np.ndarray:
        return self.centroids[parts // len(self.fine)] + self.fine[parts % len(self.fine)]


def parallel_weight(width: int = WIDTH, threshold: float = THRESHOLD) -> float:
    """How much dearer the parallel error is than the orthogonal one."""
    return max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))


def nearest(x: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    score = x @ centroids.T - 0.5 * (centroids * centroids).sum(1)
    if k == 1:
        return score.argmax(1)[:, None]
    k = min(k, len(centroids))
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1), 1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)[:, 0]
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        empty = n == 0
        centroids = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        if empty.any():
            centroids[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centroids


def encode(rest: np.ndarray, unit: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n x SPLITS) that minimise |e|^2 + (weight - 1) (e . unit)^2 for the error e, by coordinate descent."""
    n = len(rest)
    r, u = rest.reshape(n, SPLITS, SUB), unit.reshape(n, SPLITS, SUB)
    codes = np.empty((n, SPLITS), np.uint8)
    along = np.empty((n, SPLITS), np.float32)  # each split's share of the parallel error
    rows = np.arange(n)
    for m in range(SPLITS):
        e = r[:, m, None, :] - books[m][None]
        codes[:, m] = (e * e).sum(2).argmin(1)
        along[:, m] = (e[rows, codes[:, m]] * u[:, m]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(SPLITS):
            e = r[:, m, None, :] - books[m][None]
            part = (e * u[:, m, None, :]).sum(2)
            cost = (e * e).sum(2) + (weight - 1) * (total[:, None] - along[:, m, None] + part) ** 2
            codes[:, m] = cost.argmin(1)
            new = part[rows, codes[:, m]]
            total += new - along[:, m]
            along[:, m] = new
    return codes


def learn(x: np.ndarray, parts: int, rounds: int = 3) -> Index:
    """Centroids and codebooks from unit vectors. A codeword is the weighted least-squares answer for the vectors that use it."""
    centroids = k_means(x, min(parts, COARSE))
    rest = x - centroids[nearest(x, centroids)[:, 0]]
    fine = k_means(rest, min(FINE, -(-parts // len(centroids)))) if parts > COARSE else np.zeros((1, x.shape[1]), np.float32)
    index = Index(centroids, np.zeros((SPLITS, CODES, SUB), np.float32), fine)
    rest = x - index.centres(index.parts(x)[:, 0])
    split = rest.reshape(len(x), SPLITS, SUB)
    books = np.zeros((SPLITS, CODES, SUB), np.float32)
    for m in range(SPLITS):
        book = k_means(np.ascontiguousarray(split[:, m]), CODES, seed=m)
        books[m, : len(book)] = book
    extra, u = parallel_weight() - 1, x.reshape(len(x), SPLITS, SUB)
    for _ in range(rounds):
        codes = encode(rest, x, books, extra + 1)
        chosen = books[np.arange(SPLITS), codes]  # n x SPLITS x SUB
        along = ((split - chosen) * u).sum(2)
        total = along.sum(1)
        for m in range(SPLITS):
            um, others = u[:, m], total - along[:, m]
            outer = np.eye(SUB)[None] + extra * um[:, :, None] * um[:, None, :]
            aim = split[:, m] + extra * um * (others + (split[:, m] * um).sum(1))[:, None]
            for c in range(CODES):
                of = codes[:, m] == c
                if of.sum() > SUB:
                    books[m, c] = np.linalg.solve(outer[of].sum(0), aim[of].sum(0))
    return Index(centroids, books.astype(np.float32), fine)


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray, keep: int) -> list[np.ndarray]:
    """For each query the places of the ``keep`` best rows by table sums, and of all that tie with the last of them; where few tie, of some more.

    ``codes`` has two four-bit codes a byte.
    """
    n, pairs = codes.shape
    keep = min(keep, n)
    table_ = np.einsum("mcs,qms->mcq", books, q.reshape(len(q), SPLITS, SUB))
    both = (table_[0::2, :, None, :] + table_[1::2, None, :, :]).reshape(pairs, CODES * CODES, len(q))
    both = np.rint(both * (1000.0 / max(float(np.abs(both).max()), 1e-30))).astype(np.int16)
    sums, row = np.zeros((n, len(q)), np.int16), np.empty((n, len(q)), np.int16)
    for j in range(pairs):
        np.take(both[j], codes[:, j], axis=0, out=row)
        sums += row
    if keep == n:
        return [np.arange(n)] * len(q)
    far = np.ascontiguousarray(-sums.T)
    best = np.argpartition(far, keep - 1, axis=1)[:, :keep]
    last = np.take_along_axis(far, best[:, -1:], 1)
    within = (far <= last).sum(1)
    found, wide = list(best), min(2 * keep, n)
    few = np.flatnonzero((within > keep) & (within <= wide))
    if len(few):
        more = np.argpartition(far[few], wide - 1, axis=1)[:, :wide]
        for i, places in zip(few, more):
            found[i] = places
    for i in np.flatnonzero(within > wide):
        found[i] = np.flatnonzero(far[i] <= last[i])
    return found


def search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the k best rows for each query, by exact cosine rounded to 9 places, the smaller id first among equals."""
    order = np.argsort(ids)
    ids, x, codes = ids[order], x[order], codes[order]
    k = min(k, len(ids))
    found, near = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    single = q.astype(np.float32)
    for a in range(0, len(q), step):
        places = scan(single[a : a + step], codes, books, max(RERANK, k))
        lengths = np.array([len(p) for p in places])
        for length in np.unique(lengths):
            of = np.flatnonzero(lengths == length)
            for some_of in np.array_split(of, -(-len(of) * length // CELLS)):
                some = np.sort(np.stack([places[i] for i in some_of]), axis=1)  # by id
                exact = np.round(np.matmul(x[some], q[a + some_of][:, :, None])[:, :, 0], 9)
                best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                found[a + some_of] = ids[np.take_along_axis(some, best, 1)]
                near[a + some_of] = np.take_along_axis(exact, best, 1)
    return found, near


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, has WIDTH components, all finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(v.isNotNull() & (F.size(v) == WIDTH) & finite & F.exists(v, lambda x: x != 0))


def train(index_rows: DataFrame, sizes: dict[str, int]) -> dict[str, Index]:
    """One index per model from the vectors whose id's hash is under a threshold set by the model's size: about SAMPLE of each model and SAMPLES together, whatever the tables' size, reach the driver."""
    if len(sizes) > MODELS:
        raise ValueError(f"more than {MODELS} models")
    if not sizes:
        return {}
    each = min(SAMPLE, SAMPLES // len(sizes))
    share = F.create_map(*(F.lit(v) for m, n in sizes.items() for v in (m, int(min(1.0, each / n) * (1 << 30)))))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "emb_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("model"))
    sample = index_rows.filter(drawn).select("emb_id", "model", "v").toArrow().sort_by("emb_id")
    models = np.array(sample.column("model").to_pylist(), dtype=object)
    x = _matrix(sample.column("v")).astype(np.float32)
    return {m: learn(x[models == m], -(-n // PART)) for m, n in sizes.items() if (models == m).any()}


def neighbours(df: DataFrame, id_col: str, model: str, vector: str, k: int) -> DataFrame:
    """emb_id, neighbours: up to k ids of each usable vector's most similar vectors of its model, best first.

    Similarity is cosine in double precision rounded to 9 places; among equals the smaller id comes first; a vector is not its own neighbour.
    Vectors that are not usable, and null models, appear nowhere. Ids must be unique. Empty tables give no rows.
    """
    rows = usable(df.select(F.col(id_col).alias("emb_id"), F.col(model).alias("model"), F.col(vector).alias("v")), "v").filter("model is not null")
    # Vectors of one direction form a class: exact multiples have the same quotients by their largest component; -0.0 and 0.0 are equal, as the sum with 0.0 makes them.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float")))
    top = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    turn = let(top, lambda t: F.transform("v", lambda x: x.cast("double") / t))
    rows = rows.withColumn("class", let(turn, lambda v: F.concat_ws(":", F.xxhash64(v, "model"), F.hash("model", v))))
    w = Window.partitionBy("class").orderBy("emb_id")
    members = cut_lineage(rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1))
    sizes = {r["model"]: r["count"] for r in members.groupBy("model").count().collect()}  # one row per model
    learnt = train(members, sizes)
    weight = parallel_weight()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Multiples that single precision rounds differ in the last digits; without those they get the same codes and tie.
            unit = np.round(_matrix(b.column("v")), 3).astype(np.float32)
            models = np.array(b.column("model").to_pylist(), dtype=object)
            part, codes = np.zeros(len(b), np.int32), np.zeros((len(b), SPLITS), np.uint8)
            for m in set(models.tolist()):
                of = np.flatnonzero(models == m)
                own = learnt[m].parts(unit[of])[:, 0]
                part[of] = own
                codes[of] = encode(unit[of] - learnt[m].centres(own), unit[of], learnt[m].books, weight)
            packed = codes[:, 0::2] * CODES + codes[:, 1::2]
            yield pa.RecordBatch.from_arrays(
                [b.column("model"), pa.array(part), b.column("emb_id"), b.column("v"), pa.array([p.tobytes() for p in packed], pa.binary())], names=["model", "part", "emb_id", "v", "code"]
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _matrix(b.column("v")).astype(np.float32)
            models = np.array(b.column("model").to_pylist(), dtype=object)
            for m in set(models.tolist()):
                of = np.flatnonzero(models == m)
                parts = learnt[m].parts(unit[of], PROBES if len(learnt[m].fine) == 1 else FINE_PROBES)
                who = pa.array(np.repeat(of, parts.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("model").take(who), pa.array(parts.ravel().astype(np.int32)), *(b.column(c).take(who) for c in ("class", "v"))], names=["model", "part", "class", "v"]
                )

    index = cut_lineage(members.select("model", "emb_id", "v").mapInArrow(assign, "model string, part int, emb_id long, v array<float>, code binary"))
    probes = members.filter("place = 1").select("model", "class", "v").mapInArrow(probe, "model string, part int, class string, v array<float>")
    # Blocks per part; one row per part.
    cuts = materialised(
        index.groupBy("model", "part")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("xs"))
        .join(probes.groupBy("model", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs")), ["model", "part"])
    )
    x_side = index.join(cuts, ["model", "part"]).withColumn("xb", F.pmod(F.xxhash64("emb_id"), F.col("xs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    q_side = probes.join(cuts, ["model", "part"]).withColumn("qb", F.pmod(F.xxhash64("class"), F.col("qs")).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    keys = ["model", "part", "xb", "qb"]

    def block(q: pa.Table, x: pa.Table) -> pa.Table:
        schema = pa.schema([("class", pa.string()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64()))])
        if not len(q) or not len(x):
            return schema.empty_table()
        books = learnt[x.column("model")[0].as_py()].books
        codes = np.frombuffer(b"".join(x.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        ids, sims = search(_matrix(q.column("v")), _matrix(x.column("v")), x.column("emb_id").to_numpy(), codes, books, k + 1)
        edges = pa.array(np.arange(len(q) + 1, dtype=np.int32) * ids.shape[1])
        return pa.Table.from_arrays([q.column("class").combine_chunks(), pa.ListArray.from_arrays(edges, pa.array(ids.ravel())), pa.ListArray.from_arrays(edges, pa.array(sims.ravel()))], schema=schema)

    q_groups = q_side.select(*keys, "class", "v").groupBy(*keys)
    x_groups = x_side.select(*keys, "emb_id", "v", "code").groupBy(*keys)
    found = q_groups.cogroup(x_groups).applyInArrow(block, "class string, ids array<long>, sims array<double>")
    each = F.zip_with("sims", "ids", lambda s, i: F.struct((-s).alias("far"), i.alias("id")))
    # A class has at most PROBES x blocks short lists.
    best = found.groupBy("class").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("all")).select("class", F.transform(F.slice("all", 1, k + 1), lambda s: s["id"]).alias("best"))
    classes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(best, "class")
    joined = join_on_skewed_key(rows.select("emb_id", "class"), cut_lineage(classes), "class", "n", "emb_id", df.count())
    return joined.select("emb_id", F.slice(F.filter("best", lambda x: x != F.col("emb_id")), 1, k).alias("neighbours"))


def p2_found(spark, sf_dir: str, k: int = 5) -> DataFrame:
    near = neighbours(table(spark, sf_dir, "embedding_store"), "emb_id", "model", "embedding", k).select("emb_id", F.explode("neighbours").alias("other"))
    return near.select(F.least("emb_id", "other").alias("emb_a"), F.greatest("emb_id", "other").alias("emb_b")).distinct()


def p2_neighbours(spark, sf_dir: str, k: int = 5) -> DataFrame:
    near = neighbours(table(spark, sf_dir, "embedding_store"), "emb_id", "model", "embedding", k)
    return near.select("emb_id", F.posexplode("neighbours").alias("place", "neighbour"))


def p2_recall(spark, sf_dir: str, k: int = 5) -> DataFrame:
    """Per model, of the k most similar vectors of every stated query (ids divisible by 50), found exactly over all vectors in blocks, how many the index gives."""
    e = table(spark, sf_dir, "embedding_store")
    found = cut_lineage(neighbours(e, "emb_id", "model", "embedding", k).filter(F.col("emb_id") % 50 == 0))
    base = cut_lineage(usable(e.select("emb_id", "model", F.col("embedding").alias("v")), "v").filter("model is not null"))
    true = None
    for m in [r[0] for r in base.select("model").distinct().limit(MODELS).collect()]:
        own = base.filter(F.col("model") == m).select(F.col("emb_id").alias("id"), F.col("v").alias("vector"))
        near = nearest_vectors(own.filter(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id"), own, k).select(F.lit(m).alias("model"), F.col("query_id").alias("emb_id"), "id")
        true = near if true is None else true.unionByName(near)
    if true is None:
        return spark.createDataFrame([], "model string, queries long, true long, found long, recall double")
    both = true.join(found, "emb_id", "left").withColumn("hit", F.coalesce(F.array_contains("neighbours", F.col("id")), F.lit(False)).cast("long"))
    counts = both.groupBy("model").agg(F.count_distinct("emb_id").alias("queries"), F.count(F.lit(1)).alias("true"), F.sum("hit").alias("found"))
    return counts.withColumn("recall", F.round(F.col("found") / F.col("true"), 6))
