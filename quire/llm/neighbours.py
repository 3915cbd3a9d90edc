"""Problem 5: the most similar vectors of every vector, by an inverted file with product-quantised residuals.

Coarse centroids (k-means on a bounded sample) divide the vectors into lists; each vector is
stored in its nearest list and searched in its nearest ones: as many as hold COVER of the true
neighbours of a few drawn vectors, which are compared with all. Within a list, residuals are
product-quantised, scored by asymmetric distance tables, and the best are reranked with the
exact cosine of the vectors themselves. Every vector is indexed and every one is a query.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Vectors on which centroids and codebooks are fitted, at most (about; drawn by a hash of the key). Not a bound of the index.
SAMPLE = 32_768
#: Vectors a list holds on average, lists at most (the sample allows for no more).
LIST, LISTS = 4096, 4096
#: A list with more vectors is divided once more, by centroids fitted in its task; lists of more than BLOCK are divided among tasks first.
PART, BLOCK = 8192, 200_000
#: Lists searched at least; share of the drawn vectors' true neighbours that the searched lists hold; vectors drawn for that (about).
PROBES, COVER, DRAWN = 3, 0.98, 256
#: Points of a list (or part) reranked for a query: RERANK at least, and one in SHARE. Queries scored together.
RERANK, SHARE, TOGETHER = 64, 64, 256
PARTS, CODES, ROUNDS = 16, 256, 8
#: Bytes a task of the search reads, about.
TASK_BYTES = 24 << 20


class Index(NamedTuple):
    centroids: np.ndarray  # (lists, dim), unit length
    books: np.ndarray  # (parts, codes, dim / parts)
    blocks: np.ndarray  # tasks among which a list is divided


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def kmeans(x: np.ndarray, k: int, spherical: bool, rng: np.random.Generator) -> np.ndarray:
    """k centroids; empty ones are moved to random points. Fewer than k points are repeated."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        a = nearest(x, c, 1, spherical)[:, 0]
        order = np.argsort(a, kind="stable")
        count = np.bincount(a, minlength=k)
        at = np.cumsum(count) - count
        full = count > 0
        c[full] = np.add.reduceat(x[order], at[full], axis=0) / count[full, None]
        c[~full] = x[rng.integers(0, len(x), (~full).sum())]
        if spherical:
            c = unit(c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int, spherical: bool) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    n = min(n, len(c))
    half = 0 if spherical else (c * c).sum(axis=1) / 2
    out = np.empty((len(x), n), np.int32)
    step = max(1, 8_000_000 // len(c))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T - half
        if n == 1:
            out[i : i + step, 0] = s.argmax(axis=1)
        else:
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out[i : i + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def fit(sample: np.ndarray, total: int, seed: int = 5) -> Index:
    """The index's model from the sample; ``total`` is the number of vectors to come."""
    x, rng = unit(sample.astype(np.float32)), np.random.default_rng(seed)
    dim = x.shape[1]
    lists = int(np.clip(total // LIST, 1, min(LISTS, max(1, len(x) // 4))))
    centroids = kmeans(x, lists, True, rng)
    home = nearest(x, centroids, 1, True)[:, 0]
    residual = (x - centroids[home])[: 8 * CODES * PARTS]
    parts = PARTS if dim % PARTS == 0 else 1
    w = dim // parts
    books = np.stack([kmeans(residual[:, p * w : (p + 1) * w], CODES, False, rng) for p in range(parts)]).astype(np.float32)
    share = np.bincount(home, minlength=lists) / len(x)
    return Index(centroids, books, np.maximum(1, np.ceil(share * total / BLOCK)).astype(np.int32))


def encode(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    w = books.shape[2]
    return np.stack([nearest(residual[:, p * w : (p + 1) * w], b, 1, False)[:, 0] for p, b in enumerate(books)], axis=1)


def adc(queries: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores (points, queries): sums over the parts of each query's table of inner products with the codes.

    Tables are laid out by code, so that a point's entries for all queries are one stretch of memory.
    """
    w = books.shape[2]
    out = np.zeros((len(codes), len(queries)), np.float32)
    row = np.empty_like(out)
    for m, book in enumerate(books):
        table = book @ queries[:, m * w : (m + 1) * w].T
        np.take(table, codes[:, m], axis=0, out=row, mode="clip")
        out += row
    return out


def search_list(queries: np.ndarray, points: np.ndarray, centroid: np.ndarray, books: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) of the best k points of a list for each query; own: the query's place among the points, or -1."""
    q, p = unit(queries), unit(points)
    q32, p32 = q.astype(np.float32), p.astype(np.float32)
    keep, few = min(max(RERANK, k + 1, len(p) // SHARE), len(p)), min(4 * k, len(p))
    codes = encode(p32 - centroid, books) if keep < len(p) else None
    rows, cols, sims = [], [], []
    for i in range(0, len(q), TOGETHER):
        some = q32[i : i + TOGETHER]
        if codes is None:
            top = np.broadcast_to(np.arange(len(p)), (len(some), len(p)))
        else:
            # the centroid's part of the score is the same for all points of the list
            s = np.ascontiguousarray(adc(some, books, codes).T)
            top = np.argpartition(s, len(p) - keep, axis=1)[:, len(p) - keep :]
        near = np.matmul(p32[top], some[:, :, None])[:, :, 0]  # exact but for single precision; of the best few the whole
        near[top == own[i : i + TOGETHER, None]] = -2
        if few < top.shape[1]:
            top = np.take_along_axis(top, np.argpartition(near, top.shape[1] - few, axis=1)[:, -few:], 1)
        exact = np.einsum("qd,qkd->qk", q[i : i + TOGETHER], p[top])
        exact[top == own[i : i + TOGETHER, None]] = -2
        best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        rows.append(np.repeat(np.arange(i, i + len(some)), best.shape[1]))
        cols.append(np.take_along_axis(top, best, 1).ravel())
        sims.append(np.take_along_axis(exact, best, 1).ravel())
    r, c, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, sims))
    ok = s > -2
    return r[ok], c[ok], s[ok]


def search_divided(queries: np.ndarray, points: np.ndarray, centroid: np.ndarray, books: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search_list``; a list of more than PART points is divided by centroids of its own, of which each query searches a few.

    So the work for a query doesn't grow with the list. Parts hold a quarter of PART on
    average, and twice PROBES of them are searched.
    """
    if len(points) <= PART:
        return search_list(queries, points, centroid, books, own, k)
    p32, q32 = unit(points).astype(np.float32), unit(queries).astype(np.float32)
    rng = np.random.default_rng(len(points))
    n = -(-len(points) // (PART // 4))
    cents = kmeans(p32[rng.choice(len(p32), min(len(p32), 64 * n), replace=False)], n, True, rng)
    home, near = nearest(p32, cents, 1, True)[:, 0], nearest(q32, cents, 2 * PROBES, True)
    out: list[tuple] = []
    for part in range(n):
        at, asked = np.flatnonzero(home == part), np.flatnonzero((near == part).any(axis=1))
        if len(at) and len(asked):
            place = np.full(len(points) + 1, -1)
            place[at] = np.arange(len(at))
            r, c, s = search_list(queries[asked], points[at], centroid, books, place[own[asked]], k)
            out.append((asked[r], at[c], s))
    r, c, s = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((-s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.r_[True, r[1:] != r[:-1]]
    rank = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return r[rank < k], c[rank < k], s[rank < k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _assign(shared, dim: int, probes: int):
    def run(batches):
        index: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim))
            raw = pa.array([r.tobytes() for r in np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)], pa.binary())
            near = nearest(x, index.centroids, probes, True)
            part = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            for j in range(near.shape[1]):
                blocks = index.blocks[near[:, j]]
                mine = (part % blocks.astype(np.uint64)).astype(np.int32)
                for b in range(int(blocks.max())):  # a query visits every block of the list, a point lies in one
                    at = np.flatnonzero(blocks > b)
                    stored = (mine[at] == b) if j == 0 else np.zeros(len(at), bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near[at, j]), pa.array(np.full(len(at), b, np.int32)), batch.column(0).take(pa.array(at)), pa.array(stored), raw.take(pa.array(at))],
                        ["list", "block", "key", "stored", "vec"],
                    )

    return run


def _true(shared, keys: list[str], queries: np.ndarray, k: int):
    """(query, similarity, list) of the k most similar vectors of each query among the rows of a partition."""

    def run(batches):
        index: Index = shared.value
        at = {key: i for i, key in enumerate(keys)}
        best, home = np.full((len(keys), k), -2.0), np.full((len(keys), k), -1, np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, queries.shape[1]))
            lists = nearest(x, index.centroids, 1, True)[:, 0]
            s = queries @ x.T
            for j, key in enumerate(batch.column(0).to_pylist()):
                if key in at:
                    s[at[key], j] = -2
            s, lists = np.concatenate([best, s], axis=1), np.concatenate([home, np.broadcast_to(lists, s.shape)], axis=1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best, home = np.take_along_axis(s, top, 1), np.take_along_axis(lists, top, 1)
        q, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[q, j], pa.float64()), pa.array(home[q, j], pa.int32())], ["query", "similarity", "list"])

    return run


def probes_for(vectors: DataFrame, shared, total: int, k: int, dim: int) -> int:
    """The lists to search for COVER of the true neighbours, measured with about DRAWN vectors against all."""
    centroids = shared.value.centroids
    if len(centroids) <= PROBES:
        return PROBES
    drawn = vectors.filter(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 30)) < F.lit(int(min(1.0, DRAWN / total) * (1 << 30)))).select("key", "v").toArrow().combine_chunks()
    if not len(drawn):
        drawn = vectors.select("key", "v").limit(DRAWN).toArrow().combine_chunks()
    queries = unit(np.asarray(drawn.column(1).combine_chunks().flatten(), np.float32).reshape(-1, dim))
    pairs = vectors.select("key", "v").mapInArrow(_true(shared, drawn.column(0).to_pylist(), queries, k), "query int, similarity double, list int")
    first = Window.partitionBy("query").orderBy(F.desc("similarity"), "list")
    true = pairs.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("query", "list").toArrow()
    if not len(true):
        return PROBES
    near = nearest(queries, centroids, len(centroids), True)
    place = (near[true.column(0).to_numpy()] == true.column(1).to_numpy()[:, None]).argmax(axis=1)
    return max(PROBES, int(np.sort(place)[int(np.ceil(COVER * len(place))) - 1]) + 1)


def _search(shared, dim: int, k: int, least: float | None):
    def run(group: pa.Table) -> pa.Table:
        index: Index = shared.value
        group = group.combine_chunks()
        keys, stored = group.column("key").combine_chunks(), group.column("stored").to_numpy()
        x = _matrix(group.column("vec"), dim).astype(np.float64)
        at = np.flatnonzero(stored)
        if not len(at):
            r = c = np.zeros(0, np.int64)
            s = np.zeros(0)
        else:
            own = np.full(len(x), -1)
            own[at] = np.arange(len(at))
            r, c, s = search_divided(x, x[at], index.centroids[group.column("list")[0].as_py()], index.books, own, k)
            if least is not None:
                near = s >= least
                r, c, s = r[near], c[near], s[near]
        return pa.table([keys.take(pa.array(r)), keys.take(pa.array(at[c] if len(at) else c)), pa.array(s, pa.float64())], ["key", "neighbour", "similarity"])

    return run


def most_similar(df: DataFrame, key: str, vector: str, version: str | None = None, k: int = 5, dim: int = 64, least: float | None = None, probes: int | None = None) -> DataFrame:
    """(key, neighbour, similarity, rank): the k most similar other keys of each key with a usable vector.

    Usable vectors have ``dim`` numbers, none null or NaN, not all zero; others, and null
    keys, are neither queries nor neighbours. A repeated key counts once, with the row of
    the greatest ``version``. Ties go to the smaller key. Of more than k + 1 exact copies of
    a vector, the first k + 1 keys are indexed and the others get the first k as neighbours,
    which is the exact answer. ``least`` drops less similar neighbours (of the k, before
    the merge). ``probes`` is the number of lists searched for a vector, by default what
    ``probes_for`` measures. Other columns are not read.
    """
    spark = df.sparkSession
    v = F.col("v")
    cols = df.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("v"), (F.col(version) if version else F.lit(0)).alias("at"))
    cols = cols.filter(F.col("key").isNotNull() & (F.size(v) == dim)).filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))
    vectors = cut(cols.groupBy("key").agg(F.max_by("v", "at").alias("v")).withColumn("same", F.xxhash64("v")))
    total = vectors.count()
    schema = "key string, neighbour string, similarity double"
    if not total:
        return spark.createDataFrame([], schema + ", rank int")
    drawn = vectors.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / total) * (1 << 20)))).select("v").toArrow()
    sample = np.asarray(drawn.column(0).combine_chunks().flatten(), np.float32).reshape(-1, dim)
    if not len(sample):
        sample = np.asarray(vectors.select("v").limit(1).toArrow().column(0).combine_chunks().flatten(), np.float32).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(fit(sample, total))
    probes = probes or probes_for(vectors, shared, total, k, dim)
    many = vectors.groupBy("same").count().filter(F.col("count") > k + 1).select("same")
    first = vectors.join(many, "same", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("key"))).filter(F.col("n") <= k + 1)
    core = vectors.join(many, "same", "left_anti").unionByName(first.drop("n"))
    rest = vectors.join(many, "same", "left_semi").join(first.select("key"), "key", "left_anti")
    copies = rest.select("key", "same").join(first.filter(F.col("n") <= k).select(F.col("key").alias("neighbour"), "same"), "same").select("key", "neighbour", F.lit(1.0).alias("similarity"))
    placed = core.select("key", "v", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)).alias("part")).mapInArrow(_assign(shared, dim, probes), "list int, block int, key string, stored boolean, vec binary")
    bytes_ = total * min(probes, len(shared.value.centroids)) * (4 * dim + 64)
    placed = placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // TASK_BYTES)), "list", "block")
    hits = placed.groupBy("list", "block").applyInArrow(_search(shared, dim, k, least), schema)
    order = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.unionByName(copies.withColumn("rank", F.row_number().over(order)))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(read(spark, sf_dir, "chunks"), "chunk_id", "embedding", "ingested_at")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(read(spark, sf_dir, "chunks"), "chunk_id", "embedding", "ingested_at", least=0.90)
    return near.select(F.least("key", "neighbour").alias("chunk_id_a"), F.greatest("key", "neighbour").alias("chunk_id_b")).distinct()


QUERIES = {"p5_found": found, "p5_neighbours": neighbours}
ORACLES = {
    "p5_found": """
WITH v AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
u AS (SELECT chunk_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE list_inner_product(e, e) > 0),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_inner_product(a.e, b.e) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
r AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5 AND s >= 0.90)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r"""
}
