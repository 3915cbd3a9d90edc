"""Ranking: BM25, cosine, reciprocal rank fusion and two-stage reranking, as DataFrame plans."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import search_tokens, tokens_of
from quire.session import cut

K1, B, RRF_K = 1.2, 0.75, 60
#: Bytes of query vectors that are sent to the workers at once; more go in blocks.
QUERY_BYTES = 16 << 20


#: Asked terms up to which these are sent to the workers; more are joined by a shuffle.
SENT_TERMS = 500_000


class Bm25(NamedTuple):
    """An index: docs holds one row a document (pool, id, dl, counts of its terms); without pools there is no column of that name."""

    docs: DataFrame
    keys: tuple[str, ...]

    @property
    def postings(self) -> DataFrame:
        """(pool, id, dl, term, tf)"""
        return self.docs.select(*self.keys, "id", "dl", F.explode("counts").alias("c")).select(*self.keys, "id", "dl", "c.term", "c.tf")

    @property
    def lengths(self) -> DataFrame:
        return self.docs.select(*self.keys, "id", "dl")

    @property
    def pools(self) -> DataFrame:
        """(pool, n, avgdl), one row a pool."""
        return self.docs.groupBy(*self.keys).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def with_stats(self, rows: DataFrame) -> DataFrame:
        """Rows with n and avgdl of their pool; without pools these are two numbers."""
        if self.keys:
            return rows.join(self.pools, list(self.keys))
        r = self.pools.first()
        return rows.withColumn("n", F.lit(int(r["n"]))).withColumn("avgdl", F.lit(float(r["avgdl"] or 0.0)))

    @property
    def terms(self) -> DataFrame:
        """(pool, term, df, idf)"""
        return self.idf(self.postings.groupBy(*self.keys, "term").agg(F.count("*").alias("df"))).select(*self.keys, "term", "df", "idf")

    def idf(self, frequencies: DataFrame) -> DataFrame:
        n, df = F.col("n"), F.col("df")
        return self.with_stats(frequencies).withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts as numbers of their tokens and counts of their terms."""
    for batch in batches:
        names, times, ends, lengths = [], [], [0], []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            counted = Counter(tokens_of(t))
            names += counted
            times += counted.values()
            ends.append(len(names))
            lengths.append(counted.total())
        counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int32())], ["term", "tf"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64()), counts], [*batch.schema.names[:-1], "dl", "counts"])


def _tokenised(rows: DataFrame) -> DataFrame:
    """Rows whose last column is a text, with dl and counts instead."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + ", dl long, counts array<struct<term:string,tf:int>>"
    return rows.mapInArrow(_counts, schema)


def bm25_index(docs: DataFrame, key: str, text: Column, pool: Column | None = None) -> Bm25:
    """Index of a collection, or of one collection for each pool (statistics never cross pools).

    One row is one document. Texts without tokens, null ones too, count in the average length
    with length 0. The index is written once; what reads it doesn't tokenise again.
    """
    keys = () if pool is None else ("pool",)
    rows = docs.select(*([] if pool is None else [pool.alias("pool")]), F.col(key).alias("id"), text.alias("body"))
    return Bm25(cut(_tokenised(rows)), keys)


#: Entries of a term by query matrix that is sent to the workers, and such matrices at most.
MATRIX, MATRICES = 4_000_000, 8
#: Documents scored together.
TOGETHER = 256


def bm25_scores(index: Bm25, queries: DataFrame, key: str, text: Column, pool: Column | None = None, sent_terms: int = SENT_TERMS, matrix: int = MATRIX, k: int | None = None) -> DataFrame:
    """(pool, query, id, score) for every document with a term of the query; only positive scores.

    A set of queries whose matrix of terms is small enough is scored a block of documents at a
    time, by one matrix product where these are; with ``k``, only what can be among a query's
    best k goes on. Otherwise asked terms meet the postings, where these are if the terms are few enough
    to be sent, so that each task adds up its documents' scores before anything is shuffled;
    and by a shuffle on the term if not.
    """
    keys = list(index.keys)
    rows = queries.select(*([pool.alias("pool")] if keys else []), F.col(key).alias("query"), text.alias("body"))
    asked = cut(_tokenised(rows).select(*keys, "query", F.explode("counts.term").alias("term")).distinct())
    n = asked.count()
    few = n <= sent_terms
    send = F.broadcast if few else lambda x: x
    names = send(asked.select(*keys, "term").distinct())
    df = index.postings.join(names, [*keys, "term"], "left_semi").groupBy(*keys, "term").agg(F.count("*").alias("df"))
    wanted = asked.join(index.idf(df), [*keys, "term"])
    if few and not keys and n:
        r = asked.agg(F.count_distinct("term").alias("t"), F.count_distinct("query").alias("q")).first()
        if r["t"] * r["q"] <= matrix * MATRICES:
            return _by_matrix(index, wanted.select("query", "term", "idf", "avgdl").toArrow(), dict(queries.dtypes)[key], matrix, k)
    tf, dl = F.col("tf"), F.col("dl")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    hits = index.postings.join(send(wanted), [*keys, "term"])
    return hits.groupBy(*keys, "query", "id").agg(F.sum(weight).alias("score")).filter("score > 0")


def _by_matrix(index: Bm25, wanted: pa.Table, q_type: str, matrix: int, k: int | None) -> DataFrame:
    """``wanted``: query, term, idf, avgdl, at most SENT_TERMS rows."""
    spark = index.docs.sparkSession
    schema = f"query {q_type}, id {dict(index.docs.dtypes)['id']}, score double"
    terms, queries = wanted.column("term").combine_chunks().dictionary_encode(), wanted.column("query").combine_chunks().dictionary_encode()
    if not len(wanted):
        return spark.createDataFrame([], schema)
    t, q, idf = terms.indices.to_numpy(), queries.indices.to_numpy(), wanted.column("idf").to_numpy()
    step, out = max(1, matrix // len(terms.dictionary)), None
    for first in range(0, len(queries.dictionary), step):
        some = (q >= first) & (q < first + step)
        m = np.zeros((len(terms.dictionary), min(step, len(queries.dictionary) - first)))
        m[t[some], q[some] - first] = idf[some]
        shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(terms.dictionary.to_pylist())}, queries.dictionary.slice(first, step), m, wanted.column("avgdl")[0].as_py()))
        got = index.docs.select("id", "dl", "counts").mapInArrow(_products(shared, k), schema)
        out = got if out is None else out.unionByName(got)
    return out


def _products(shared, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, m, avgdl = shared.value
        for batch in batches:
            counts = batch.column(2)
            values, ends = counts.flatten(), np.r_[0, np.cumsum(counts.value_lengths().fill_null(0).to_numpy())]
            known = values.field("term").dictionary_encode()
            number = np.array([at.get(w, -1) for w in known.dictionary.to_pylist()], np.int64)
            term = number[known.indices.to_numpy()] if len(values) else np.zeros(0, np.int64)
            tf = values.field("tf").to_numpy().astype(float)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            scale = K1 * (1 - B + B * batch.column(1).to_numpy().astype(float) / (avgdl or 1.0))
            weight = tf * (K1 + 1) / (tf + scale[doc])
            for first in range(0, batch.num_rows, TOGETHER):
                rows = min(TOGETHER, batch.num_rows - first)
                part = slice(ends[first], ends[first + rows])
                ok = term[part] >= 0
                w = np.zeros((rows, len(m)))
                w[doc[part][ok] - first, term[part][ok]] = weight[part][ok]
                score = w @ m
                keep = score > 0
                if k is not None and rows > k:
                    keep &= score >= -np.partition(-score, k - 1, axis=0)[k - 1 : k] - 1e-8
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), batch.column(0).take(pa.array(i + first)), pa.array(score[i, j])], ["query", "id", "score"])

    return run


def ranked(scores: DataFrame, k: int | None, by: str = "score", keys: tuple[str, ...] = ("query",), tie: str = "id") -> DataFrame:
    """Adds rank from 1: score to nine decimals descending, then ``tie``; NaN scores are dropped."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(by, 9)), tie)
    out = scores.filter(~F.isnan(by)).withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length in doubles; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, 1, n), lambda e: e.cast("double")) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return F.when((norm(x) > 0) & (norm(y) > 0), dot / (norm(x) * norm(y))).otherwise(0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def vector_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int | None) -> DataFrame:
    """(query, id, score): the k best rows of each batch for each query (all with k None), for ``ranked`` to merge.

    Queries are sent to the workers in blocks of QUERY_BYTES, one after the other through the
    driver, which never holds all; each batch is one matrix product. Rows of another size
    than the query's, null and empty ones are passed over.
    """
    asked = cut(queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v")).filter("v IS NOT NULL AND size(v) > 0"))
    q_type, id_type = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    schema = f"query {q_type}, id {id_type}, score double"
    spark, out = vectors.sparkSession, None
    cols = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    for size, n in asked.groupBy(F.size("v")).count().collect():  # a handful of sizes
        blocks = -(-n * 8 * size // QUERY_BYTES)
        for block in range(blocks):
            rows = asked.filter((F.size("v") == size) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)).toArrow()
            q = _unit(np.array(rows.column("v").to_pylist(), np.float64).reshape(-1, size))
            shared = spark.sparkContext.broadcast((rows.column("q").combine_chunks(), q))
            got = cols.filter(F.size("v") == size).mapInArrow(_scored(shared, size, k), schema)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def _scored(shared, size: int, k: int | None):
    def run(batches):
        names, q = shared.value
        for batch in batches:
            x = _unit(np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size))
            for s in range(0, len(x), 4096):
                score = q @ x[s : s + 4096].T
                if k is None or k >= score.shape[1]:
                    a, b = np.divmod(np.arange(score.size), score.shape[1])
                else:
                    # ties at the edge are kept, so that the merge can decide them by id
                    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero(score >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), batch.column(0).take(pa.array(b + s)), pa.array(score[a, b])], ["query", "id", "score"])

    return run


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query, id, score): sum of 1 / (k + rank) over rankings of (query, id, rank)."""
    parts = None
    for r in rankings:
        part = r.select("query", "id", (1 / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query", "id").agg(F.sum("part").alias("score"))


def rerank_text(path: Column, context: Column, raw: Column, most: int = 4000) -> Column:
    """What a reranker reads of a chunk: its place, its context and its text, a line each, cut at ``most`` characters."""
    part = lambda c: F.when(c != "", c)
    return F.substring(F.concat_ws("\n", part(F.array_join(path, " › ")), part(context), F.coalesce(raw, F.lit(""))), 1, most)


#: Modes by what they need; the first a caller has what is needed for is the default.
MODES = ("rerank", "hybrid", "vector", "bm25")


def search_mode(mode: str | None, vectors: bool, query_vector: bool) -> str:
    """The mode to search with: the one asked for, else hybrid where chunks and query have vectors, else bm25.

    Raises ValueError for an unknown mode and for one that lacks its vectors.
    """
    if mode is None:
        return "hybrid" if vectors and query_vector else "bm25"
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode in ("vector", "hybrid") and not (vectors and query_vector):
        raise ValueError("vector search needs vectors of the chunks and of the query")
    return mode


def has_vectors(chunks: DataFrame, column: str = "embedding") -> bool:
    """Whether all chunks have vectors of one size, not empty."""
    size = F.coalesce(F.size(column), F.lit(0))
    r = chunks.agg(F.min(size).alias("a"), F.max(size).alias("b")).first()
    return bool(r["a"]) and r["a"] == r["b"] and r["a"] > 0


def rerank(first: DataFrame, queries: DataFrame, query_text: Column, docs: DataFrame, doc_text: Column, scorer, k: int, candidates: int = 30) -> DataFrame:
    """(query, id, score, rank): the first stage's best max(k, candidates) rescored; ties keep the first stage's order.

    ``scorer`` maps two columns (query text, document text) to a score; the document's text
    (see ``rerank_text``) is cut at 4,000 characters, as a cross-encoder would.
    """
    pool = first.filter(F.col("rank") <= max(k, candidates)).select("query", "id", F.col("rank").alias("first_rank"))
    pairs = pool.join(queries.select(F.col("q").alias("query"), query_text.alias("qt")), "query").join(docs.select(F.col("d").alias("id"), F.substring(doc_text, 1, 4000).alias("dt")), "id")
    scored = pairs.select("query", "id", "first_rank", scorer(F.col("qt"), F.col("dt")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "first_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("first_rank")


def overlap_scorer(query: Column, document: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct tokens in the document."""
    q = F.array_distinct(search_tokens(query))
    return F.size(F.array_intersect(q, search_tokens(document))) / F.greatest(F.size(q), F.lit(1))
