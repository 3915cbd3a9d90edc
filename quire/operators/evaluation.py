"""Retrieval evaluation: relevance by evidence, ranks, hit@k, MRR and comparison of modes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 10


def is_relevant(text: Column, evidence: Column) -> Column:
    """Both already as ``match_text``: evidence contained, or of six words or more its first or last 60 % is."""
    words = F.split(evidence, " ")
    n = F.size(words)
    part = F.ceil(n * 0.6).cast("int")
    first, last = F.array_join(F.slice(words, 1, part), " "), F.array_join(F.slice(words, n - part + 1, part), " ")
    inside = F.contains(text, evidence) | ((n >= 6) & (F.contains(text, first) | F.contains(text, last)))
    return F.coalesce((evidence != "") & inside, F.lit(False))


def first_ranks(hits: DataFrame, questions: DataFrame, chunks: DataFrame, modes: list[str]) -> DataFrame:
    """(mode, question, rank): rank of the first relevant of the top hits; 0 where there is none, also for a mode without any hit.

    hits: mode, query, id, rank; questions: q, evidence; chunks: id, text. ``modes`` are those searched with.
    """
    judged = hits.filter(F.col("rank") <= TOP).join(questions.select(F.col("q").alias("query"), "evidence"), "query").join(chunks.select("id", "text"), "id")
    best = judged.filter(is_relevant(F.col("text"), F.col("evidence"))).groupBy("mode", "query").agg(F.min("rank").alias("rank"))
    every = questions.select(F.col("q").alias("query"), F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return every.join(best, ["mode", "query"], "left").select("mode", F.col("query").alias("question"), F.coalesce("rank", F.lit(0)).alias("rank"))


def mode_metrics(ranks: DataFrame) -> DataFrame:
    """hit@1, 3, 5, 10 and MRR of each mode; misses count with 0."""
    hit = lambda k: F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0))
    return ranks.groupBy("mode").agg(
        F.count("*").alias("questions"),
        *(F.round(hit(k), 6).alias(f"hit_at_{k}") for k in (1, 3, 5, 10)),
        F.round(F.sum(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("mrr"),
    )


def best_shared_mode(modes: list[list[str]]) -> str:
    """The mode in which several reports are compared: the first of rerank, hybrid, vector and bm25 that all of them have."""
    return next((m for m in ("rerank", "hybrid", "vector", "bm25") if all(m in x for x in modes)), "bm25")


def compare_reports(reports: dict[str, DataFrame], modes: dict[str, list[str]]) -> DataFrame:
    """Several outputs against the first in their best shared mode, or one output's modes against its first.

    Each report is (mode, question, rank); the result has one row a label, as ``compare``.
    """
    labels = list(reports)
    if len(labels) == 1:
        return compare(reports[labels[0]], modes[labels[0]][0])
    mode, every = best_shared_mode([modes[x] for x in labels]), None
    for x in labels:
        one = reports[x].filter(F.col("mode") == mode).withColumn("mode", F.lit(x))
        every = one if every is None else every.unionByName(one)
    return compare(every, labels[0])


def compare(ranks: DataFrame, base: str) -> DataFrame:
    """Each mode against ``base``: questions improved and regressed, and the difference in MRR. A miss is worse than any rank."""
    value = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1_000_000)
    gain = lambda c: F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(0.0)
    first = ranks.filter(F.col("mode") == base).select("question", F.col("rank").alias("base_rank"))
    return ranks.join(first, "question").groupBy("mode").agg(
        F.sum(F.when(value("rank") < value("base_rank"), 1).otherwise(0)).alias("improved"),
        F.sum(F.when(value("rank") > value("base_rank"), 1).otherwise(0)).alias("regressed"),
        F.round(F.avg(gain("rank") - gain("base_rank")), 6).alias("delta_mrr"),
    )


def word_relevance(chunk_words: Column, evidence_words: Column) -> Column:
    """Relevance by words (three letters or more each): half of the evidence's words are in the chunk, or the chunk has
    twenty or more and 70 % of them are the evidence's. Words count as often as they occur."""
    inside = lambda a, b: F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    n, m = F.size(chunk_words), F.size(evidence_words)
    some = (n > 0) & (m > 0)
    return F.coalesce(some & ((inside(evidence_words, chunk_words) >= 0.5 * m) | ((n >= 20) & (inside(chunk_words, evidence_words) >= 0.7 * n))), F.lit(False))


def page_near(first: Column, last: Column, page: Column, by: int = 1) -> Column:
    return (first <= page + by) & (last >= page - by)


class Mulberry:
    """A generator of 32-bit numbers whose sequences are the same everywhere (Mulberry32); call for a number from 0 up to 1."""

    def __init__(self, seed: int) -> None:
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (t ^ t >> 14) / 2**32

    def shuffled(self, items: list) -> list:
        """The items in a random order (Fisher and Yates, from the end)."""
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = int(self() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out


def slice_picks(size: int, count: int, seed: int = 42) -> list[int]:
    """Places of one random item in each of ``count`` equal slices; all places where there are no more."""
    if size <= count:
        return list(range(size))
    random, out = Mulberry(seed), []
    for i in range(count):
        start, end = i * size // count, (i + 1) * size // count
        out.append(start + int(random() * max(1, end - start)))
    return out


def sampled_passages(candidates: DataFrame, group: str, count: int, seed: int = 42) -> DataFrame:
    """The candidates (group, n from 1, ...) that ``slice_picks`` takes of each group.

    Only the picks of the sizes there are go to the workers: at most ``count`` rows a size,
    joined on size and place.
    """
    size = candidates.groupBy(group).agg(F.max("n").alias("size"))
    picks = size.select("size").distinct().mapInArrow(_picks(count, seed), "size int, n int")
    return candidates.join(size.withColumn("size", F.col("size").cast("int")), group).join(picks, ["size", "n"]).drop("size")


def _picks(count: int, seed: int):
    def run(batches):
        for batch in batches:
            rows = [(int(s), p + 1) for s in batch.column(0).to_pylist() for p in slice_picks(int(s), count, seed)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (zip(*rows) if rows else ([], []))], ["size", "n"])

    return run


def round_robin(rows: DataFrame, stratum: str, key: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` rows, taken from the strata in turn, each stratum in a seeded order of its keys."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("_turn", place).orderBy("_turn", stratum).limit(count).drop("_turn")
