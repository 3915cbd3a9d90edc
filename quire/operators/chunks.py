"""Chunk tables: ids, content, neighbours, positions, upserts and the stage cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_ids(chunks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """Adds new_id: twelve characters of the document's id, sixteen of the text's SHA-256, and -2, -3 ... for repeats in order."""
    digest = F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)
    w = Window.partitionBy(document, "_digest").orderBy(order)
    n = F.row_number().over(w)
    base = F.concat_ws("-", F.substring(document, 1, 12), "_digest")
    return chunks.withColumn("_digest", digest).withColumn("new_id", F.when(n == 1, base).otherwise(F.concat_ws("-", base, n.cast("string")))).drop("_digest")


def build_content(summary: Column, overlap: Column, raw: Column) -> Column:
    """Context line, overlap and raw text, blank lines between; empty and null parts left out."""
    part = lambda c: F.when(c != "", c)
    return F.concat_ws("\n\n", F.when(summary != "", F.concat(F.lit("Context: "), summary)), part(overlap), part(raw))


def linked(chunks: DataFrame, document: str, order: str, key: str) -> DataFrame:
    """Adds previous_id and next_id within the document."""
    w = Window.partitionBy(document).orderBy(order, key)
    return chunks.withColumn("previous_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def neighbours(chunks: DataFrame, wanted: DataFrame, document: str, order: str, key: str, radius: int) -> DataFrame:
    """(chunk, neighbour, distance): up to ``radius`` chunks on either side, in order of the document."""
    at = chunks.select(F.col(document).alias("d"), F.col(key).alias("k"), F.row_number().over(Window.partitionBy(document).orderBy(order, key)).alias("n"))
    asked = at.join(wanted.select(F.col(key).alias("k")).distinct(), "k").select("d", F.col("k").alias("chunk"), F.explode(F.sequence(F.col("n") - radius, F.col("n") + radius)).alias("n"), F.col("n").alias("own"))
    return asked.join(at, ["d", "n"]).select("chunk", F.col("k").alias("neighbour"), (F.col("n") - F.col("own")).cast("int").alias("distance"))


def page_sources(chunks: DataFrame, pages: DataFrame, document: str, key: str) -> DataFrame:
    """(key, sources): distinct sources of the pages a chunk spans, sorted; a range join made an equi-join on pages."""
    spanned = chunks.filter(F.col("page_start") <= F.col("page_end")).select(document, key, F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    named = spanned.join(pages.select(document, "page_number", F.col("source").alias("s")), [document, "page_number"])
    return named.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("s")), "+").alias("sources"))


def upserted(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The target after an upsert: the batch's rows, and the target's rows with other keys."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def replaced(target: DataFrame, batch: DataFrame, document: str, key: str) -> DataFrame:
    """The target after documents were replaced: stale rows of the batch's documents are gone too."""
    kept = target.join(batch.select(document).distinct(), document, "left_anti")
    return kept.unionByName(batch.dropDuplicates([key]))


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Adds batch: rows of a group in runs of ``size``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


def consecutive_batches(rows: DataFrame, group: str, index: str, size: int) -> DataFrame:
    """Adds run and batch: runs of consecutive indexes (gaps and islands), cut after every ``size`` rows."""
    w = Window.partitionBy(group).orderBy(index)
    island = rows.withColumn("run", F.col(index) - F.row_number().over(w))
    inside = F.row_number().over(Window.partitionBy(group, "run").orderBy(index)) - 1
    return island.withColumn("batch", F.floor(inside / size))


def common_prefix(a: Column, b: Column) -> Column:
    """The common first elements of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda k, i: F.when((k == i) & (i < n) & (F.get(a, i) == F.get(b, i)), k + 1).otherwise(k))
    return F.slice(a, 1, same)


def merged_type(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(F.lit("mixed"))


def byte_batches(rows: DataFrame, group: str, order: list[str], bytes_: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Adds batch: rows of a group in order, a new batch where the next row would exceed either limit; a larger row is alone."""
    w = Window.partitionBy(group).orderBy(*order)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(bytes_, F.lit(0)).cast("long").alias("b")))), lambda x: x["b"])
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        new = (s["n"] > 0) & ((s["n"] >= most_rows) | (s["size"] + b > most_bytes))
        number = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, b).otherwise(s["size"] + b).alias("size"), number.alias("batch"), F.concat(s["out"], F.array(number)).alias("out"))

    per_group = rows.groupBy(group).agg(F.aggregate(listed, start, step)["out"].alias("_batches"))
    return rows.withColumn("_n", F.row_number().over(w)).join(per_group, group).withColumn("batch", F.element_at("_batches", F.col("_n"))).drop("_n", "_batches")


def format_chunk(key: Column, source: Column, first: Column, last: Column, path: Column, context: Column, raw: Column) -> Column:
    """A chunk as it is cited: id, source, pages and place, then its context and its text."""
    pages = F.when(first == last, F.concat(F.lit("page "), first.cast("string"))).otherwise(F.concat(F.lit("pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    place = F.when(F.size(path) > 0, F.concat(F.lit(" — "), F.array_join(path, " › "))).otherwise("")
    said = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("["), key, F.lit("] "), F.coalesce(source, F.lit("")), F.lit(", "), pages, place, F.lit("\n"), said, F.coalesce(raw, F.lit("")))


def page_text(pages: DataFrame, document: str, page: int, by: str = "document_id") -> str:
    """One page's text for a reader, by the document's id or another column that names it. Raises LookupError for what there isn't."""
    found = pages.filter(F.col(by) == document)
    r = found.filter(F.col("page_number") == page).select("markdown").limit(1).collect()
    if r:
        return r[0][0] or "(no text on this page)"
    raise LookupError(f"page {page} not found" if not found.isEmpty() else f"unknown document: {document}")
