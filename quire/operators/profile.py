"""Profiles of documents, chunks, pages and caches: one aggregate row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import estimate_tokens, letter_share

LOW_CONFIDENCE, LONG_HEADING, SPARSE = 0.8, 120, 0.4


def chunk_stats(chunks: DataFrame, group: str) -> DataFrame:
    t = F.col("token_count")
    by_type = [F.sum(F.when(F.col("content_type") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("text", "table", "code", "mixed")]
    return chunks.groupBy(group).agg(F.count("*").alias("chunks"), F.round(F.avg(t)).cast("long").alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), *by_type, F.sum(F.when(F.size("boxes") > 0, 1).otherwise(0)).alias("located"))


def structure(blocks: DataFrame, group: str) -> DataFrame:
    """Headings, tables, code blocks and estimated tokens of a document's blocks."""
    is_ = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    return blocks.groupBy(group).agg(is_("heading").alias("headings"), is_("table").alias("tables"), is_("code").alias("code_blocks"), is_("figure").alias("figures"), F.sum(estimate_tokens(F.coalesce("text", F.lit("")))).alias("tokens"), F.max("page_number").alias("last_page"))


def table_captions(blocks: DataFrame, group: str) -> DataFrame:
    """(group, block, rows, columns, caption): caption is a text of up to 200 characters right before the table."""
    w = Window.partitionBy(group).orderBy("page_number", "n")
    before = blocks.withColumn("before_kind", F.lag("kind").over(w)).withColumn("before_text", F.lag("text").over(w))
    lines = F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")
    caption = F.when((F.col("before_kind") == "text") & (F.length("before_text") <= 200), F.col("before_text")).otherwise("")
    columns = F.size(F.split(F.regexp_replace(F.trim(F.element_at(lines, 1)), r"^\||\|$", ""), r"(?<!\\)\|"))
    return before.filter("kind = 'table'").select(group, "block_id", (F.size(lines) - 2).alias("table_rows"), columns.alias("table_columns"), caption.alias("caption"))


def quality(blocks: DataFrame, pages: DataFrame, chunks: DataFrame, group: str, min_tokens: int = 64, max_tokens: int = 512) -> DataFrame:
    """The counters of a document's quality report and its flags, joined by ``|``."""
    prose = F.col("kind").isin("text", "list")
    visible = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    w = Window.partitionBy(group).orderBy("page_number", "n")
    leveled = blocks.filter("kind = 'heading'").withColumn("jump", F.when(F.coalesce("heading_level", F.lit(1)) > F.coalesce(F.lag(F.coalesce("heading_level", F.lit(1))).over(w), F.lit(99)) + 1, 1).otherwise(0))
    heads = leveled.groupBy(group).agg(F.count("*").alias("headings"), F.max(F.coalesce("heading_level", F.lit(1))).alias("max_depth"), F.sum(F.when(F.length("text") > LONG_HEADING, 1).otherwise(0)).alias("long_headings"), F.sum("jump").alias("level_jumps"))
    sure = F.col("confidence")
    body = blocks.groupBy(group).agg(
        F.count(sure).alias("ocr_blocks"),
        F.round(F.avg(sure), 3).alias("mean_confidence"),
        F.sum(F.when(sure < LOW_CONFIDENCE, 1).otherwise(0)).alias("low_confidence"),
        F.sum(F.when(prose, 1).otherwise(0)).alias("prose_blocks"),
        F.sum(F.when(prose & (visible >= 40) & (letter_share(F.col("text")) < 0.5), 1).otherwise(0)).alias("garbled_blocks"),
    )
    paged = pages.groupBy(group).agg(F.count("*").alias("pages"), F.sum(F.when(F.col("source") == "text-layer", 1).otherwise(0)).alias("text_pages"), F.sum(F.when(F.trim(F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\s+", " ")) == "", 1).otherwise(0)).alias("empty_pages"))
    # a table's cells from its rows; the line after the head divides, and holds no cell
    rows = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$"))
    cells = F.flatten(F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))))
    sparse = (F.size(cells) >= 4) & (F.size(F.filter(cells, lambda c: c == "")) > SPARSE * F.size(cells))
    captioned = F.coalesce("text", F.lit("")).rlike(r"!\[[^\]]*\S[^\]]*\]")
    shown = blocks.groupBy(group).agg(
        F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).alias("tables"),
        F.sum(F.when((F.col("kind") == "table") & sparse, 1).otherwise(0)).alias("sparse_tables"),
        F.sum(F.when(F.col("kind") == "figure", 1).otherwise(0)).alias("figures"),
        F.sum(F.when((F.col("kind") == "figure") & captioned, 1).otherwise(0)).alias("captioned"),
    )
    t = F.col("token_count")
    parts = chunks.groupBy(group).agg(F.count("*").alias("chunks"), F.sum(F.when(t < min_tokens, 1).otherwise(0)).alias("small"), F.sum(F.when(t > max_tokens, 1).otherwise(0)).alias("large"))
    zero = ["headings", "max_depth", "long_headings", "level_jumps", "ocr_blocks", "low_confidence", "prose_blocks", "garbled_blocks", "tables", "sparse_tables", "figures", "captioned", "chunks", "small", "large"]
    all_ = paged.join(body, group, "left").join(heads, group, "left").join(shown, group, "left").join(parts, group, "left").na.fill(0, zero)
    c = F.col
    flags = F.array_compact(
        F.array(
            F.when(c("empty_pages") > 0, "empty_pages"),
            F.when((c("ocr_blocks") > 0) & (c("low_confidence") > 0.1 * c("ocr_blocks")), "low_confidence"),
            F.when(c("garbled_blocks") > 0, "garbled"),
            F.when(c("sparse_tables") > 0, "sparse_tables"),
            F.when(c("long_headings") > 0, "long_headings"),
            F.when(c("level_jumps") > 0, "level_jumps"),
            F.when(c("large") > 0, "large_chunks"),
            F.when((c("chunks") >= 10) & (c("small") > 0.1 * c("chunks")), "small_chunks"),
            F.when(c("captioned") < c("figures"), "figures_without_caption"),
        )
    )
    return all_.withColumn("flags", F.array_join(flags, "|"))


def plan_estimate(docs: DataFrame, group: str, text: str, max_tokens: int = 512, batch: int = 8) -> DataFrame:
    """A dry run by formula: tokens, least chunks and model requests of each document."""
    tokens = F.sum(estimate_tokens(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    out = docs.groupBy(group).agg(F.count("*").alias("documents"), tokens.alias("tokens"), F.sum(F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 3.5 / max_tokens))).cast("long").alias("chunks"))
    return out.withColumn("requests", F.ceil(F.col("chunks") / batch).cast("long"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum(F.octet_length("value")).alias("bytes"))


def pruned(cache: DataFrame, before: Column) -> DataFrame:
    return cache.filter(F.col("created_at") >= before)


def passages(pages: DataFrame, group: str, text: str) -> DataFrame:
    """(group, n, passage): prose passages fit for questions, in order: 160 characters or more, 60 % letters, cut at 2,400."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    blocks = pages.select(group, "page_number", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n{2,}")).alias("i", "b")).withColumn("b", trim(F.col("b")))
    good = blocks.filter((F.length("b") >= 160) & ~F.col("b").rlike(r"^(\||```|#)") & (F.regexp_count("b", F.lit(r"\p{L}")) >= 0.6 * F.length("b")))
    n = F.row_number().over(Window.partitionBy(group).orderBy("page_number", "i"))
    return good.select(group, "page_number", n.alias("n"), F.substring("b", 1, 2400).alias("passage"))


def cached(rows: DataFrame, cache: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows with the cache's value, and rows it has none for; a null value (an entry that can't be read) is a miss."""
    known = cache.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value))
    return rows.join(known, keys), rows.join(known, keys, "left_anti")


def cleared(cache: DataFrame, namespace: str | None = None) -> DataFrame:
    """The cache without one namespace, or empty."""
    return cache.filter(F.col("namespace") != namespace) if namespace else cache.limit(0)


def stable_key(*parts: Column) -> Column:
    """SHA-256 of parts as JSON; structs and maps with their names in order, nulls left out of them."""
    return F.sha2(F.concat_ws(",", *(F.coalesce(F.to_json(F.struct(p.alias("v"))), F.lit("null")) for p in parts)), 256)
