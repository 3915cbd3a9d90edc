"""Places of chunks on their pages: by the text they share with the pages' blocks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters at a text's edges by which a block that goes on over it is known; shorter keys match as whole lines only.
EDGE, SHORT = 40, 4
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def key_of(text: str) -> str:
    """Letters and digits of a text in compatibility forms and lower case: what markup, blanks and hyphens leave alone."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


@F.arrow_udf(T.StringType())
def locate_key(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else key_of(t) for t in text.to_pylist()], pa.string())


def covers(text: Column, key: Column, block: Column, block_key: Column) -> Column:
    """Whether a text covers a block: holds it, lies in it, or shares an edge with it; short blocks must be a line of the text."""
    line = lambda t: F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    short = (block_key == key) | F.array_contains(line(text), F.trim(block))
    over = F.contains(block_key, key) | F.contains(block_key, F.substring(key, 1, EDGE)) | F.contains(block_key, F.right(key, F.lit(EDGE)))
    met = F.when(F.length(block_key) < SHORT, short).otherwise(F.contains(key, block_key) | ((F.length(block_key) >= EDGE) & over))
    return F.coalesce((key != "") & (block_key != "") & met, F.lit(False))


def located(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, page_number, block_id): the blocks on a chunk's pages that its text covers.

    chunks: chunk_id, document_id, raw_content, page_start, page_end; blocks: document_id,
    page_number, block_id, text. A range join on pages, made an equi-join; keys are made once
    a row before it. Null and empty texts are nowhere.
    """
    keyed = chunks.select("chunk_id", "document_id", "page_start", "page_end", F.col("raw_content").alias("t"), locate_key("raw_content").alias("k")).filter("k <> '' AND page_start <= page_end")
    pages = keyed.select("chunk_id", "document_id", "t", "k", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    spans = blocks.select("document_id", "page_number", "block_id", F.col("text").alias("bt"), locate_key("text").alias("bk")).filter("bk <> ''")
    met = pages.join(spans, ["document_id", "page_number"]).filter(covers(F.col("t"), F.col("k"), F.col("bt"), F.col("bk")))
    return met.select("chunk_id", "document_id", "page_number", "block_id").distinct()


def document_layout(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a block: document_id, page_number, block_id, kind, box, label, confidence, chunk_ids (sorted) and
    continues: the last table of the page before, where a table begins a page and that table ended its page with as many columns."""
    ids = located(chunks, blocks).groupBy("document_id", "block_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    columns = F.size(F.split(F.regexp_replace(F.trim(F.split("text", "\n")[0]), r"^\||\|$", ""), r"(?<!\\)\|"))
    tables = blocks.filter("kind = 'table' AND box IS NOT NULL").select("document_id", "page_number", "block_id", "n", columns.alias("columns"), F.col("box.y").alias("top"), (F.col("box.y") + F.col("box.h")).alias("bottom"))
    per_page = tables.groupBy("document_id", "page_number").agg(F.min(F.struct("n", "block_id", "columns", "top")).alias("first"), F.max(F.struct("n", "block_id", "columns", "bottom")).alias("last"))
    after = per_page.select("document_id", (F.col("page_number") + 1).alias("page_number"), F.col("last").alias("before"))
    goes_on = per_page.join(after, ["document_id", "page_number"]).filter("first.columns = before.columns AND before.bottom >= 0.8 AND first.top <= 0.2")
    continued = goes_on.select("document_id", F.col("first.block_id").alias("block_id"), F.col("before.block_id").alias("continues"))
    out = blocks.join(ids, ["document_id", "block_id"], "left").join(continued, ["document_id", "block_id"], "left")
    return out.select("document_id", "page_number", "block_id", "kind", "box", "label", "confidence", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), "continues")
