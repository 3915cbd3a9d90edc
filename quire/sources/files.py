"""Files as rows: listing, kind detection and reading, with native expressions on the bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, office


def detect_kind(content: Column, path: Column) -> Column:
    """pdf, png, jpeg, webp, docx, pptx, xlsx, html, markdown, text or unknown: by signature, then extension, then looks."""
    head = F.hex(F.substring(content, 1, 12))
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    start = F.substring(content, 1, 4096)
    as_text = F.when(F.is_valid_utf8(start.cast("string")), start.cast("string"))
    package = F.substring(content, 1, 1 << 20).cast("string")
    zipped = F.when(F.contains(package, F.lit("word/")), "docx").when(F.contains(package, F.lit("ppt/")), "pptx").when(F.contains(package, F.lit("xl/")), "xlsx")
    markup = F.lower(F.substring(as_text, 1, 2048)).rlike(r"^﻿?\s*(?:<!--.*?-->\s*)*(?:<!doctype html|<html)")
    readable = as_text.isNotNull() & ~as_text.rlike(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when(head.startswith("504B0304"), F.coalesce(zipped, F.when(ext.isin("docx", "pptx", "xlsx"), ext), F.lit("unknown")))
        .when(ext.isin("html", "htm", "xhtml"), "html")
        .when(ext.isin("md", "markdown", "mdx"), "markdown")
        .when(markup, "html")
        .when(readable, F.when(ext == "txt", "text").otherwise("text"))
        .otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str, glob: str = "*", output: str | None = None) -> DataFrame:
    """path, length, content, kind and document_id (SHA-256 of the bytes) of all files below a path.

    Empty, hidden and dependency files are left out, as is what lies below ``output``, the
    folder results are written to.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    kept = files.filter((F.col("length") > 0) & ~F.col("path").rlike(r"/(?:\.[^/]+|node_modules)(?:/|$)"))
    if output is not None:
        plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
        kept = kept.filter(~plain.startswith(re.sub(r"^[a-z]+:/*", "/", output).rstrip("/") + "/"))
    return kept.select("path", "length", "content", detect_kind(F.col("content"), F.col("path")).alias("kind"), F.sha2("content", 256).alias("document_id"))


def documents(files: DataFrame) -> DataFrame:
    """document_id, path, kind, markdown of the files that can be read here; pictures and PDF files need a reader and give null."""
    as_text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    body = F.when(F.col("kind").isin("markdown", "text"), as_text).when(F.col("kind") == "html", html.to_markdown(F.when(F.col("kind") == "html", as_text))).when(F.col("kind").isin("docx", "pptx", "xlsx"), office.to_markdown("kind", "content"))
    return files.select("document_id", "path", "kind", body.alias("markdown"))


QUESTIONS = "version int, documentId string, source string, model string, questions array<struct<id:int,question:string,evidence:string,page:int>>"


def question_sets(spark: SparkSession, path: str) -> DataFrame:
    """document_id, source, model, question_id, question, evidence, page of question files (JSON); a file that isn't one is an error."""
    sets = spark.read.schema(QUESTIONS).json(path, multiLine=True, mode="FAILFAST")
    rows = sets.select(F.col("documentId").alias("document_id"), "source", "model", F.explode("questions").alias("q"))
    return rows.select("document_id", "source", "model", F.col("q.id").alias("question_id"), "q.question", "q.evidence", "q.page")
