"""Page text: markers, cleaning, running headers and footers, headings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARKER = r"(?i)<!--\s*page\s+\d+\s*-->"


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, markdown): pages of marked documents; text before the first marker is page 1, equal neighbours are joined.

    A null text is one empty page.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = docs.select(F.col(key), F.split(t, _MARKER).alias("p"), F.regexp_extract_all(t, F.lit(r"(?i)<!--\s*page\s+(\d+)\s*-->"), 1).alias("n"))
    lead = F.array(F.struct(F.lit(1).alias("page_number"), strip(F.element_at("p", 1)).alias("markdown")))
    rest = F.zip_with("n", F.slice("p", 2, 1_000_000_000), lambda n, p: F.struct(n.cast("int").alias("page_number"), strip(p).alias("markdown")))
    pages = F.when(F.size("n") == 0, lead).when(strip(F.element_at("p", 1)) == "", rest).otherwise(F.concat(lead, rest))
    flat = parts.select(key, F.posexplode(pages).alias("i", "x")).select(key, "i", "x.*")
    order = Window.partitionBy(key).orderBy("i")
    runs = flat.withColumn("run", F.sum(F.when(F.lag("page_number").over(order) == F.col("page_number"), 0).otherwise(1)).over(order))
    joined = runs.groupBy(key, "run", "page_number").agg(F.array_sort(F.collect_list(F.struct("i", "markdown"))).alias("m"))
    return joined.select(key, "page_number", F.array_join(F.filter(F.col("m.markdown"), lambda s: s != ""), "\n\n").alias("markdown"))


def join_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, markdown): pages in order under their markers."""
    one = F.rtrim(F.concat(F.lit("<!-- page "), F.col("page_number").cast("string"), F.lit(" -->\n\n"), F.coalesce("markdown", F.lit(""))))
    one = F.regexp_replace(one, r"\s+$", "")
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", one.alias("s")))), lambda x: x["s"]), "\n\n").alias("markdown"))


#: Rules of a page's text, in order: (pattern, replacement).
_IMAGES = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?m)^[ \t]+$", ""), (r"\n{3,}", "\n\n"))
_UNFENCED = ((r"(?is)\A\s*```(?:markdown|md)?[^\S\n]*\n(.*?)\n```\s*\z", "$1"), (_MARKER, ""), (r"\r\n?", "\n"))
_BLANKS = ((r"[ \t]+(?=\n|\z)", ""), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", ""))
_LINE = ((r"^#+\s*", ""), (r"[*_`]", ""), (r"\s+", " "), (r"^ | $", ""))


def _by_rules(text: Column, *rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in (r for rs in rules for r in rs):
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_images(text: Column) -> Column:
    """Images gone, with the blank lines they leave."""
    return _by_rules(text, _IMAGES)


def clean_page(text: Column, images: bool = True) -> Column:
    """An answer's fence unwrapped, markers and trailing blanks gone, one blank line at most; images gone unless kept."""
    return _by_rules(text, _UNFENCED, _IMAGES if images else (), _BLANKS)


def normalize_line(line: Column) -> Column:
    """A line as running lines are compared: without heading signs and emphasis, single blanks, lower case."""
    return F.lower(_by_rules(line, _LINE))


def edge_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, i, line, top, bottom): the two outer lines on either side of a page, table rows aside; outer lines are 1."""
    lines = pages.select(key, "page_number", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    kept = lines.filter(~F.col("line").rlike(r"^\s*$") & ~F.col("line").rlike(r"^\s*\|"))
    w = Window.partitionBy(key, "page_number")
    out = kept.withColumn("top", F.row_number().over(w.orderBy("i"))).withColumn("bottom", F.row_number().over(w.orderBy(F.desc("i"))))
    return out.filter("top <= 2 OR bottom <= 2")


def running_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, i): lines that are running headers or footers.

    Of a document with three or more pages with text: outer-two lines equal on half of the
    pages or more, outermost lines equal on a twentieth or more, and outermost lines that
    differ by a number moving with the page on half or more; three pages at least each.
    """
    with_text = pages.filter(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != "").groupBy(key).agg(F.count("*").alias("_n")).filter("_n >= 3")
    index = pages.select(key, "page_number").withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("page_number")) - 1)
    edges = edge_lines(pages, key, text).join(with_text, key).join(index, [key, "page_number"]).withColumn("_k", normalize_line(F.col("line"))).withColumn("_outer", (F.col("top") == 1) | (F.col("bottom") == 1))
    short = edges.filter((F.length("line") <= 120) & (F.col("_k") != ""))
    half, twentieth = F.greatest(F.lit(3), F.ceil(F.col("_n") * 0.5)), F.greatest(F.lit(3), F.ceil(F.col("_n") * 0.05))
    times = short.groupBy(key, "_n", "_k").agg(F.count_distinct("page_number").alias("_all"), F.count_distinct(F.when(F.col("_outer"), F.col("page_number"))).alias("_outermost"))
    repeated = times.select(key, "_k", (F.col("_all") >= half).alias("_any"), (F.col("_outermost") >= twentieth).alias("_edge")).filter("_any OR _edge")
    by_text = short.join(repeated, [key, "_k"]).filter(F.col("_any") | (F.col("_edge") & F.col("_outer"))).select(key, "page_number", "i")
    numbered = edges.filter(F.col("_outer") & ~F.col("line").rlike(r"^\s*#") & (F.length("line") <= 80) & (F.size(F.split("_k", " ")) <= 6) & F.col("_k").rlike(r"[0-9]")).withColumn("_pattern", F.regexp_replace("_k", r"[0-9]+", "#"))
    numbers = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_k", F.lit(r"([0-9]+)"), 1), lambda x: x.cast("double") - F.col("_at"))))
    steady = numbered.select(key, "_n", "_pattern", "page_number", "top", numbers.alias("_shift")).groupBy(key, "_n", "_pattern", "_shift").agg(F.count_distinct("page_number").alias("_c")).filter(F.col("_c") >= half).select(key, "_pattern").distinct()
    return by_text.unionByName(numbered.join(steady, [key, "_pattern"]).select(key, "page_number", "i")).distinct()


def without_running_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, markdown, removed)."""
    drop = running_lines(pages, key, text).withColumn("gone", F.lit(1))
    lines = pages.select(key, "page_number", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    marked = lines.join(drop, [key, "page_number", "i"], "left")
    out = marked.groupBy(key, "page_number").agg(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("i", "line")))).alias("l"), F.coalesce(F.sum("gone"), F.lit(0)).alias("removed"))
    body = F.regexp_replace(F.regexp_replace(F.array_join(F.col("l.line"), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    whole = pages.select(key, "page_number", F.col(text).alias("whole"))
    return out.join(whole, [key, "page_number"]).select(key, "page_number", F.when(F.col("removed") > 0, body).otherwise(F.coalesce("whole", F.lit(""))).alias("markdown"), "removed")


_FENCE = re.compile(r"\s{0,3}(```|~~~)")
_PAGE_LINE = re.compile(r"<!--\s*page\s+(\d+)\s*-->", re.I)
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*")


def headings_in(text: str) -> list[tuple[int, int, str, int]]:
    """(line, level, title, page) of a text's headings outside fences; a fence ends with its own kind."""
    out, fence, page = [], "", 1
    for i, line in enumerate(text.split("\n")):
        if m := _FENCE.match(line):
            fence = m.group(1) if not fence else "" if fence == m.group(1) else fence
        elif not fence:
            if m := _PAGE_LINE.fullmatch(line.strip()):
                page = int(m.group(1))
            elif m := _HEADING.fullmatch(line):
                out.append((i, len(m.group(1)), m.group(2).strip(), page))
    return out


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title, page): ATX headings outside fences of either kind, with the page of the marker before.

    A document is one row and is read once, from top to bottom; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *h) for i, t in enumerate(b.column(1).to_pylist()) if t for h in headings_in(t)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.string(), pa.int32())))], [key, "line", "level", "title", "page"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, line int, level int, title string, page int")


def with_levels(docs: DataFrame, changes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markdown): documents with the headings' levels of ``changes`` (key, line, new_level); level 0 is a paragraph.

    Lines that are no headings, and levels beyond six, are left alone.
    """
    wanted = changes.filter("new_level BETWEEN 0 AND 6").groupBy(key).agg(F.collect_list(F.struct("line", "new_level")).alias("_changes"))
    joined = docs.select(key, F.col(text).alias("_text")).join(wanted, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, changed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t and changed:
                    to, lines = {c["line"]: c["new_level"] for c in changed}, t.split("\n")
                    for i, level, title, _ in headings_in(t):
                        new = to.get(i, level)
                        if new != level:
                            lines[i] = f"{'#' * new} {title}" if new else title
                    t = "\n".join(lines)
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "markdown"])

    return joined.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, markdown string")


def fixed_headings(docs: DataFrame, key: str, text: str, model=None) -> DataFrame:
    """(key, markdown): levels by a model where there is one (see ``stages.heading_levels``), then numbered headings harmonised."""
    found = headings(docs, key, text)
    if model is not None:
        from quire.operators.stages import heading_levels

        asked = heading_levels(found.withColumnRenamed(key, "document_id"), model).withColumnRenamed("document_id", key)
        found = found.join(asked, [key, "line"], "left").withColumn("old", F.col("level")).withColumn("level", F.coalesce("new_level", "level")).drop("new_level")
    else:
        found = found.withColumn("old", F.col("level"))
    kept = found.filter("level > 0")
    numbered = harmonized(kept, key).select(key, "line", F.col("new_level").alias("agreed"))
    changes = found.join(numbered, [key, "line"], "left").select(key, "line", F.coalesce("agreed", "level").alias("new_level"), "old").filter("new_level <> old")
    return with_levels(docs, changes, key, text)


def extracted(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markdown): a document of its pages: each cleaned, running lines removed (of three pages or more), joined under page markers."""
    cleaned = pages.select(key, "page_number", clean_page(F.coalesce(text, F.lit(""))).alias("_clean"))
    return join_pages(without_running_lines(cleaned, key, "_clean"), key)


def harmonized(found: DataFrame, key: str) -> DataFrame:
    """(key, line, level, new_level) of numbered headings: per numbering depth the most frequent level, never above the depth before.

    Depths with a single heading keep its level. Ties go to the smaller level.
    """
    number = F.regexp_extract("title", r"^((?:[0-9]+\.)*[0-9]+)[.)]?\s+\S", 1)
    numbered = found.withColumn("number", number).filter("number <> ''").withColumn("depth", F.size(F.split("number", r"\.")))
    votes = numbered.groupBy(key, "depth", "level").agg(F.count("*").alias("n"))
    best = votes.groupBy(key, "depth").agg(F.sum("n").alias("size"), F.max_by("level", F.struct("n", -F.col("level"))).alias("vote"), F.min("level").alias("first"))
    ordered = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("depth", "size", "vote"))).alias("d"))
    start = F.struct(F.lit(0).alias("previous"), F.array().cast("array<struct<depth:int,target:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        target = F.when(x["vote"] <= acc["previous"], F.least(F.lit(6), acc["previous"] + 1)).otherwise(x["vote"])
        many = x["size"] >= 2
        kept = F.when(many, target).otherwise(F.lit(None).cast("int"))
        return F.struct(F.when(many, target).otherwise(F.greatest(acc["previous"], x["vote"])).alias("previous"), F.concat(acc["out"], F.array(F.struct(x["depth"].alias("depth"), kept.alias("target")))).alias("out"))

    targets = ordered.select(key, F.explode(F.aggregate("d", start, step)["out"]).alias("x")).select(key, "x.depth", "x.target")
    return numbered.join(targets, [key, "depth"]).select(key, "line", "level", F.coalesce("target", "level").alias("new_level"))
