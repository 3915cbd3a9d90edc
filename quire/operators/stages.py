"""Model steps: chunk contexts, section summaries, heading levels, questions and embeddings, with cache, batches and retries.

A model is anything with the methods of ``Model`` or ``Embedder``; the fakes here answer by
rule, so that plans can be tested. Steps run where the rows are, a batch at a time, and what
the cache holds never reaches them.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import CHARS_PER_TOKEN, is_low_quality
from quire.operators.chunker import Count, estimate, sentences, split_to_budget
from quire.operators.chunks import consecutive_batches

#: Characters of a summary; tokens of the text before a batch; part of a model's input limit that is used.
SUMMARY_CHARS, BEFORE_TOKENS, SAFETY = 600, 200, 0.8
#: Document tokens up to which a whole document is the prefix of its chunks, and part of the room it may take.
WHOLE_TOKENS, WHOLE_SHARE = 60_000, 0.9
#: Headings under which levels are left alone, and headings a request.
FEWEST_HEADINGS, HEADING_WINDOW = 3, 60


class Model(Protocol):
    ref: str
    context_tokens: int

    def contexts(self, prefix: str, chunks: list[tuple[int, str, str]]) -> dict[int, str]:
        """A context for each (id, section, text); ids may be missing."""

    def summary(self, text: str) -> str: ...

    def levels(self, titles: list[tuple[str, int]]) -> list[int]: ...

    def question(self, passage: str) -> tuple[str, str]:
        """(question, evidence)"""


class Embedder(Protocol):
    ref: str
    max_tokens: int
    batch: int

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class ModelError(Exception):
    """A provider's failure: whether to try again, and the wait it asks for in seconds."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None, fatal: bool = False) -> None:
        super().__init__(message)
        self.status, self.retry_after, self.fatal = status, retry_after, fatal


@dataclass
class RuleModel:
    """Answers by rule: a context names the section and the text's first words. Fails on batches that hold ``bad`` with others."""

    ref: str = "rule/1"
    context_tokens: int = 32_000
    bad: str | None = None

    def contexts(self, prefix: str, chunks: list[tuple[int, str, str]]) -> dict[int, str]:
        if self.bad is not None and len(chunks) > 1 and any(self.bad in t for *_, t in chunks):
            raise ModelError("answer cut off", 500)
        return {i: f"In {section or 'the document'}: {' '.join(text.split())[:80]}" for i, section, text in chunks}

    def summary(self, text: str) -> str:
        return next(iter(sentences(" ".join(text.split()))), "").strip()

    def levels(self, titles: list[tuple[str, int]]) -> list[int]:
        return [m.group(1).count(".") + 1 if (m := re.match(r"((?:\d+\.)*\d+)[.)]?\s", t)) else level for t, level in titles]

    def question(self, passage: str) -> tuple[str, str]:
        first = next(iter(sentences(passage)), "").strip()
        return f"What is said of {' '.join(first.split()[:3])}?", first


@dataclass
class LetterEmbedder:
    """Vectors of letter shares, of length one; the same on every machine."""

    letters: str = "aeioutnrs"
    ref: str = "letters/1"
    max_tokens: int = 2048
    batch: int = 64

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        return [unit([t.lower().count(c) / max(1, len(t)) for c in self.letters]) for t in texts]


def unit(v: list[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else list(v)


#: What some embedding models want before a text, by the model's family and the kind of text.
PREFIXES = {"nomic": {"query": "search_query: ", "document": "search_document: "}, "e5": {"query": "query: ", "document": "passage: "}}


def with_prefix(text: Column, kind: str, model: str) -> Column:
    """A text as a model's family wants it (``PREFIXES``); as it is for other models."""
    for family, by_kind in PREFIXES.items():
        if family in model.lower():
            return F.concat(F.lit(by_kind[kind]), text)
    return text


def unit_column(v: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


# ---------------------------------------------------------------- text of prompts and answers


def clamped(text: str) -> str:
    """An answer in one line, of at most SUMMARY_CHARS: cut at a sentence's end if one is not too early, else with an ellipsis."""
    t = " ".join(text.split())
    if len(t) <= SUMMARY_CHARS:
        return t
    cut = t[:SUMMARY_CHARS]
    end = max(cut.rfind(s) for s in (". ", "! ", "? "))
    return cut[: end + 1] if end > 100 else cut.rstrip() + "…"


def tail_words(text: str, tokens: int, count: Count = estimate) -> str:
    """The last words of a text that fit ``tokens``."""
    words, out = re.findall(r"\S*\s+|\S+", text), ""
    for w in reversed(words):
        if count(w + out) > tokens:
            break
        out = w + out
    return out.strip()


def chunk_block(chunks: Iterable[tuple[int, list[str], int, int, str]]) -> str:
    """Chunks (id, section path, first and last page, text) as a prompt shows them."""
    out = []
    for i, path, first, last, text in chunks:
        section = (" > ".join(path) or "(none)").replace('"', "'")
        out.append(f'<chunk id="{i}" section="{section}" pages="{first if first == last else f"{first}-{last}"}">\n{text}\n</chunk>')
    return "\n".join(out)


def json_in(answer: str) -> str:
    """The JSON value in an answer: without a fence, without what is said before and after it."""
    text = answer.strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.I | re.S)
    body = fenced.group(1).strip() if fenced else text
    start = re.search(r"[\[{]", body)
    if not start or start.start() == 0:
        return body
    end = body.rfind("}" if body[start.start()] == "{" else "]")
    return body[start.start() : end + 1] if end > start.start() else body[start.start() :]


def json_answer(ask: Callable[[str], str], prompt: str, check: Callable[[object], str | None]) -> object:
    """The checked JSON value a model answers; a wrong answer is asked for once more, with what was wrong."""
    problem = ""
    for _ in range(2):
        raw = ask(prompt + problem)
        try:
            value = json.loads(json_in(raw))
            wrong = check(value)
        except ValueError as e:
            wrong = str(e)
        if not wrong:
            return value
        problem = f"\n\nThe last answer was no valid JSON of the form asked for ({wrong}). Answer with the JSON value only."
    raise ModelError(f"no valid JSON: {wrong}")


#: HTTP states after which a request is sent again, and longest waits in seconds (own, and asked for).
AGAIN, LONGEST_WAIT, LONGEST_ASKED = {408, 409, 425, 429, 500, 502, 503, 504, 529}, 30.0, 60.0


def is_retryable(e: Exception) -> bool:
    if isinstance(e, ModelError):
        if e.fatal or e.status == 429 and re.search(r"\blimit:\s*0\b", str(e), re.I):
            return False
        return e.status in AGAIN if e.status is not None else False
    return isinstance(e, (TimeoutError, ConnectionError))


def asked_wait(e: Exception) -> float:
    """Seconds a failure asks to wait: given with it, or told in its message."""
    given = getattr(e, "retry_after", None)
    if given is None:
        m = re.search(r"retry in (\d+(?:\.\d+)?)\s*s", str(e), re.I)
        given = float(m.group(1)) if m else 0.0
    return min(LONGEST_ASKED, given)


def retried(step: Callable[[], object], retries: int = 2, base: float = 1.0, jitter: Callable[[], float] = lambda: 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """A step's result; failures that may pass are waited for, twice as long each time."""
    for attempt in range(retries + 1):
        try:
            return step()
        except Exception as e:
            if attempt == retries or not is_retryable(e):
                raise
            sleep(max(asked_wait(e), min(LONGEST_WAIT, base * 2**attempt) * jitter()))


def batch_contexts(model: Model, prefix: str, chunks: list[tuple[int, str, str]], retries: int = 0) -> dict[int, str]:
    """Contexts of a batch. A failing batch is halved, missing ones are asked for one by one; what fails alone has none."""
    if not chunks:
        return {}
    try:
        got = retried(lambda: model.contexts(prefix, chunks), retries)
    except ModelError as e:
        if e.fatal:
            raise
        if len(chunks) == 1:
            return {}
        half = -(-len(chunks) // 2)
        return batch_contexts(model, prefix, chunks[:half], retries) | batch_contexts(model, prefix, chunks[half:], retries)
    out = {i: t for i, _, _ in chunks if (t := clamped(got.get(i) or ""))}
    if len(chunks) > 1:
        for c in chunks:
            if c[0] not in out:
                out |= batch_contexts(model, prefix, [c], retries)
    return out


# ---------------------------------------------------------------- steps over tables


def context_strategy(document_tokens: int, model_tokens: int, batch: int, chunk_tokens: int, asked: str = "auto") -> str:
    """``full`` where the document fits beside a batch of chunks, else ``hierarchical``."""
    room = model_tokens - batch * (chunk_tokens + 30) - batch * 160 - 2500
    if asked == "hierarchical" or document_tokens > room and asked == "full":
        return "hierarchical"
    if asked == "full":
        return "full"
    return "full" if document_tokens <= min(room * WHOLE_SHARE, WHOLE_TOKENS) else "hierarchical"


def sections(blocks: DataFrame) -> DataFrame:
    """(document_id, section, path, text, page_start, page_end) of a block table, one row a hard section."""
    order = F.struct("block_index", "text", "page_number", "section_path")
    s = blocks.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(order)).alias("b"))
    b = F.col("b")
    return s.select("document_id", "section", F.element_at(b, 1)["section_path"].alias("path"), F.array_join(F.transform(b, lambda x: x["text"]), "\n\n").alias("text"), F.array_min(F.transform(b, lambda x: x["page_number"])).alias("page_start"), F.array_max(F.transform(b, lambda x: x["page_number"])).alias("page_end"))


def summarised(text: str, title: str, model: Model, budget: int, count: Count = estimate) -> str:
    """A section's summary; a text over the budget is summarised by parts, and these together."""
    head = f"{title}\n\n" if title else ""
    if count(text) <= budget:
        return clamped(model.summary(head + text))
    parts = [clamped(model.summary(p)) for p in split_to_budget(text, budget, count)]
    return clamped(model.summary(head + "\n".join(parts)))


def section_summaries(sections_: DataFrame, chunks: DataFrame, model: Model, budget: int) -> DataFrame:
    """(document_id, section, summary) of the sections with text and more than one chunk (document_id, section)."""
    many = chunks.groupBy("document_id", "section").count().filter("count > 1").select("document_id", "section")
    wanted = sections_.filter(F.trim("text") != "").join(many, ["document_id", "section"], "left_semi").select("document_id", "section", "path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [summarised((t or "").strip(), " > ".join(p or []), model, budget) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["document_id", "section", "summary"])

    return wanted.mapInArrow(run, f"document_id string, section {dict(sections_.dtypes)['section']}, summary string")


def document_prefixes(sections_: DataFrame, summaries: DataFrame, model: Model, budget: int) -> DataFrame:
    """(document_id, prefix): a document's summary, made of its sections' titles and summaries in order, as a prompt's prefix."""
    rows = sections_.select("document_id", "section", "path").join(summaries, ["document_id", "section"], "left").filter("summary IS NOT NULL OR size(path) > 0")
    title = F.coalesce(F.nullif(F.array_join("path", " > "), F.lit("")), F.lit("Introduction"))
    line = F.concat(F.lit("- "), title, F.coalesce(F.concat(F.lit(": "), F.col("summary")), F.lit("")))
    lists = rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    most = int(budget * CHARS_PER_TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f"<document_summary>\n{clamped(model.summary(t[:most])) or '(not available)'}\n</document_summary>" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["document_id", "prefix"])

    return lists.mapInArrow(run, "document_id string, prefix string")


def _context_step(model: Model, retries: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk_index"])
        got = batch_contexts(model, rows[0]["prefix"] or "", [(r["chunk_index"], r["section"] or "", r["raw_content"] or "") for r in rows], retries)
        return pa.table([pa.array([r[c] for r in rows], pa.string()) for c in ("chunk_id", "key")] + [pa.array([got.get(r["chunk_index"]) for r in rows], pa.string())], ["chunk_id", "key", "summary"])

    return run


def enriched(chunks: DataFrame, cache: DataFrame, model: Model, batch: int = 8, prefix: DataFrame | None = None, retries: int = 0) -> DataFrame:
    """(chunk_id, key, summary, state): contexts of chunks, from the cache or the model.

    chunks: chunk_id, document_id, chunk_index, raw_content, section_path, must_preserve;
    cache: key, value. state is ``cached``, ``new``, ``failed`` (no summary) or ``skipped``
    (too little text). The key covers the model, the prefix, the section, the text and the text before. Runs of
    consecutive chunks go to the model in batches, each in a group of its own.
    """
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    text = F.coalesce("raw_content", F.lit(""))
    section = F.coalesce(F.array_join("section_path", " > "), F.lit(""))
    base = chunks.select("chunk_id", "document_id", "chunk_index", text.alias("raw_content"), section.alias("section"), F.lag(text).over(w).alias("before"), (F.coalesce("must_preserve", F.lit(False)) | ~is_low_quality(text)).alias("fit"))
    base = base.join(prefix, "document_id", "left") if prefix is not None else base.withColumn("prefix", F.lit(""))
    parts = [F.lit(model.ref), F.sha2(F.coalesce("prefix", F.lit("")), 256), F.col("section"), F.sha2("raw_content", 256), F.sha2(F.coalesce("before", F.lit("")), 256)]
    keyed = base.withColumn("key", F.sha2(F.concat_ws("\x1f", *parts), 256))
    known = cache.groupBy("key").agg(F.min("value").alias("value"))
    looked = keyed.filter("fit").join(known, "key", "left")
    hits = looked.filter("value IS NOT NULL").select("chunk_id", "key", F.col("value").alias("summary"), F.lit("cached").alias("state"))
    pending = consecutive_batches(looked.filter("value IS NULL").select("chunk_id", "key", "document_id", "chunk_index", "raw_content", "section", "prefix"), "document_id", "chunk_index", batch)
    answered = pending.groupBy("document_id", "run", "batch").applyInArrow(_context_step(model, retries), "chunk_id string, key string, summary string")
    new = answered.withColumn("state", F.when(F.col("summary").isNull(), "failed").otherwise("new"))
    skipped = keyed.filter("NOT fit").select("chunk_id", "key", F.lit(None).cast("string").alias("summary"), F.lit("skipped").alias("state"))
    return hits.unionByName(new).unionByName(skipped)


def embedded(texts: DataFrame, key: str, text: str, cache: DataFrame, embedder: Embedder, kind: str = "document") -> DataFrame:
    """(key, vector, cached): vectors of texts, each distinct text embedded once unless the cache (cache_key, vector) holds it.

    Texts are cut at SAFETY of the model's limit first; the cache's key is of the cut text,
    the model and the kind. Null and empty texts have an empty vector.
    """
    most = int(int(embedder.max_tokens * SAFETY) * CHARS_PER_TOKEN)
    rows = texts.select(F.col(key).alias("key"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, most).alias("t"))
    keyed = rows.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", F.lit(embedder.ref), F.lit(kind), F.sha2("t", 256)), 256))
    known = cache.select("cache_key", F.transform("vector", lambda x: x.cast("double")).alias("vector")).dropDuplicates(["cache_key"]).withColumn("cached", F.lit(True))
    missing = keyed.filter("t <> ''").select("cache_key", "t").dropDuplicates(["cache_key"]).join(known.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, embedder.batch):
                part = b.slice(i, embedder.batch)
                vectors = retried(lambda: embedder.embed(part.column(1).to_pylist(), kind))  # noqa: B023
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["cache_key", "vector"])

    made = missing.mapInArrow(run, "cache_key string, vector array<double>").withColumn("cached", F.lit(False))
    vectors = known.unionByName(made)
    return keyed.join(vectors, "cache_key", "left").select("key", F.coalesce("vector", F.array().cast("array<double>")).alias("vector"), F.coalesce("cached", F.lit(False)).alias("cached"))


def questions_of(passages: DataFrame, model: Model) -> DataFrame:
    """(document_id, question_id, question, evidence, page): a question a passage (document_id, page_number, n, passage).

    Questions whose evidence is not in the passage, blanks aside, are dropped; the rest are
    numbered from 1 in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, p in enumerate(b.column(3).to_pylist()):
                q, e = model.question(p or "")
                if e and " ".join(e.split()) in " ".join((p or "").split()):
                    at.append(i)
                    rows.append((q, e))
            part = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], [])))], ["document_id", "page", "n", "question", "evidence"])

    made = passages.select("document_id", F.col("page_number").cast("int"), F.col("n").cast("int"), "passage").mapInArrow(run, "document_id string, page int, n int, question string, evidence string")
    return made.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("n")).alias("question_id"), "question", "evidence", "page")


def heading_levels(headings: DataFrame, model: Model) -> DataFrame:
    """(document_id, line, new_level) by a model, of headings (document_id, line, level, title): windows of HEADING_WINDOW, documents with few headings left out."""
    w = Window.partitionBy("document_id").orderBy("line")
    size = F.count("*").over(Window.partitionBy("document_id"))
    rows = headings.withColumn("size", size).filter(F.col("size") >= FEWEST_HEADINGS).withColumn("window", F.floor((F.row_number().over(w) - 1) / HEADING_WINDOW))

    def run(group: pa.Table) -> pa.Table:
        rs = sorted(group.to_pylist(), key=lambda r: r["line"])
        levels = model.levels([(r["title"], r["level"]) for r in rs])
        if len(levels) != len(rs):
            levels = [r["level"] for r in rs]
        return pa.table([pa.array([r["document_id"] for r in rs], pa.string()), pa.array([r["line"] for r in rs], pa.int32()), pa.array([min(6, max(0, v)) for v in levels], pa.int32())], ["document_id", "line", "new_level"])

    return rows.select("document_id", "line", "level", "title", "window").groupBy("document_id", "window").applyInArrow(run, "document_id string, line int, new_level int")


def usage_totals(usage: DataFrame, stage: str, *counters: str) -> DataFrame:
    """Sums a stage, and over all under the name ``total``; null stages count as ``other``."""
    named = usage.withColumn(stage, F.coalesce(stage, F.lit("other")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    return named.rollup(stage).agg(*sums, F.grouping(stage).alias("_all")).withColumn(stage, F.when(F.col("_all") == 1, "total").otherwise(F.col(stage))).drop("_all")


def registered(ref: str, registry: dict[str, Callable[[str], object]]) -> object:
    """The model a reference ``provider/name`` stands for; the provider's case doesn't count."""
    provider, _, name = ref.partition("/")
    if not name or provider.lower() not in registry:
        raise ValueError(f"no model {ref!r}")
    return registry[provider.lower()](name)
