"""Problem 8: evaluation texts leaking into training text, by pigeonhole edit matching.

A leak is a passage of PASSAGE consecutive words of a test item with at most ERRORS edited
words. Each item is cut into pieces so short that any such passage holds ERRORS + 1 whole
ones; edits can't reach them all, so one piece is found exactly (one automaton over all
pieces). Around each hit, Myers' bit-parallel distance decides over the passages, also where
the passage is exact (distance 0); the length of the exact run is measured after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fold, read, strings

PASSAGE, ERRORS = 12, 1
#: Bytes of items that one automaton may hold; more items are matched in blocks of that size.
BLOCK_BYTES = 8 << 20


class Matcher(NamedTuple):
    automaton: ahocorasick.Automaton
    items: list[list[str]]
    ids: list
    piece: int


def piece_words(passage: int, errors: int) -> int:
    """The longest piece of which any passage holds errors + 1 whole ones: e + 1 <= floor((m + 1 - p) / p)."""
    return max(1, (passage + 1) // (errors + 2))


def build(items: list[tuple], passage: int = PASSAGE, errors: int = ERRORS) -> Matcher:
    """The automaton over the folded pieces; items with fewer words than a passage match nothing."""
    p = piece_words(passage, errors)
    automaton, texts, at = ahocorasick.Automaton(), [], {}
    for k, (_, text) in enumerate(items):
        ws = WORD.findall(fold(text or ""))
        texts.append(ws)
        for i in range(0, len(ws) - p + 1, p) if len(ws) >= passage else ():
            at.setdefault(" " + " ".join(ws[i : i + p]) + " ", []).append((k, i))
    for piece, places in at.items():
        automaton.add_word(piece, (len(piece), places))
    if at:
        automaton.make_automaton()
    return Matcher(automaton, texts, [i for i, _ in items], p)


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edits, in words, that turn the pattern into some stretch of the text (Myers 1999, bit-parallel)."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        x = eq.get(w, 0)
        d0 = (((x & pv) + pv) ^ pv) | x | mv
        hp, hn = mv | ~(d0 | pv), pv & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1, hn << 1
        pv, mv = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if score < best:
            best = score
    return best


def _run(doc: list[str], at: int, item: list[str], i: int, length: int) -> tuple[int, int]:
    """First item word and length of the exact run through a hit."""
    a, b = 0, length
    while a < at and a < i and doc[at - a - 1] == item[i - a - 1]:
        a += 1
    while at + b < len(doc) and i + b < len(item) and doc[at + b] == item[i + b]:
        b += 1
    return i - a, a + b


def match(doc: list[str], joined: str, m: Matcher, passage: int = PASSAGE, errors: int = ERRORS) -> dict[int, tuple[int, int, int]]:
    """For each item with a leak: longest exact run in words, its first word in the item, least edits of a passage."""
    found: dict[int, tuple[int, int, int]] = {}
    starts, done = None, set()
    for end, (length, places) in m.automaton.iter(joined):
        if starts is None:
            starts, c = {}, 0
            for n, w in enumerate(doc):
                starts[c] = n
                c += len(w) + 1
        at = starts[end - length + 1]
        for k, i in places:
            item = m.items[k]
            first, run = _run(doc, at, item, i, m.piece)
            if (k, at - i, first) in done:
                continue
            done.add((k, at - i, first))
            # one edited word splits a passage into two runs; this one is the longer or holds the whole piece.
            # only passages through the run's end or start can be longer than the run itself
            lo, hi = max(0, min(first + run - passage - 1, i + m.piece - passage)), min(len(item), max(first + passage + 1, i + passage))
            around = doc[max(0, at - (i - lo) - errors) : at + (hi - i) + errors]
            near = set(item[lo:hi])
            if sum(w in near for w in around) < passage - errors:  # each edit spends one word at most
                continue
            edits = passage
            for start in range(max(0, i + m.piece - passage), min(i, len(item) - passage) + 1):
                edits = min(edits, myers(item[start : start + passage], around))
                if not edits:
                    break
            if edits > errors:
                continue
            old = found.get(k, (0, 0, passage))
            found[k] = (*max((run, -first), (old[0], -old[1])), min(edits, old[2]))
    return {k: (run, -first, e) for k, (run, first, e) in found.items()}


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shared, passage: int, errors: int) -> Matcher:
    """One automaton a worker process, under the name its items got when they were sent."""
    if shared.name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shared.name] = build(shared.items.value, passage, errors)
    return _MATCHERS[shared.name]


class _Shared(NamedTuple):
    name: str
    items: object


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", passage: int = PASSAGE, errors: int = ERRORS) -> DataFrame:
    """One row for each document and leaked item.

    Columns: the two ids, item_words, longest_run (exact words), run_start (word of the item),
    edits (least edited words of a passage, 0 if longest_run reaches the passage) and
    kind (``full`` if the whole item is there, ``partial``, or ``edited`` for passages found
    only with an edit). Words are compared without case, accents, punctuation or markup
    signs. Null and empty texts and items shorter than a passage give no rows; repeated
    rows of either side give one row a pair of ids. The items are sent to the executors in
    blocks of at most BLOCK_BYTES, measured first; the documents are never shuffled.
    """
    spark = docs.sparkSession
    left = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter(F.length("t") > 0)
    total = left.agg(F.coalesce(F.sum(F.octet_length("t") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    d_type, i_type = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {d_type}, item_id {i_type}, item_words int, longest_run int, run_start int, edits int"
    source, item_arrow = docs.select(F.col(doc_id), F.col(text)), None
    out = None
    for b in range(blocks):
        part = left if blocks == 1 else left.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        rows = part.toArrow()
        item_arrow = rows.schema.field(0).type
        value = spark.sparkContext.broadcast(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
        part = source.mapInArrow(_matches(_Shared(uuid4().hex, value), passage, errors, item_arrow), schema)
        out = part if out is None else out.unionByName(part)
    out = out.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max(F.struct("longest_run", -F.col("run_start"))).alias("r"), F.min("edits").alias("edits"))
    run = F.col("r.longest_run")
    kind = F.when(run >= F.col("item_words"), "full").when(run >= passage, "partial").otherwise("edited")
    return out.select("doc_id", "item_id", "item_words", run.alias("longest_run"), (-F.col("r.col2")).alias("run_start"), "edits", kind.alias("kind"))


def _matches(shared: _Shared, passage: int, errors: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(shared, passage, errors)
        for batch in batches:
            at, ids, rows = [], [], []
            for n, t in enumerate(strings(batch, 1)):
                if not t or not len(m.automaton):
                    continue
                doc = WORD.findall(fold(t))
                for k, (longest, first, edits) in match(doc, f" {' '.join(doc)} ", m, passage, errors).items():
                    at.append(n)
                    ids.append(m.ids[k])
                    rows.append((len(m.items[k]), longest, first, edits))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids, item_type), *(pa.array(c, pa.int32()) for c in zip(*rows))], ["doc_id", "item_id", "item_words", "longest_run", "run_start", "edits"])

    return run


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "heldout_items"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches at distance 0: passages of twelve words without an edit, whose exact run is checked."""
    return leaked(spark, sf_dir).filter((F.col("edits") == 0) & (F.col("longest_run") >= PASSAGE)).select("doc_id", "item_id")


QUERIES = {"p8_found": found, "p8_leaks": leaked}
_WORDS = "regexp_extract_all(replace(lower(strip_accents({})), 'ı', 'i'), '[\\p{{L}}\\p{{N}}]+')"
ORACLES = {
    "p8_found": f"""
WITH i AS (SELECT item_id, {_WORDS.format("item_text")} AS ws FROM heldout_items),
d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
iw AS (SELECT DISTINCT item_id, array_to_string(ws[k:k+11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i WHERE len(ws) >= 12)),
dw AS (SELECT doc_id, array_to_string(ws[k:k+11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM d WHERE len(ws) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""
}
