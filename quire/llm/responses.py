"""Problem 2: defective prompt and response pairs with the type of the defect.

Response openings are clustered by verified MinHash. A template that recurs across prompts
with which its responses share nothing is a refusal; copy, language and termination checks
label what remains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages
from .common import LANGS, WORD, cut, fold, mix64, read, strings

#: Words of an opening; MinHash bands and rows of its pairs of words; similarity verified; documents in which a template recurs.
OPENING, BANDS, ROWS, SIMILAR, RECURS = 7, 12, 2, 0.4, 2
#: Letters from which a word of the prompt counts as content; confidence from which another language is believed.
CONTENT_LETTERS, SURE = 5, 0.12
#: Parts among which one document's responses are divided when they meet its text.
SALT = 64

# Words that stand for nothing, and labels before a repeated question.
NOTHING = {"", "null", "none", "nan", "na", "n a", "nil", "empty", "undefined", "nothing", "tbd", "todo", "unknown", "no answer", "not available", "yok", "bos", "keine", "leer", "aucun", "aucune", "vide", "rien", "ninguno", "ninguna", "nada", "vacio"}
LABELS = {"question", "q", "soru", "frage", "pregunta", "query", "prompt"}

_QUOTES = " \t\r\n​﻿\"'“”„«»‘’‹›`"
_ENDS = (".", "!", "?")
_MARKUP = re.compile(r"<!--.*?-->|<[^<>\n]{1,200}>|\\[a-zA-Z]+\*?|&#?\w{1,8};", re.S)
_STOP = re.compile(r"[.!?]+(?=[\s\"'”»)\]*_]|\Z)|\n[ \t]*\n|\n(?=[ \t]*(?:[-*+|#>]|\d+[.)]))|\n(?=\|)|\|")
_OTHER = re.compile(r"[^\w.]+|_+|(?<!\s)\.(?=\w)|(?<=\w)\.(?!\s)")


def plain(text: str | None) -> str:
    """The response without blanks and quote marks around it."""
    return (text or "").strip(_QUOTES)


def stream(text: str) -> str:
    """Words of a text with `` . `` at sentence ends, blanks between, in lower case and without accents."""
    t = _MARKUP.sub(" ", text)
    t = _STOP.sub(" \x02 ", t)
    return " " + " ".join(x if x != "\x02" else "." for x in re.findall(r"[^\W_]+|\x02", fold(t))) + " "


def is_copy(question: list[str], response: list[str]) -> bool:
    """The response's words are the question's, once or more, labels aside."""
    r = [w for w in response if w not in LABELS] if response[:1] and response[0] in LABELS else response
    q = [w for w in question if w not in LABELS] if r is not response else question
    if not q or not r:
        return False
    n, extra = divmod(len(r), len(q))
    return n > 0 and extra == 0 and r == q * n


def stops_early(response: str, document: str) -> bool:
    """``document`` (a stream) holds the response, and goes on in the same sentence after it."""
    r = stream(response.rstrip(_QUOTES + ".…([{,;:-–—"))
    key = r.rstrip(" .")
    if not key.strip():
        return False
    at, early = document.find(key), False
    while at >= 0:
        rest = document[at + len(key) :]
        if rest.startswith(" . ") or not rest.strip():
            return False  # somewhere it ends a sentence
        early = True
        at = document.find(key, at + 1)
    return early


def opening_shingles(opening: str) -> np.ndarray:
    ws = opening.split()
    grams = [" ".join(ws[i : i + 2]) for i in range(max(1, len(ws) - 1))]
    return np.array([xxhash.xxh3_64_intdigest(g) for g in set(grams)], np.uint64)


_ODD = mix64(np.arange(31, 31 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def _checks(shared):
    """Row checks: defects that need no other row, opening, and whether prompt and response share content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            questions, responses = strings(batch, 2), strings(batch, 3)
            bare = [plain(r) for r in responses]
            q_letters, r_letters = ([" ".join(languages._LETTERS.findall(t)).lower() for t in ts] for ts in (questions, bare))
            (q_lang, _), (r_lang, r_conf) = languages.classify(q_letters, model), languages.classify(r_letters, model)
            rows = []
            for i, (q, r) in enumerate(zip(questions, bare)):
                qw, rw = WORD.findall(fold(q)), WORD.findall(fold(r))
                content = {w for w in qw if len(w) >= CONTENT_LETTERS}
                related = bool(content.intersection(rw))
                other = bool(rw) and len(rw) >= 3 and q_lang[i] >= 0 and r_lang[i] >= 0 and q_lang[i] != r_lang[i] and r_conf[i] >= SURE
                if not rw or " ".join(rw) in NOTHING:
                    kind = "empty"
                elif is_copy(qw, rw):
                    kind = "copy"
                else:
                    kind = None
                open_end = not r.endswith(_ENDS) or r.endswith(("..", "…")) or bool(re.search(r"\d\.\Z", r))
                rows.append((kind, other, related, open_end, " ".join(rw[:OPENING])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bare), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())))], ["document_id", "question_id", "response", "kind", "other", "related", "open_end", "opening"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, keys = [], []
        for i, o in enumerate(strings(batch, 0)):
            least = (opening_shingles(o)[None, :] * _ODD[:, None]).min(axis=1)
            for b in range(BANDS):
                at.append(i)
                keys.append(xxhash.xxh3_64_intdigest(bytes([b]) + least[b * ROWS : (b + 1) * ROWS].tobytes()) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64())], ["opening", "band"])


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (opening, template) within the bands, of rows sorted by band and opening.

    An opening that is similar to no leader of its band becomes one; each opening is linked to
    all similar leaders, also to those that came after it. So an opening with any similar
    opening in a band has a link: if neither of the two leads, each follows a leader.
    """
    band, leaders, members = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        pairs = [(o, name) for o, x in members for name, y in leaders if len(x & y) >= SIMILAR * len(x | y)]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs)], ["opening", "template"])

    for batch in batches:
        for opening, b in zip(strings(batch, 0), batch.column(1).to_pylist()):
            if b != band:
                yield from links()
                band, leaders, members = b, [], []
            x = frozenset(opening_shingles(opening).tolist())
            if not any(len(x & y) >= SIMILAR * len(x | y) for _, y in leaders):
                leaders.append((opening, x))
            members.append((opening, x))
    yield from links()


def templates(unrelated: DataFrame) -> DataFrame:
    """Openings (with document_id) of responses that share nothing with their prompt -> the recurring ones.

    Openings of a band are linked to the band's leaders they are similar to; a template's
    documents are those of all openings linked to it. A leader is linked to itself too, so
    that an opening recurs by itself.
    """
    per = unrelated.filter("opening <> ''").groupBy("opening", "document_id").agg(F.lit(1).alias("one"))
    openings = per.groupBy("opening").agg(F.count("*").alias("n"))
    banded = cut(openings.select("opening").mapInArrow(_bands, "opening string, band long"))
    linked = banded.repartition("band").sortWithinPartitions("band", "opening").mapInArrow(_leaders, "opening string, template string").distinct()
    # documents are counted apart for each opening; a document with two openings of a template counts for both, so one
    # that recurs must have two openings or two documents, which is what repetition across prompts needs
    size = linked.join(openings, "opening").groupBy("template").agg(F.sum("n").alias("documents"))
    return linked.join(size.filter(F.col("documents") >= RECURS), "template").select("opening").distinct()


def _termination(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ids = [], []
        for i, (document, asked) in enumerate(zip(strings(batch, 1), batch.column(2).to_pylist())):
            text = stream(document)
            for a in asked:
                if stops_early(a["response"] or "", text):
                    at.append(i)
                    ids.append(a["question_id"])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64())], ["document_id", "question_id"])


def defects(pairs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(document_id, question_id, defect) of each defective pair, once each.

    ``pairs``: document_id, question_id, question, evidence; ``documents``: document_id,
    markdown; ``labels``: document_id, doc_language (to fit the language model on a bounded
    sample). Defects, the first that holds: empty, copy, refusal, other_language, truncated.
    Null and empty responses are empty; a null question can be neither copied nor of another
    language. Null ids give no rows. Rows repeated with the same texts count once; a key
    with different texts can have several defects. Other columns are not read.
    """
    spark = pairs.sparkSession
    model = spark.sparkContext.broadcast(languages.fit_on(labels, documents, "document_id", "doc_language", "markdown"))
    cols = pairs.select(F.col("document_id").cast("string"), F.col("question_id").cast("long"), "question", "evidence").filter("document_id IS NOT NULL AND question_id IS NOT NULL")
    seen = cut(cols.mapInArrow(_checks(model), "document_id string, question_id long, response string, kind string, other boolean, related boolean, open_end boolean, opening string"))
    rest = seen.filter("kind IS NULL")
    refused = templates(rest.filter("NOT related").select("opening", "document_id")).withColumn("refused", F.lit(True))
    marked = rest.join(refused, "opening", "left").withColumn("refused", F.coalesce("refused", F.lit(False)) & ~F.col("related"))
    kind = F.when(F.col("refused"), "refusal").when(F.col("other"), "other_language")
    named = cut(marked.select("document_id", "question_id", kind.alias("defect"), F.when(kind.isNull() & F.col("open_end"), F.col("response")).alias("response")).filter("defect IS NOT NULL OR response IS NOT NULL"))
    asked = named.filter("response IS NOT NULL").groupBy("document_id", F.pmod(F.xxhash64("question_id"), F.lit(SALT)).alias("part")).agg(F.collect_set(F.struct("question_id", "response")).alias("asked"))
    texts = documents.select(F.col("document_id").cast("string"), "markdown").filter("markdown IS NOT NULL")
    cut_off = texts.join(asked, "document_id").select("document_id", "markdown", "asked").mapInArrow(_termination, "document_id string, question_id long")
    return (
        seen.filter("kind IS NOT NULL").select("document_id", "question_id", F.col("kind").alias("defect"))
        .unionByName(named.filter("defect IS NOT NULL").select("document_id", "question_id", "defect"))
        .unionByName(cut_off.withColumn("defect", F.lit("truncated")))
        .distinct()
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(read(spark, sf_dir, "eval_questions"), read(spark, sf_dir, "process_results"), read(spark, sf_dir, "corpus"))


QUERIES = {"p2_found": found}
ORACLES: dict[str, str] = {}
