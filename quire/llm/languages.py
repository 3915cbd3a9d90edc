"""Problem 4: languages of documents and of segments in another language, by nearest centroids.

Sentences are vectors of hashed letter trigrams weighted by TF-IDF, of length 1. Each
language has several centroids, clustered on a bounded sample of sentences of labelled
documents; a sentence gets the language of the centroid with the greatest cosine, unless that
is further away than nearly all of the centroid's own sample was (distance-based rejection).
A rejected sentence has no language, here and wherever else the model is used.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LANGS, cut, read, strings

#: Bounds of the sample the centroids are fitted on: documents a language, and whole sentences a language out of all texts
#: of these documents; both drawn by a hash.
SAMPLE_DOCUMENTS, SAMPLE_UNITS = 150, 2000
FEATURES, CENTROIDS, ROUNDS = 1024, 3, 6
#: Words from which a unit is classified by itself; sentences in a row that make a segment.
LEAST_WORDS, LEAST_SENTENCES = 4, 2
#: A centroid rejects what has less than WIDENED of the cosine that all but this share of its own sample reach; it is
#: widened as questions and answers lie farther away than the statements of the sample.
REJECTED, WIDENED = 0.0005, 0.8
#: Sample units under which a language is not learnt.
LEAST_UNITS = 20

# Names and codes of the languages, after lower case and without region.
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "ingilizce"],
    "tr": ["tr", "tur", "turkish", "türkçe", "turkce", "türkisch", "turc", "turco"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "almanca"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "fransızca"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "ispanyolca"],
}

_CODE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)|`[^`\n]+`|\$\$.*?\$\$|<!--.*?-->|<[^<>\n]{1,200}>|!?\[[^\]\n]*\]\([^)\n]*\)", re.M | re.S)
#: Ends of units: the end of a sentence, a blank line, or a line before a list item, table row, heading or quotation.
_END = re.compile(r"[.!?]+[\"'”»)\]*_]*(?=\s|\Z)|\n(?=\s*\n|[ \t]*(?:[-*+|#>]|\d+[.)])|\|)")
#: Words without a digit; codes and encoded data, which mix both, are in no language.
_LETTERS = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")


class Model(NamedTuple):
    idf: np.ndarray  # (features,)
    centroids: np.ndarray  # (languages * centroids, features), unit length
    langs: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine under which a centroid rejects


def known_label(label: Column) -> Column:
    """The language a label names, or null."""
    plain = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s]+)", 1)
    table = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)))
    return F.element_at(table, plain)


def units(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, end, words, whole sentence, letters) of the sentences and other units of a text, in order; code and formulas are left out."""
    clean = _CODE.sub(lambda m: " " * (m.end() - m.start()), text)
    out, start = [], 0
    for end in [*(m.end() for m in _END.finditer(clean)), len(clean)]:
        s = clean[start:end]
        ws = _LETTERS.findall(s)
        if ws:
            first = len(s) - len(s.lstrip())
            out.append((start + first, end, len(ws), s.rstrip(" \t\n\"'”»)]*_")[-1:] in (".", "!", "?") and s[first] not in "|#", " ".join(ws).lower()))
        start = end
    return out


def features(texts: list[str]) -> np.ndarray:
    """Counts of hashed trigrams, one row a text."""
    joined = "\n".join(f" {t} " for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    end = c == 10
    row = np.cumsum(end)[: len(c) - 2] if len(c) > 2 else np.zeros(0, np.int64)
    ok = ~(end[:-2] | end[1:-1] | end[2:])
    h = (c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)) * np.uint32(668265263)
    h = (h >> np.uint32(32 - int(np.log2(FEATURES)))).astype(np.int64)
    return np.bincount((row * FEATURES + h)[ok], minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


def fit(labelled: list[tuple[str, str]], seed: int = 4) -> Model:
    """The model from (language, letters of a unit) pairs. Units nearest to another language than their label are left out before clustering."""
    rng = np.random.default_rng(seed)
    labelled = sorted(labelled)
    label, texts = [LANGS.index(lang) for lang, _ in labelled], [t for _, t in labelled]
    label_a = np.array(label, np.int64)
    counts = np.concatenate([features(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]) if texts else np.zeros((0, FEATURES), np.float32)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = vectors(counts, idf)
    present = [g for g in range(len(LANGS)) if (label_a == g).sum() >= LEAST_UNITS]
    if not present:
        return Model(idf, np.zeros((1, FEATURES), np.float32), np.zeros(1, np.int64), np.full(1, 2.0))
    mean = np.stack([x[label_a == g].mean(axis=0) for g in present])
    for _ in range(2):
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        near = np.array(present)[(x @ mean.T).argmax(axis=1)]
        mean = np.stack([x[(label_a == g) & (near == g)].mean(axis=0) if ((label_a == g) & (near == g)).any() else m for g, m in zip(present, mean)])
    cents, langs, least = [], [], []
    for g in present:
        own = x[(label_a == g) & (near == g)]
        if not len(own):
            continue
        c = own[rng.choice(len(own), CENTROIDS, replace=len(own) < CENTROIDS)]
        for _ in range(ROUNDS):
            a = (own @ c.T).argmax(axis=1)
            c = np.stack([own[a == k].mean(axis=0) if (a == k).any() else c[k] for k in range(CENTROIDS)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        s = own @ c.T
        a = s.argmax(axis=1)
        for k in np.unique(a):  # a centroid without a sample has no radius
            cents.append(c[k])
            langs.append(g)
            least.append(WIDENED * np.quantile(s[a == k, k], REJECTED))
    return Model(idf, np.stack(cents).astype(np.float32), np.array(langs), np.array(least))


def classify(texts: list[str], model: Model, reject: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(language number, or -1 where its centroid rejects; confidence) of each text: the nearest centroid's, and how much nearer it is than any of another language."""
    lang, conf = np.full(len(texts), -1), np.zeros(len(texts))
    by = [np.flatnonzero(model.langs == g) for g in range(len(LANGS))]
    for i in range(0, len(texts), 512):
        s = vectors(features(texts[i : i + 512]), model.idf) @ model.centroids.T
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best]
        each = np.stack([s[:, k].max(axis=1) if len(k) else np.zeros(len(s)) for k in by], axis=1)
        other = np.partition(each, -2, axis=1)[:, -2]
        ok = top >= model.least[best] * reject
        lang[i : i + 512] = np.where(ok, model.langs[best], -1)
        conf[i : i + 512] = np.clip((top - other) / np.maximum(top, 1e-9), 0, 1)
    return lang, conf


SEGMENTS = "array<struct<lang:string,sentences:int,words:int,start:int,end:int,confidence:double>>"
_SEGMENT_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


def _label(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            texts = strings(batch, 2)
            per = [units(t) for t in texts]
            flat = [u for us in per for u in us]
            take = [i for i, u in enumerate(flat) if u[2] >= LEAST_WORDS]
            lang, conf = np.full(len(flat), -1), np.zeros(len(flat))
            if take:
                lang[take], conf[take] = classify([flat[i][4] for i in take], model)
            # a short sentence joins a sentence beside it when both together, and the short one's nearest centroid, are of its language
            row = np.repeat(np.arange(len(per)), [len(us) for us in per])
            short = [(i, j) for i, u in enumerate(flat) if u[2] < LEAST_WORDS and u[3] for j in (i - 1, i + 1) if 0 <= j < len(flat) and row[i] == row[j] and lang[j] >= 0 and flat[j][3]]
            joins: dict[int, int] = {}
            if short:
                alone, both = classify([flat[i][4] for i, _ in short], model, False)[0], classify([f"{flat[min(x)][4]} {flat[max(x)][4]}" for x in short], model)[0]
                joins = {i: int(g) for (i, j), g, a in zip(short, both, alone) if g == a == lang[j]}
            word_rows, segment_rows, k = [], [], 0
            for us in per:
                count, sure, runs = [0] * len(LANGS), [0.0] * len(LANGS), []
                for start, end, n, whole, _ in us:
                    g = joins.get(k, int(lang[k]))
                    if g >= 0:
                        count[g] += n
                        sure[g] += n * conf[k]
                        if whole:
                            if runs and runs[-1][0] == g:
                                r = runs[-1]
                                r[1], r[2], r[4], r[5] = r[1] + 1, r[2] + n, end, r[5] + n * conf[k]
                            else:
                                runs.append([g, 1, n, start, end, n * conf[k]])
                    k += 1
                word_rows.append([*map(float, count), *sure])
                segment_rows.append([(LANGS[g], s, n, a, b, c / n) for g, s, n, a, b, c in runs if s >= LEAST_SENTENCES])
            segment_rows = [[dict(zip(("lang", "sentences", "words", "start", "end", "confidence"), x)) for x in r] for r in segment_rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_rows, pa.list_(pa.float64())), pa.array(segment_rows, _SEGMENT_TYPE)], ["document_id", "chunk_id", "words", "segments"])

    return run


def _sample_units(drawn: dict[str, str]):
    def run(batches):
        for batch in batches:
            langs, texts, places = [], [], []
            for document, text in zip(strings(batch, 0), strings(batch, 1)):
                for at, _, n, whole, letters in units(text):
                    if whole and n >= LEAST_WORDS:
                        langs.append(drawn[document])
                        texts.append(letters)
                        places.append(f"{document} {at} {letters}")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (langs, texts, places)], ["lang", "letters", "place"])

    return run


def _drawn(rows: DataFrame, by: str, n: int) -> DataFrame:
    """At most n rows a language, by a hash of a column; the limit is applied before rows are shuffled."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64(by), by)
    return rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).drop("k")


def fit_on(labels: DataFrame, chunks: DataFrame, document: str, label: str, text: str) -> Model:
    """Fits on at most SAMPLE_UNITS sentences a language, out of the whole texts of at most SAMPLE_DOCUMENTS documents a language.

    The texts are cut into sentences by the executors; only the drawn sentences come to the driver.
    """
    named = labels.select(F.col(document).cast("string").alias("document_id"), known_label(F.col(label)).alias("lang")).filter("lang IS NOT NULL AND document_id IS NOT NULL")
    drawn = {r["document_id"]: r["lang"] for r in _drawn(named.distinct(), "document_id", SAMPLE_DOCUMENTS).collect()}
    if not drawn:
        return fit([])
    theirs = chunks.select(F.col(document).cast("string").alias("document_id"), F.col(text).alias("t")).filter(F.col("document_id").isin(list(drawn)))
    sentences = theirs.mapInArrow(_sample_units(drawn), "lang string, letters string, place string")
    return fit([(r["lang"], r["letters"]) for r in _drawn(sentences, "place", SAMPLE_UNITS).collect()])


def label_languages(labels: DataFrame, chunks: DataFrame, document: str = "document_id", label: str = "doc_language", key: str = "chunk_id", text: str = "raw_content") -> tuple[DataFrame, DataFrame]:
    """(documents, segments).

    documents, one row a document id of ``labels`` or ``chunks``: label (as given), stated
    (the language it names, or null), lang (main language: that of most words), confidence
    and status (``ok``, ``missing``, ``wrong``, or ``unknown`` where no text could be
    classified, in which case lang is null). segments: the runs of two or more sentences in
    another language than the document's main one, with place, size and confidence.
    Code, formulas and units that no centroid accepts count nothing and don't break a run;
    neither do sentences under four words, unless they agree with one beside them. Null and empty texts count nothing; repeated chunks with
    the same text give one row; several labels of one document: the smallest counts. Ties
    of words go to the earlier of en, tr, de, fr, es. Other columns are not read.
    """
    spark = chunks.sparkSession
    model = spark.sparkContext.broadcast(fit_on(labels, chunks, document, label, text))
    cols = chunks.select(F.col(document).cast("string").alias("document_id"), F.col(key).cast("string").alias("chunk_id"), F.col(text))
    seen = cut(cols.mapInArrow(_label(model), f"document_id string, chunk_id string, words array<double>, segments {SEGMENTS}"))
    n = len(LANGS)
    sums = seen.groupBy("document_id").agg(*(F.sum(F.element_at("words", i + 1)).alias(f"w{i}") for i in range(2 * n)))
    top = F.greatest(*(F.col(f"w{i}") for i in range(n)))
    pick = lambda what: F.coalesce(*(F.when(F.col(f"w{i}") == top, what(i)) for i in range(n)))
    main = sums.select("document_id", F.when(top > 0, pick(lambda i: F.lit(LANGS[i]))).alias("lang"), F.when(top > 0, pick(lambda i: F.col(f"w{n + i}") / F.col(f"w{i}") * F.col(f"w{i}") / sum(F.col(f"w{j}") for j in range(n)))).otherwise(0.0).alias("confidence"))
    given = labels.groupBy(F.col(document).cast("string").alias("document_id")).agg(F.min(label).alias("label"))
    stated = known_label(F.col("label"))
    status = F.when(F.col("lang").isNull(), "unknown").when(stated.isNull(), "missing").when(stated != F.col("lang"), "wrong").otherwise("ok")
    documents = given.join(main, "document_id", "full_outer").select("document_id", "label", stated.alias("stated"), "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"))
    parts = seen.select("document_id", "chunk_id", F.explode("segments").alias("s")).select("document_id", "chunk_id", "s.*")
    segments = parts.join(main.select("document_id", F.col("lang").alias("main")), "document_id").filter(F.col("lang") != F.col("main")).dropDuplicates(["document_id", "chunk_id", "start", "end"])
    return documents, segments


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return label_languages(read(spark, sf_dir, "corpus"), read(spark, sf_dir, "chunks"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[1]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, parts = _labelled(spark, sf_dir)
    wrong = docs.filter(F.col("status").isin("missing", "wrong")).select("document_id", F.lit("").alias("chunk_id"), "lang")
    return wrong.unionByName(parts.filter("chunk_id IS NOT NULL").select("document_id", "chunk_id", "lang")).distinct()


QUERIES = {"p4_found": found, "p4_documents": documents, "p4_segments": segments}
ORACLES: dict[str, str] = {}
