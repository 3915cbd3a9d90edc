"""Problem 10: repetition inside a document, as a ledger of rule bits.

Method: every rule is evaluated once for each document; its measurement is stored, and its
failure as one bit of a mask. Policies are versioned sets of rules applied to the mask, and
ablations are counted by bitwise aggregation, without going back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, read, strings, words

#: Rule name, the measurement's meaning and the threshold from which it fails. The bit is the place in this list.
RULES = (
    ("run5_share", "words in runs of five words that occurred before", 0.30),
    ("run10_share", "words in runs of ten words that occurred before", 0.20),
    ("sentence_share", "characters in sentences that occurred before", 0.30),
    ("line_share", "characters in lines that occurred before", 0.30),
    ("paragraph_share", "characters in paragraphs that occurred before", 0.30),
    ("top2_share", "words in occurrences of the most frequent pair of words", 0.20),
    ("top4_share", "words in occurrences of the most frequent run of four words", 0.16),
)
#: Versioned policies: a document is dropped when any of these rules fails.
POLICIES = {"v1": ("run5_share",), "v2": ("run5_share", "sentence_share", "paragraph_share"), "v3": tuple(r[0] for r in RULES)}


def policy_mask(version: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r[0] in POLICIES[version])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers, equal for equal pairs only."""
    return pd.factorize((a.astype(np.int64) << 32) | b)[0]


def _run_share(gram: np.ndarray, doc: np.ndarray, n: int, size: np.ndarray, docs: int) -> np.ndarray:
    """Share of the words covered by runs of n words whose number, within the document, came before."""
    again = pd.Series(_pairs(doc[: len(gram)], gram)).duplicated().to_numpy()
    again &= doc[: len(gram)] == doc[n - 1 :]
    step = np.zeros(len(doc) + 1, np.int32)
    at = np.flatnonzero(again)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[covered], minlength=docs) / np.maximum(size, 1)


def _top_share(gram: np.ndarray, doc: np.ndarray, n: int, size: np.ndarray, docs: int) -> np.ndarray:
    """Share of the words in occurrences of the most frequent run of n words, if it occurs twice or more."""
    inside = doc[: len(gram)] == doc[n - 1 :]
    d = doc[: len(gram)][inside]
    number = _pairs(d, gram[inside])
    count = np.bincount(number) if len(number) else np.zeros(0, np.int64)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, d, count[number] if len(number) else number)
    return np.minimum(1.0, np.where(top > 1, top * n, 0) / np.maximum(size, 1))


def _unit_shares(texts: list[str]) -> np.ndarray:
    """Shares of repeated sentences, lines and paragraphs of each text."""
    out = np.zeros((3, len(texts)))
    for k, t in enumerate(texts):
        # the blanks and case of a unit don't count; units without a letter or digit neither
        for row, units in ((0, t.replace("\n", " ").replace("! ", ". ").replace("? ", ". ").split(". ")), (1, t.split("\n")), (2, t.split("\n\n"))):
            if len(units) < 2:
                continue
            seen: set[str] = set()
            total = again = 0
            for u in units:
                u = u.strip(" \t\n.!?").lower()
                if not u:
                    continue
                total += len(u)
                if u in seen:
                    again += len(u)
                else:
                    seen.add(u)
            out[row, k] = again / total if total else 0.0
    return out


def measure(texts: list[str]) -> np.ndarray:
    """The measurements of RULES, one row a rule and one column a text. A text without words has zeros."""
    tokens = [words(t) for t in texts]
    size = np.array([len(t) for t in tokens], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    out = np.zeros((len(RULES), len(texts)))
    if len(doc) >= 10:
        one = pd.factorize(np.array(list(chain.from_iterable(tokens)), object))[0]
        two = _pairs(one[:-1], one[1:])
        four = _pairs(two[:-2], two[2:])
        five = _pairs(four[:-1], one[4:])
        ten = _pairs(five[:-5], five[5:])
        out[0] = _run_share(five, doc, 5, size, len(texts))
        out[1] = _run_share(ten, doc, 10, size, len(texts))
        out[5] = _top_share(two, doc, 2, size, len(texts))
        out[6] = _top_share(four, doc, 4, size, len(texts))
    elif len(doc):
        # too few words in the whole batch for the longest run: each rule by itself
        pad = measure([*texts, " ".join(f"pad{i}" for i in range(10))])
        return pad[:, :-1]
    out[2:5] = _unit_shares(texts)
    return out


#: Characters measured together; bounds the memory of a batch whatever the texts' lengths (a longer text is a batch of its own).
BATCH_CHARS = 4_000_000


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    thresholds = np.array([r[2] for r in RULES])[:, None]
    for batch in batches:
        texts = strings(batch, 1)
        block = offsets([len(t) for t in texts])[:-1] // BATCH_CHARS
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            m = measure([texts[i] for i in at])
            bits = ((m >= thresholds) << np.arange(len(RULES))[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(bits, pa.int32()), *(pa.array(x, pa.float64()) for x in m)],
                ["doc_id", "failed", *(r[0] for r in RULES)],
            )


def rule_ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, the mask ``failed`` and one measurement a rule.

    Null and empty texts, and texts without words, measure 0 in every rule and fail none.
    Repeated rows give repeated rows. Whole texts are measured. Other columns are not read.
    """
    kind = dict(df.dtypes)[key]
    schema = f"doc_id {kind}, failed int, " + ", ".join(f"{r[0]} double" for r in RULES)
    return df.select(F.col(key), F.col(text)).mapInArrow(_ledger, schema)


def apply_policy(ledger: DataFrame, version: str) -> DataFrame:
    """The ledger's rows that the policy drops."""
    return ledger.filter(F.col("failed").bitwiseAND(policy_mask(version)) != 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents dropped, and those only this rule drops."""
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))  # at most 2^rules rows
    variants = [(v, r, policy_mask(v), 1 << i) for v in POLICIES for i, (r, *_) in enumerate(RULES) if r in POLICIES[v]]
    wide = masks.select("failed", "n", F.explode(F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(p).alias("p"), F.lit(b).alias("b")) for v, r, p, b in variants))).alias("x")).select("failed", "n", "x.*")
    hit, kept = F.col("failed").bitwiseAND(F.col("p")), F.col("failed").bitwiseAND(F.col("p") - F.col("b"))
    return wide.groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("dropped"),
        F.sum(F.when((hit != 0) & (kept == 0), F.col("n")).otherwise(0)).alias("dropped_by_rule_alone"),
    )


def ledger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger(read(spark, sf_dir, "documents"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger_of(spark, sf_dir), "v1").select("doc_id").distinct()


def ablation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger_of(spark, sf_dir))


QUERIES = {"p10_found": found, "p10_ledger": ledger_of, "p10_ablations": ablation_report}
ORACLES = {
    "p10_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\\p{L}\\p{N}]+') AS ws FROM documents),
g AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
r AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, ws[i:i+4] ORDER BY i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, n, i + unnest([0, 1, 2, 3, 4]) AS p FROM r WHERE k > 1)
SELECT doc_id FROM c GROUP BY doc_id, n HAVING count(*) >= 0.3 * n"""
}
