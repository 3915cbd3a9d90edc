"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quire.session import cut as cut

#: A word is a maximal run of letters or digits.
WORD = re.compile(r"[^\W_]+")
MARKS = regex.compile(r"\p{M}+")

LANGS = ("en", "tr", "de", "fr", "es")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: str) -> str:
    """Lower case without accents; the Turkish dotless i counts as i."""
    if text.isascii():
        return text.lower()
    return MARKS.sub("", unicodedata.normalize("NFKD", text.lower())).replace("ı", "i")


def words(text: str) -> list[str]:
    """Words in lower case; the capital dotted I is one letter, as its small form is."""
    return WORD.findall(text.replace("İ", "i").lower())


def strings(batch: pa.RecordBatch, i: int) -> list[str]:
    """Column i as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(i).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def offsets(lengths: list[int] | np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
