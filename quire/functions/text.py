"""Scalar text functions. Native expressions where Spark has them, Arrow functions elsewhere."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS_PER_TOKEN = 3.5
_MARKS = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents; the dotless i counts as i."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().replace("ı", "i").replace("̇", "")


def tokens_of(text: str | None) -> list[str]:
    """Search tokens: folded words of two or more characters, and the first five letters of those of more than six."""
    out = []
    for w in _WORD.findall(fold(text or "")):
        if len(w) > 1:
            out.append(w)
            if len(w) > 6:
                out.append(w[:5] + "*")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def search_tokens(text: pd.Series) -> pd.Series:
    return text.map(tokens_of)


@F.pandas_udf(T.StringType())
def match_text(text: pd.Series) -> pd.Series:
    """Text as evidence is compared: compatibility forms, lower case, markdown signs as blanks, single blanks. Null stays null."""
    return text.map(lambda t: None if t is None else " ".join(re.sub(r"[*_`#>|\\]", " ", unicodedata.normalize("NFKC", t).lower()).split()))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def letter_share(text: Column) -> Column:
    """Letters among the characters that aren't blank; 0 for a text without any."""
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(visible > 0, F.regexp_count(text, F.lit(r"\p{L}")) / visible).otherwise(0.0)


def is_low_quality(text: Column) -> Column:
    """Under 40 characters, or letters and digits under 45 % of them, blanks folded."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return (F.length(t) < 40) | (F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) < 0.45 * F.length(t))


def is_garbled(text: Column) -> Column:
    """At least 20 visible characters, more than a tenth of them control, private or replacement ones."""
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    return (F.length(visible) >= 20) & (F.regexp_count(visible, F.lit(r"[\x00-\x1f\x7f-\x9f-�]")) > 0.1 * F.length(visible))


def point_id(key: Column) -> Column:
    """A UUID-shaped id from the SHA-256 of a key: version 5, variant bits set."""
    h = F.sha2(key, 256)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def low_confidence(confidence: Column, least: float = 0.8) -> Column:
    return confidence < least
