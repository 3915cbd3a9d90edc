"""Spreadsheet scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def serial_to_date(serial: Column, epoch_1904: bool = False) -> Column:
    """The date of a serial day number. In the 1900 system days up to 60 count from one day later, for the day that never was."""
    whole = F.floor(serial).cast("int")
    if epoch_1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), whole)
    return F.date_add(F.lit("1899-12-30").cast("date"), whole + F.when(whole < 60, 1).otherwise(0))


def serial_to_iso(serial: Column, with_time: bool = False, epoch_1904: bool = False) -> Column:
    day = F.date_format(serial_to_date(serial, epoch_1904), "yyyy-MM-dd")
    if not with_time:
        return day
    minutes = F.floor((serial - F.floor(serial)) * 1440 + F.lit(1e-6))
    return F.concat(day, F.lit(" "), F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("int").cast("string"), 2, "0"))


def column_index(letters: Column) -> Column:
    """0 for A, 25 for Z, 26 for AA; other characters are passed over."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c.rlike("^[A-Z]$"))
    return F.aggregate(chars, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def is_date_format(fmt: Column) -> Column:
    """A number format that shows a date: y, m or d outside quotes, brackets and escapes, and not a time only."""
    bare = F.regexp_replace(F.lower(fmt), r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return bare.rlike("[yd]") | (bare.rlike("m") & ~bare.rlike("[hs]"))
