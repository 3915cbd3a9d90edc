"""The queries of the training-data operators and the SQL equivalent to them, where there is one."""

from __future__ import annotations

from . import duplicates, languages, leaks, markup, mixing, neighbours, repetition, responses, scans, splitting

_MODULES = (markup, responses, splitting, languages, neighbours, duplicates, scans, leaks, mixing, repetition)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
