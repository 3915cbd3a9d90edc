"""Settings: defaults, a file, and what the caller sets, merged in this order."""

from __future__ import annotations

import json
import re
from dataclasses import fields
from pathlib import Path

from quire.operators.chunker import Options

#: Names under which a settings file is looked for.
FILES = ("quire.config.json", ".quire.json")


def merged(*settings: dict | None) -> dict:
    """Settings merged from left to right: groups by name, lists and values replaced; None never replaces anything."""
    out: dict = {}
    for s in settings:
        for k, v in (s or {}).items():
            if isinstance(v, dict):
                out[k] = merged(out[k] if isinstance(out.get(k), dict) else {}, v)
            elif v is not None:
                out[k] = v
    return out


def load(folder: str | None = None, file: str | None = None, overrides: dict | None = None) -> dict:
    """The settings of a file (given, or found in a folder) under the caller's. ValueError for a file that is no JSON object."""
    found = [Path(file)] if file else [p for n in FILES if folder and (p := Path(folder, n)).exists()]
    read: dict = {}
    if found:
        try:
            read = json.loads(found[0].read_text("utf-8"))
        except ValueError as e:
            raise ValueError(f"{found[0]}: {e}") from e
        if not isinstance(read, dict):
            raise ValueError(f"{found[0]}: not an object")
    return merged(read, overrides)


def chunk_options(settings: dict) -> Options:
    """The chunker's options under ``chunk``; unknown names and wrong limits are errors."""
    given = settings.get("chunk", {})
    unknown = set(given) - {f.name for f in fields(Options)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Options(**given).checked()


def read_env(path: str) -> dict[str, str]:
    """NAME=VALUE lines of a file, quotes and comments after a blank removed; nothing is set. No file, no values."""
    out = {}
    for line in Path(path).read_text("utf-8").splitlines() if Path(path).exists() else []:
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
        if m:
            quoted = re.fullmatch(r"(['\"])(.*)\1", m.group(2))
            out[m.group(1)] = quoted.group(2) if quoted else m.group(2).split(" #")[0].strip()
    return out
