"""Objects out of a model's reply: reasoning and fences are skipped, trailing commas dropped, cut ends closed.

A reply that was cut goes back to its last closing quote or bracket: a string, number or word at the cut may lack its
end, so it goes, with its key."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|"(?:[^"\\]|\\.)*\\?\Z', re.S)
PAIR = {"{": "}", "[": "]"}


def extract(text: str | None) -> str | None:
    """The first object, as compact JSON; null if there is none or its brackets don't match."""
    if text is None:
        return None
    text = text.split("</think>", 1)[-1]
    start = text.find("{")
    if start < 0:
        return None
    open_: list[str] = []
    parts: list[str] = []
    for m in TOKEN.finditer(text, start):
        t = m.group()
        if t in PAIR:
            open_.append(t)
        elif t in "}]":
            if not open_ or PAIR[open_.pop()] != t:
                return None
            _drop_commas(parts)
        elif t[0] == '"' and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', t, re.S):
            break
        parts.append(t)
        if not open_:
            break
    if open_:
        _close(parts, open_)
    try:
        made = json.loads("".join(parts))
    except ValueError:
        return None
    return json.dumps(made, ensure_ascii=False, separators=(",", ":")) if isinstance(made, dict) else None


def _drop_commas(parts: list[str]) -> None:
    while parts and parts[-1] == ",":
        parts.pop()


def _close(parts: list[str], open_: list[str]) -> None:
    """The missing closers; a word at the cut goes, and a key without a value."""
    if parts[-1] not in PAIR and parts[-1] not in "}],:" and parts[-1][0] != '"':
        parts.pop()
    while open_:
        if open_[-1] == "{":
            if parts[-1] == ":":
                del parts[-2:]
            elif parts[-1][0] == '"' and len(parts) > 1 and parts[-2] in "{,":
                parts.pop()
        _drop_commas(parts)
        parts.append(PAIR[open_.pop()])


def extract_json(reply: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract)

    return run(reply)
