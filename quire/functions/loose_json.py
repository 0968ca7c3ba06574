"""Tolerant reading of JSON that a model has written.

Attempts, in order: the text itself; the inside of a code fence; the widest array, then the widest
object; the first value that can be decoded; the same after inner quotes have been escaped.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_STRING_END = re.compile(r"[ \t\r\n]*(?:[,:\]}]|\Z)")
_TOKEN = re.compile(r'\\.|"', re.S)


def escape_inner_quotes(text: str) -> str:
    """Escape quotes inside strings: a quote closes its string only if a separator or the end follows."""
    out, at, inside = [], 0, False
    for m in _TOKEN.finditer(text):
        if m[0] != '"':
            # A backslash pair protects a quote within a string only.
            if not inside and m[0] == '\\"':
                inside = True
            continue
        if not inside:
            inside = True
        elif _STRING_END.match(text, m.end()):
            inside = False
        else:
            out += (text[at : m.start()], '\\"')
            at = m.end()
    return "".join(out) + text[at:]


def _loads(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _first_value(text: str) -> tuple[bool, Any]:
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return False, None
    try:
        return True, json.JSONDecoder().raw_decode(text[min(starts) :])[0]
    except (ValueError, RecursionError):
        return False, None


def _widest(text: str) -> list[str]:
    spans = [(text.find(a), text.rfind(b)) for a, b in ("[]", "{}")]
    return [text[i : j + 1] for i, j in spans if 0 <= i < j]


def parse_loose(text: str | None) -> Any:
    """The JSON value in a text; ValueError if there is none."""
    text = (text or "").strip()
    attempts: list = [lambda: _loads(text)]
    body = text
    if not _loads(text)[0] and (m := _FENCE.search(text)):
        body = m[1].strip()
        attempts.append(lambda: _loads(body))
    repaired = escape_inner_quotes(body)
    attempts += [lambda t=t: _loads(t) for t in _widest(body)]
    attempts += [lambda: _first_value(body), lambda: _first_value(repaired)]
    attempts += [lambda t=t: _loads(escape_inner_quotes(t)) for t in (body, *_widest(body))]
    for attempt in attempts:
        ok, value = attempt()
        if ok:
            return value
    raise ValueError("no JSON value found")


@F.pandas_udf(StringType())
def loose_json(texts: pd.Series) -> pd.Series:
    """The value found, as compact JSON with sorted keys; null where there is none."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(parse_loose(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)
