"""Model-backed maps: prompts go to a provider, replies come back as rows.

A provider is any picklable object with ``complete(messages, tier)``. ``FakeProvider`` answers by a pure
function and is the default, so that every plan runs offline and gives the same rows on every retry.
Usage is emitted as rows, never counted in accumulators, which a task retry would count twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from quire.functions.loose_json import parse_loose
from quire.operators import endpoints
from quire.operators.extraction import TERM_FIELDS
from quire.operators.usage import FIELDS


class Provider(Protocol):
    """``counted`` is optional: it answers like ``complete`` and also tells what the call used, by the names of
    ``usage.FIELDS``; what it does not tell is 0."""

    def complete(self, messages: list[dict[str, str]], tier: str) -> str: ...


class Meter:
    """What the calls of one row used: every call counts, also one without an answer."""

    def __init__(self) -> None:
        self.used = dict.fromkeys(FIELDS, 0)

    def complete(self, client: Provider, messages: list[dict[str, str]], tier: str) -> str:
        self.used["calls"] += 1
        if not hasattr(client, "counted"):
            return client.complete(messages, tier)
        reply, sample = client.counted(messages, tier)
        for f in FIELDS[1:]:
            self.used[f] += max(0, int(sample.get(f) or 0))
        if not sample.get("total"):
            self.used["total"] += sum(max(0, int(sample.get(f) or 0)) for f in ("prompt", "completion"))
        return reply


def _reversed(text: str) -> str:
    return " ".join(reversed(text.split(" ")))


def _language(text: str) -> str:
    return next((code for code, word in (("de", " und "), ("fr", " les "), ("es", " los ")) if word in text), "en")


def _stand_in_terms(text: str) -> list[dict]:
    return [{"source": w, "target": w[::-1], "type": "术语"} for w in dict.fromkeys(text.split(" ")) if len(w) >= 12 and w.isalpha()]


def stand_in(messages: list[dict[str, str]], tier: str) -> str:
    """A deterministic answer to every task of ``quire.operators.agents``, told by the mark that its first
    message starts with; without a mark, and for translation, the words of each text reversed."""
    first, last = messages[0]["content"], messages[-1]["content"]
    task = first[1 : first.find("]")] if first.startswith("[") and len(messages) > 1 else "translate"
    if task == "language":
        return json.dumps({"language": _language(last)})
    if task == "analysis":
        names = [w for w in dict.fromkeys(last.split()) if w[:1].isupper() and w.isalpha()][:3]
        return json.dumps({"genre": "prose", "tone": _language(last), "characters": [{"source": n, "target": n[::-1]} for n in names], "terms": _stand_in_terms(last)[:3]}, ensure_ascii=False)
    if task in ("digest", "synopsis"):
        return last[:80]
    if task == "terms":
        return json.dumps({"terms": _stand_in_terms(json.loads(last)["source"])}, ensure_ascii=False)
    if task in ("review", "consistency"):
        return json.dumps({"issues": []})
    if task == "compare":
        pairs = json.loads(last)
        return json.dumps({"issues": [{"index": i, "type": "meaning", "detail": "differs"} for i, p in enumerate(pairs) if p["source"] != p["back"]]}, ensure_ascii=False)
    return json.dumps({"translations": [_reversed(t) for t in json.loads(last)]}, ensure_ascii=False)


@dataclass(frozen=True)
class FakeProvider:
    """Answers by a function of the request."""

    handler: Callable[[list[dict[str, str]], str], str] = stand_in

    def complete(self, messages: list[dict[str, str]], tier: str) -> str:
        return self.handler(messages, tier)

    def counted(self, messages: list[dict[str, str]], tier: str) -> tuple[str, dict[str, int]]:
        reply = self.complete(messages, tier)
        return reply, {"prompt": sum(len(m["content"]) for m in messages), "completion": len(reply)}


@dataclass(frozen=True)
class RetryingProvider:
    """Asks again after a failure: ``max_retries`` times, after delays that double up to the longest. A failure
    whose ``retryable`` is false, as one of credentials, is not asked again."""

    inner: Provider
    max_retries: int = 4
    first_delay: float = 1.0
    longest_delay: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, messages: list[dict[str, str]], tier: str) -> str:
        return self._again(lambda: self.inner.complete(messages, tier))

    def counted(self, messages: list[dict[str, str]], tier: str) -> tuple[str, dict[str, int]]:
        if hasattr(self.inner, "counted"):
            return self._again(lambda: self.inner.counted(messages, tier))
        return self.complete(messages, tier), {}

    def _again(self, call: Callable):
        for attempt in range(self.max_retries + 1):
            try:
                return call()
            except Exception as e:  # providers fail in ways of their own
                if attempt == self.max_retries or not getattr(e, "retryable", True):
                    raise
                self.sleep(min(self.longest_delay, self.first_delay * 2**attempt))
        raise AssertionError


PROVIDERS: dict[str, Callable[..., Provider]] = {"fake": FakeProvider} | {name: partial(endpoints.connect, name) for name in endpoints.ENDPOINTS}


def provider(name: str, **options) -> Provider:
    """A registered provider, told by its name in any case, with ``_`` or ``-``; ValueError for an unknown one."""
    known = name.strip().lower().replace("_", "-")
    known = endpoints.ALIASES.get(known, known)
    if known not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[known](**options)


def configured(settings: dict, name: str | None = None) -> RetryingProvider:
    """The provider that the settings name, or the given one, with their tiers and endpoint, asked again as they
    say. RuntimeError if its key is missing, before anything is asked."""
    name = name or settings["provider"]
    options = {} if name.strip().lower() == "fake" else {"tiers": settings["tiers"], **settings["endpoint"]}
    inner = provider(name, **options)
    if hasattr(inner, "validate"):
        inner.validate()
    return RetryingProvider(inner, **settings["retry"])


class AlignmentError(RuntimeError):
    """A provider did not return one non-blank text for a text."""


def _texts(reply: str, n: int) -> list[str] | None:
    try:
        value = parse_loose(reply)
    except ValueError:
        return None
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list) and v), None)
    if not isinstance(value, list) or len(value) != n or not all(isinstance(v, str) and v.strip() for v in value):
        return None
    return value


def translate_aligned(texts: list[str], client: Provider, retries: int = 2, tier: str = "strong", brief: list[dict[str, str]] | None = None, meter: Meter | None = None) -> tuple[list[str], int]:
    """One non-blank translation for each text, and the calls it took.

    The whole batch is tried ``retries + 1`` times, then each text once alone, then AlignmentError. A call
    that fails counts as one without an answer. ``brief`` are the messages that go before the texts, ``meter``
    counts what the calls use."""
    calls, meter = 0, meter or Meter()

    def ask(part: list[str]) -> list[str] | None:
        nonlocal calls
        calls += 1
        try:
            return _texts(meter.complete(client, [*(brief or []), {"role": "user", "content": json.dumps(part, ensure_ascii=False)}], tier), len(part))
        except Exception:  # whatever a provider raises, the next attempt may do better
            return None

    for _ in range(retries + 1):
        if (found := ask(texts)) is not None:
            return found, calls
    out = []
    for text in texts:
        if (one := ask([text])) is None:
            raise AlignmentError(f"no translation for {text[:60]!r}")
        out += one
    return out, calls


def translate_batches(batches: DataFrame, key: list[str], client: Provider | None = None, retries: int = 2) -> DataFrame:
    """Translate rows (key..., items array<string>): key..., targets, calls. Batches are independent."""
    client = client or FakeProvider()
    source = batches.select(*key, "items")
    schema = source.drop("items").schema.add("targets", ArrayType(StringType())).add("calls", IntegerType())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = [translate_aligned(x, client, retries) if x else ([], 0) for x in part.column("items").to_pylist()]
            columns = [part.column(c) for c in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in done], pa.list_(pa.string())), pa.array([n for _, n in done], pa.int32())], names=[*key, "targets", "calls"])

    return source.mapInArrow(run, schema)


def polished(texts: list[str], reply: str | None) -> list[str]:
    """The texts of a reply, or the given ones if there is none or their number differs."""
    value = parse_loose_or_none(reply)
    value = next(iter(value.values()), None) if isinstance(value, dict) else value
    return [str(v) for v in value] if isinstance(value, list) and len(value) == len(texts) else texts


def parse_loose_or_none(reply: str | None):
    try:
        return parse_loose(reply or "")
    except ValueError:
        return None


def issues_of(reply: str) -> list[dict]:
    """Issues of a reply as dicts; what is no dict is dropped; ValueError if there is no JSON."""
    value = parse_loose(reply)
    value = value.get("issues", []) if isinstance(value, dict) else value
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def terms_of(reply: str | None) -> list[dict[str, str]]:
    """The terms of a reply, as ``extraction.extracted_terms`` reads them: objects with source and target,
    fields as stripped text, the gender "unknown" as none."""
    value = parse_loose_or_none(reply)
    value = value.get("terms", value) if isinstance(value, dict) else value
    out = []
    for item in value if isinstance(value, list) else []:
        if isinstance(item, dict):
            read = {f: item.get(f) for f in TERM_FIELDS}
            text = {f: v.strip(" ") if isinstance(v, str) else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else "" for f, v in read.items()}
            if text["source"] and text["target"]:
                out.append(text | {"gender": "" if text["gender"].lower() == "unknown" else text["gender"]})
    return out
