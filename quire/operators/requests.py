"""Requests to chat endpoints as plain dicts, by the dialect of the endpoint. Nothing here needs a network."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.config import deep_merge

Messages = list[dict[str, str]]

# What asks for JSON, and the least room for an answer where a model also reasons.
JSON_INSTRUCTION = "Output must be valid json."
LEAST_WHEN_REASONING = 4096


@dataclass(frozen=True)
class Dialect:
    """How an endpoint is told to reason, or not to, and to limit its answer.

    ``on`` and ``off`` are fields of the request, ``body_on`` and ``body_off`` fields of the raw body, where the
    text EFFORT stands for the effort asked for."""

    limit: str = "max_tokens"
    on: dict = field(default_factory=dict)
    off: dict = field(default_factory=dict)
    body_on: dict = field(default_factory=dict)
    body_off: dict = field(default_factory=dict)


EFFORT = "$effort"
# The fields that endpoints know.
DIALECTS = {
    "none": Dialect(),
    "openai": Dialect("max_completion_tokens", on={"reasoning_effort": EFFORT}, off={"reasoning_effort": "none"}),
    "deepseek": Dialect(on={"reasoning_effort": EFFORT}, body_on={"thinking": {"type": "enabled"}}, body_off={"thinking": {"type": "disabled"}}),
    "openrouter": Dialect(body_on={"reasoning": {"effort": EFFORT}}, body_off={"reasoning": {"enabled": False}}),
}


def asking_for_json(messages: Messages) -> Messages:
    """The messages with the wish for JSON in the first system message, which is added if there is none, and
    in the last user message unless that speaks of JSON itself. The given ones stay as they are."""
    out = [dict(m) for m in messages]
    spoken = lambda text: f"{text}\n\n{JSON_INSTRUCTION}"
    asked = [m for m in out if m.get("role") == "user"][-1:]
    for m in asked:
        if "json" not in m.get("content", "").lower():
            m["content"] = spoken(m.get("content", ""))
    system = next((m for m in out if m.get("role") == "system"), None)
    if system is None:
        return [{"role": "system", "content": JSON_INSTRUCTION}, *out]
    system["content"] = spoken(system.get("content", ""))
    return out


def _with_effort(fields: dict, effort: str) -> dict:
    return {k: _with_effort(v, effort) if isinstance(v, dict) else effort if v == EFFORT else v for k, v in fields.items()}


def chat_request(
    dialect: str, model: str, messages: Messages, json_mode: bool = False, max_tokens: int | None = None, reasoning: bool = True, effort: str = "high", overrides: dict | None = None
) -> dict:
    """A request in a dialect; ValueError for an unknown one. ``overrides`` win over what the dialect puts
    into the raw body. A limit is raised to LEAST_WHEN_REASONING where the model reasons."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(DIALECTS)}")
    d = DIALECTS[dialect]
    out = {"model": model, "messages": asking_for_json(messages) if json_mode else messages, "stream": False}
    if json_mode:
        out["response_format"] = {"type": "json_object"}
    out |= _with_effort(d.on if reasoning else d.off, effort)
    if body := deep_merge(_with_effort(d.body_on if reasoning else d.body_off, effort), overrides or {}):
        out["extra_body"] = body
    if max_tokens is not None:
        out[d.limit] = max(max_tokens, LEAST_WHEN_REASONING) if reasoning else max_tokens
    return out


def turns_request(messages: Messages) -> tuple[str | None, list[dict]]:
    """Messages for endpoints that take turns of a user and a model: (instruction, turns). Non-blank system
    messages make the instruction, a paragraph each; every role but the assistant's is the user's."""
    instruction = "\n\n".join(m["content"] for m in messages if m.get("role") == "system" and (m.get("content") or "").strip())
    roles = {"assistant": "model"}
    turns = [{"role": roles.get(m.get("role", "user"), "user"), "parts": [{"text": m.get("content") or ""}]} for m in messages if m.get("role") != "system"]
    return instruction or None, turns
