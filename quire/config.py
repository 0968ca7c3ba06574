"""Settings: defaults, a JSON file over them, and the tiers of a provider."""

from __future__ import annotations

import json
import os
import string

# Sizes in characters, limits and switches of a run.
DEFAULTS = {
    "source_lang": "auto", "target_lang": "zh", "provider": "fake", "honorifics": "keep",
    "segment": {"batch_chars": 1800, "long_segment_chars": 1200, "review_factor": 3, "chapter_split": "top-level-toc"},
    "pipeline": {"rolling_context": 6, "align_retries": 2, "understanding": True, "polish": False, "punctuation": True, "back_translation_rate": 0.05, "glossary_scope": "chapter"},
    "output": {"bilingual_order": "target_first", "last_page": {"title": "", "text": ""}},
    "retry": {"max_retries": 4, "first_delay": 1.0, "longest_delay": 30.0},
    "endpoint": {"base_url": "", "api_key_env": "", "timeout": 600, "reasoning_style": "none"},
    "tiers": {},
}
TIERS = ("strong", "cheap", "fast")


def deep_merge(base: dict, override: dict) -> dict:
    """A new dict: values of ``override`` win, dicts in both are merged in turn."""
    out = dict(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | None = None) -> dict:
    """The defaults with the values of a JSON file over them; ValueError for names that do not exist."""
    own = json.loads(open(path, encoding="utf-8").read()) if path else {}
    for name, value in own.items():
        if name not in DEFAULTS:
            raise ValueError(f"unknown setting {name!r}")
        if isinstance(DEFAULTS[name], dict) and name != "tiers" and (odd := set(value) - set(DEFAULTS[name])):
            raise ValueError(f"unknown settings of {name}: {', '.join(sorted(odd))}")
    return deep_merge(DEFAULTS, own)


def create_default(path: str) -> bool:
    """Write the defaults to a file that is not there yet; whether it was written."""
    if os.path.exists(path):
        return False
    with open(path, "w", encoding="utf-8") as f:
        json.dump(DEFAULTS, f, indent=2, ensure_ascii=False)
    return True


def tiers(defaults: dict[str, dict], override: dict[str, dict]) -> dict[str, dict]:
    """The tiers of a provider, its defaults under the given ones. A tier needs a model, and there must be
    a strong one; ValueError otherwise and for unknown tiers."""
    merged = deep_merge(defaults, override)
    if odd := set(merged) - set(TIERS):
        raise ValueError(f"unknown tiers: {', '.join(sorted(odd))}")
    if "strong" not in merged:
        raise ValueError("the tier strong is missing")
    for name, options in merged.items():
        if not options.get("model"):
            raise ValueError(f"the tier {name} names no model")
    return merged


def punctuation_wanted(settings: dict) -> bool:
    """Punctuation is made Chinese only for a Chinese target."""
    target = str(settings["target_lang"]).lower()
    return bool(settings["pipeline"]["punctuation"]) and (target == "zh" or target.startswith("zh-"))


def rendered(template: str, **values: object) -> str:
    """A template with $names filled in; unknown names stay as they are."""
    return string.Template(template).safe_substitute(values)
