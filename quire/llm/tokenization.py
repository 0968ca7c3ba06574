"""Byte-level BPE by a public vocabulary file, loaded once per Python worker."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Blanks in a row that the pattern's matcher is given at most; it overflows its stack at some 800,000.
LONG_RUN = 100_000
#: Runs of what the pattern takes as a blank (Unicode's White_Space).
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by rule: printable Latin-1 stands for
    itself, every other byte for the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Ids of whole texts; every id is a run of bytes, so byte spans follow from lengths."""

    def __init__(self, path: str):
        import public_tokenizers

        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in special}
        self.special = special
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.encoding = tiktoken.Encoding("quire", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, k in [*ranks.items(), *((t.encode(), k) for t, k in special.items())]:
            self.lengths[k] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids; a special token of the file that stands in the text is that token."""
        parts = self.between.split(text) if any(t in text for t in self.special) else [text]
        found = [self._ordinary(p) if k % 2 == 0 else np.array([self.special[p]], "<u4") for k, p in enumerate(parts) if p]
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def _ordinary(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens. The pattern takes a run of blanks as one piece, but for the
        last blank where something follows; runs that would overflow the stack of the pattern's matcher are
        found here and merged as that piece."""
        if len(text) <= LONG_RUN:
            return np.fromiter(self.encoding.encode_ordinary(text), "<u4")
        out, at = [], 0
        for run in _BLANKS.finditer(text):
            first, last = run.span()
            if last - first > LONG_RUN:
                last -= last < len(text)
                out.append(np.fromiter(self.encoding.encode_ordinary(text[at:first]), "<u4"))
                out.append(np.fromiter(self.encoding._core_bpe.encode_single_piece(text[first:last].encode()), "<u4"))
                at = last
        out.append(np.fromiter(self.encoding.encode_ordinary(text[at:]), "<u4"))
        return np.concatenate(out)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
