"""Personal data by offset-preserving deobfuscation.

The plain detectors run over the text as it is. Then a chain of transducers rewrites a text that shows
signs of disguise: look-alike characters, spelled digits, and written-out "at" and "dot". Every
character of the rewritten text knows the span of source characters that it stands for, so what the
detectors find there is mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import small_batches

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and only from the start of a run of digits: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found outwards from each @ so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        end = at + 1
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = end = m.end()
                yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, by start and then by kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NON_DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NON_DIGITS.sub("", m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# Letters of other scripts that look like these.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "т": "t", "м": "m", "п": "n", "г": "r", "ь": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "։": ":", "۔": ".", "。": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "․": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "⁃": "-", "➕": "+", "᛫": ".",
}
# Digit words of the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_ODD = re.compile("[\u00a0\u00ad\u00b2\u00b3\u00b7\u00b9\u0131\u0250-\U0010ffff]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SIGN = r"plus|dot|punkt|point|punto|dash|hyphen|minus"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s]+)?(?:{_WORD}|[0-9]+)(?:[\s,.-]{{1,3}}(?:(?:{_SIGN})[\s,.-]{{1,3}})?(?:{_WORD}|[0-9]+))+(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"({_WORD})|({_SIGN})|([0-9]+)|([\s,.-]+)", re.I)
_SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_WORD})[\s,.-]{{1,3}}(?:(?:{_SIGN})[\s,.-]{{1,3}})?(?:{_WORD})(?![^\W_])", re.I)
_SIGNS = {"plus": "+", "dot": ".", "punkt": ".", "point": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-"}
_OPEN, _CLOSE = r"[\[({<|]", r"[\])}>|]"
# Bracketed marks and character references take the white space around them with them, see _widened: a
# pattern that began with it would read every run of white space once for each of its characters.
_AT_MARK = re.compile(rf"(?P<wide>{_OPEN}\s*(?:at|@|arroba|arobase|ät)\s*{_CLOSE}|&#64;|&#x40;|&commat;|%40)|(?<=[A-Za-z0-9])\s+@\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s+(?=[A-Za-z0-9-]+\s*(?:\.|\bdot\b))", re.I)
_DOT_MARK = re.compile(rf"(?P<wide>{_OPEN}\s*(?:dot|\.|punkt|point|punto)\s*{_CLOSE}|&#46;|&#x2e;|&period;)|(?<=[A-Za-z0-9])\s+(?:dot|punkt|point|punto)\s+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s+\.\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[_-](?:dot)[_-](?=[A-Za-z0-9])", re.I)
_BRACKETED = re.compile(rf"{_OPEN}\s*(?:dot|\.|at|@|arroba|arobase|ät|punkt|point|punto)\s*{_CLOSE}")
_DOT_ALONE = re.compile(r"(?:dot|punkt|punto|point)(?![^\W_])")
_DIGIT_LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[ .()-]{0,2}[0-9OolI]){7,}(?![A-Za-z0-9])")
_LETTER_HINT = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_SIGNS_OF_MARKS = ("&#64;", "&#46;", "&#x40;", "&#x2e;", "&commat;", "&period;", "%40", " @", "@ ", "\n@", "@\n", "_at_", "-at-", " arroba ", " arobase ")
# The word "at" alone counts where what follows has a disguised dot, or where what precedes looks like an address.
_AT_WORD = re.compile("(?<=[A-Za-z0-9])(?:\\s+(?:at|arroba|arobase)\\s+|[_-]at[_-])(?=[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\ue000[A-Za-z0-9-])", re.I)
_AT_PLAIN = re.compile(r"(?<=[A-Za-z0-9_])\s+(?:at|arroba|arobase)\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.I)
_AT_PLAIN_HINT = re.compile(r"at\s+[a-z0-9-]+\.[a-z0-9-]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LOCAL_SIGNS = frozenset("0123456789._%+")


class Tape:
    """A text under rewriting, kept as runs: (place, source start, source end) of a stretch that a transducer
    wrote, or (place, source start, -1) of one that still is the source's, character by character."""

    def __init__(self, text: str):
        self.text = text
        self.runs = [(0, 0, -1)]
        self.places = [0]
        self.edited = False

    def _run(self, k: int) -> int:
        return bisect_right(self.places, k) - 1

    def span(self, i: int, j: int) -> tuple[int, int, bool]:
        """The source span of characters i to j, and whether a transducer wrote one of them."""
        first, last = self._run(i), self._run(j - 1)
        (place, a, b), (place2, a2, b2) = self.runs[first], self.runs[last]
        return (a if b >= 0 else a + i - place), (b2 if b2 >= 0 else a2 + j - place2), any(self.runs[r][2] >= 0 for r in range(first, last + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (start, end, what), in order and without overlap."""
        if not edits:
            return
        text, runs, size, at = [], [], 0, 0
        for i, j, what in [*edits, (len(self.text), len(self.text), "")]:
            if at < i:
                for place, a, b in self.runs[self._run(at) : self._run(i - 1) + 1]:
                    start = max(at, place)
                    runs.append((size + start - at, a, b) if b >= 0 else (size + start - at, a + start - place, -1))
                text.append(self.text[at:i])
                size += i - at
            if what:
                start, end, _ = self.span(i, j)
                runs.append((size, start, end))
                text.append(what)
                size += len(what)
            at = j
        self.text, self.runs, self.places, self.edited = "".join(text), runs or [(0, 0, -1)], [r[0] for r in runs] or [0], True


def _plain(c: str) -> str:
    if _HIDDEN.match(c):
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c))


def _characters(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), p) for m in _ODD.finditer(tape.text) if (p := _plain(m[0])) != m[0]])


def _digits(tape: Tape) -> None:
    """Runs with at least three spelled digits; separators between two digits of a run go."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        parts = [(x, x.lastindex) for x in _SPELLED_PART.finditer(m[0])]
        if sum(kind == 1 for _, kind in parts) < 3:
            continue
        for k, (x, kind) in enumerate(parts):
            i, j = m.start() + x.start(), m.start() + x.end()
            if kind == 1:
                edits.append((i, j, DIGIT_WORDS[x[0].lower()]))
            elif kind == 2:
                edits.append((i, j, _SIGNS[x[0].lower()]))
            elif kind == 4 and 0 < k < len(parts) - 1 and x[0].strip(", \t\n-") == "":
                edits.append((i, j, ""))
    tape.rewrite(edits)


def _may_have_spelled(text: str) -> bool:
    """Whether three digit words occur: a cheap test before the patterns."""
    words = text.lower().replace(",", " ").replace("-", " ").replace(".", " ").split()
    return not DIGIT_WORDS.keys().isdisjoint(words) and sum(map(DIGIT_WORDS.__contains__, words)) >= 3 and _SPELLED_HINT.search(text) is not None


def _letters(tape: Tape) -> None:
    """The letters O, o, l and I as digits, in runs of at least eight that are mostly real digits."""
    edits = []
    for m in _LETTER_DIGITS.finditer(tape.text):
        letters = [i for i, c in enumerate(m[0]) if c in _DIGIT_LETTERS]
        if letters and 2 * len(letters) < sum(c.isdigit() for c in m[0]):
            edits += [(m.start() + i, m.start() + i + 1, _DIGIT_LETTERS[m[0][i]]) for i in letters]
    tape.rewrite(edits)


def _word_end(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _like_local_part(text: str, end: int) -> bool:
    """Whether the word that ends there could only be the local part of an address: a digit, '.', '_', '+'
    or '%' is in it. A word that ends in a sign other than '_' is none ("50% at example.com")."""
    i = end
    while i and text[i - 1] in _LOCAL:
        i -= 1
    return i < end and text[end - 1] not in ".%+-" and not _LOCAL_SIGNS.isdisjoint(text[i:end])


def _may_have_marks(text: str) -> bool:
    """Whether a written-out at or dot may occur: a cheap test before the patterns."""
    low = text.lower()
    if any(sign in low for sign in _SIGNS_OF_MARKS) or ("@" in low and " ." in low):
        return True
    if any(c in low for c in "[({<|") and _BRACKETED.search(low):
        return True
    if ("dot" in low or "punkt" in low or "punto" in low or "point" in low) and _DOT_ALONE.search(low):
        return True
    if "arroba" in low or "arobase" in low:
        return True
    return any(m.start() and low[m.start() - 1].isspace() and _like_local_part(low, _word_end(low, m.start())) for m in _AT_PLAIN_HINT.finditer(low))


def _widened(marks: Iterator[re.Match], text: str, what: str) -> Iterator[tuple[int, int, str]]:
    """The spans of the marks, those of group wide with the white space to both sides."""
    done = 0
    for m in marks:
        start, end = m.span()
        if start < done:
            continue  # a mark within the white space of the one before
        if m["wide"]:
            while start > done and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
        done = end
        yield start, end, what


def _marks(tape: Tape) -> None:
    if not _may_have_marks(tape.text):
        return
    tape.rewrite(list(_widened(_DOT_MARK.finditer(tape.text), tape.text, "\ue000")))
    tape.rewrite(list(_widened(_AT_MARK.finditer(tape.text), tape.text, "@")))
    tape.rewrite([(*m.span(), "@") for m in _AT_WORD.finditer(tape.text)])
    tape.rewrite([(*m.span(), "@") for m in _AT_PLAIN.finditer(tape.text) if _like_local_part(tape.text, m.start())])
    tape.text = tape.text.replace("\ue000", ".")


def disguised_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) of what only shows after rewriting."""
    odd, spelled = not text.isascii() and _ODD.search(text), _may_have_spelled(text)
    lettered = _DIGIT.search(text) and _LETTER_HINT.search(text)
    if not (odd or spelled or lettered or _may_have_marks(text)):
        return []
    tape = Tape(text)
    if odd:
        _characters(tape)
    if spelled or (tape.edited and _may_have_spelled(tape.text)):
        _digits(tape)
    if lettered:
        _letters(tape)
    _marks(tape)
    if not tape.edited:
        return []
    taken = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
    found = []
    for i, j, kind in base_spans(tape.text):
        start, end, new = tape.span(i, j)
        if not new and end - start == j - i:
            continue
        # Plain findings of a kind do not overlap, so only the last one that starts by then can hold this one.
        k = bisect_right(taken[kind], (start, len(text))) - 1
        if k < 0 or taken[kind][k][1] < end:
            found.append((start, end, kind, tape.text[i:j]))
    return found


def find_pii(documents: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text of (doc_id, text).

    Returns doc_id and spans, an array of (kind, start, end, base, value) in code points, end
    exclusive, by start, then by kind as in KINDS, then by end; ``base`` tells plain findings from
    those that only show after deobfuscation, ``value`` is the normalised identifier. A null or empty
    text has no spans; null and repeated doc_ids are carried as they are; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                both = [(a, b, k, True, text[a:b]) for a, b, k in base] + [(a, b, k, False, v) for a, b, k, v in disguised_spans(text, base)]
                both.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                out.append([{"kind": k, "start": a, "end": b, "base": s, "value": v} for a, b, k, s, v in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
