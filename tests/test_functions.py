import html as html_lib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import punctuation as P
from quire.functions import text as X
from quire.functions.loose_json import parse_loose
from quire.functions.unicode import match_key
from quire.operators import segments
from quire.sources import html


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("　a ", "a"), (" a ", "a"), ("\ta\n", "a"), ("", ""),
    ],
)
def test_strip_is_unicode_wide(spark, raw, expected):
    assert one(spark, raw, X.strip) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("他说\"好\"。", "他说“好”。"),
        ("「是」『否』", "“是”‘否’"),
        ("中,.", "中，."),
        ("Mr.王 9.11 v2.版本", "Mr.王 9.11 v2.版本"),
        ("等...好--吧…", "等……好——吧……"),
        ("don't 'stop' now", "don’t ‘stop’ now"),
        ("好， 的", "好，的"),
    ],
)
def test_punctuation(spark, raw, expected):
    assert one(spark, raw, P.normalize) == expected


def test_open_quotes_reach_continuations_only(spark):
    df = spark.createDataFrame([(['"a', 'b"', '"c"'], [False, True, False])], "t array<string>, c array<boolean>")
    assert df.select(P.normalize_segments(F.col("t"), F.col("c")).alias("r")).first()["r"] == ["“a", "b”", "“c”"]


def test_match_key(spark):
    assert one(spark, "Ｓｔｒａße", match_key) == "strasse"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('{"a": 1}', {"a": 1}), ('x ```json\n[1, 2]\n``` y', [1, 2]), ('so: {"a": [1]} done', [1]), ('{"a": "he said "no" then"}', {"a": 'he said "no" then'}),
        ('{"a": 1}}', {"a": 1}), ('{"t": ["x "y" z"]}}', {"t": ['x "y" z']}),
    ],
)
def test_loose_json(raw, expected):
    assert parse_loose(raw) == expected


def test_loose_json_without_value():
    with pytest.raises(ValueError):
        parse_loose("nothing here")


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=8))
@settings(max_examples=60, deadline=None)
def test_loose_json_reads_json(value):
    assert parse_loose(json.dumps(value)) == value


def test_pieces_join_to_the_text(spark):
    texts = ["", "a", "One. Two! Three? " * 9, "x" * 130, "ab " * 70, "tab\t" * 40, "短い。" * 30, " " * 100, "a " + "b" * 90 + " c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segments.split_text(F.col("t"), 40).alias("p"))
    for row in df.collect():
        assert "".join(row["p"]) == row["t"]
        assert all(len(p) <= 40 for p in row["p"])


@pytest.mark.parametrize("raw, code", [("Japanese", "ja"), (" 日语 ", "ja"), ("auto", ""), ("en-US", "en"), (None, ""), ("1x", "")])
def test_language_code(spark, raw, code):
    assert one(spark, raw, X.language_code) == code


# Models of whole operators, character by character, that share no code with them.
CJK = [(0x4E00, 0x9FFF), (0x3040, 0x30FF), (0xFF00, 0xFFEF)]
CJK_SIGNS = "“”‘’（）《》【】、，。！？：；…—"


def chinese(c):
    return bool(c) and (c in CJK_SIGNS or any(a <= ord(c) <= b for a, b in CJK))


def letter(c):
    return bool(c) and c.isascii() and c.isalpha()


def model_punctuation(text, double=True, single=True):
    """(normalised text, whether the next double quote opens, whether the next single one does)."""
    out = []
    for c in text:
        c = {"「": "“", "」": "”", "『": "‘", "』": "’"}.get(c, c)
        if c == '"':
            c, double = ("“" if double else "”"), not double
        out.append(c)
    for k, c in enumerate(out):
        if c == "'":
            before, after = out[k - 1] if k else "", out[k + 1] if k + 1 < len(out) else ""
            if letter(before):
                out[k] = "’\0"  # marked, as its neighbours are judged by what stood there
                if not letter(after):
                    single = True
            else:
                out[k], single = ("‘\0" if single else "’\0"), not single
    text = "".join(x[0] for x in out)
    done, k = [], 0
    while k < len(text):
        run = len(text) - k - len(text[k:].lstrip(text[k]))
        least, sign = {"。": (3, "……"), "・": (2, "……"), ".": (3, "……"), "…": (1, "……"), "-": (2, "——"), "—": (1, "——")}.get(text[k], (1 << 60, ""))
        done.append(sign if run >= least else text[k] * run)
        k += run
    text = re.sub("…+", "……", "".join(done))
    text = re.sub("—+", "——", text)
    wide = []
    for k, c in enumerate(text):
        if c in ",.!?:;":
            before, after = text[k - 1] if k else "", text[k + 1] if k + 1 < len(text) else ""
            known = before.isascii() and before.isalnum()
            if chinese(before) or (not known and chinese(after)):
                c = dict(zip(",.!?:;", "，。！？：；", strict=True))[c]
        wide.append(c)
    text, kept = "".join(wide), []
    for k, c in enumerate(text):
        if c.isspace():
            left = text[:k].rstrip()[-1:]
            right = text[k:].lstrip()[:1]
            if (left and left in "，。！？：；、") or (left and left in "”’》】" and chinese(right)):
                continue
        kept.append(c)
    return "".join(kept), double, single


MARKS = ["a", "Z", "9", " ", "  ", "\n", '"', "'", "「", "」", "『", "』", ",", ".", "...", "!", "?", ":", ";", "。", "。。。", "・・", "…", "-", "--", "—", "中", "文", "，", "”", "》", "】", "（", "é"]


def test_punctuation_against_a_model(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(MARKS) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", P.normalize(F.col("t")).alias("r"))
    for row in df.collect():
        assert row["r"] == model_punctuation(texts[row["k"]])[0], texts[row["k"]]


def test_punctuation_of_segments_against_a_model(spark):
    r = random.Random(12)
    rows = [(k, ["".join(r.choice(MARKS) for _ in range(r.randint(0, 12))) if r.random() > 0.05 else None for _ in range(n)], [r.random() < 0.5 for _ in range(n)]) for k, n in enumerate([r.randint(1, 6) for _ in range(800)])]
    df = spark.createDataFrame(rows, "k int, t array<string>, c array<boolean>").select("k", P.normalize_segments(F.col("t"), F.col("c")).alias("r"))
    for row in df.collect():
        want, double, single = [], True, True
        for text, goes_on in zip(rows[row["k"]][1], rows[row["k"]][2], strict=True):
            if not (goes_on and want):
                double = single = True
            shown, double, single = model_punctuation(text or "", double, single)
            want.append(shown)
        assert row["r"] == want, rows[row["k"]]


def model_pages(page):
    """[(chapter, title, kind, text)] of a page whose headings are not the body's own: one chapter."""
    page = re.sub(r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", page)
    body = re.search(r"(?is)<body[^>]*>(.*)", page)[1]
    out, current = [], None
    for tag, text in re.findall(r"(?s)(<[^>]*>)|([^<]+)", body):
        name = re.match(r"</?([a-z0-9]*)", tag)[1] if tag else ""
        if name in ("p", "li", "h1", "h2", "h3") and not tag.startswith("</"):
            current = [name, ""]
            out.append(current)
        elif name in ("p", "li", "h1", "h2", "h3", "ul", "article"):
            current = None
        elif not tag and current:
            current[1] += html_lib.unescape(text)
    return [("heading" if n.startswith("h") else "text", t.strip()) for n, t in out if t.strip()]


def test_pages_against_a_model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    found = {}
    for r in sorted(html.html_segments(pages).collect(), key=lambda r: (r["page_id"], r["chapter"], r["seg"])):
        found.setdefault(r["page_id"], []).append((r["kind"], r["source"]))
    for r in pages.collect():
        assert found.get(r["page_id"], []) == model_pages(r["html"]), r["page_id"]
