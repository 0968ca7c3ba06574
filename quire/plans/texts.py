"""Queries on scalar text functions and punctuation."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quire.functions import punctuation as P
from quire.functions import text as X
from quire.functions.loose_json import loose_json
from quire.session import table

# Deterministic marks are put into the texts, which hold few of their own.
_DASHED = "replace(replace(replace(text, '. ', '... '), ', ', '--'), ' th', ' …th')"
_QUOTED = "replace(replace(text, ' the ', ' \"the\" '), ' of ', ' 「of」 ')"
_SPACED = "replace(replace(text, ', ', '，  '), '. ', '。 ')"


def punct_ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.ellipsis_dash(F.expr(_DASHED)).cast("binary")).alias("digest"))


def punct_double_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.double_quotes(P.japanese_quotes(F.expr(_QUOTED))).cast("binary")).alias("digest"))


def punct_gaps(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.close_gaps(F.expr(_SPACED)).cast("binary")).alias("digest"))


def punct_full(spark, sf_dir):
    text = F.expr("replace(replace(text, ' the ', ' \"the\" '), ' of ', ' ''of'' ,中. ')")
    return table(spark, sf_dir, "documents").select("doc_id", P.normalize(text).alias("text"))


def punct_segments(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.replace("text", F.lit(" "), F.lit(' "')).alias("text")))).alias("t"))
    return turns.select("conv_id", P.normalize_segments(F.transform("t", lambda x: x["text"]), F.transform("t", lambda x: x["role"] == "assistant")).alias("texts"))


_CODES = list(itertools.chain(X.LANGUAGE_CODES, ("auto", "unknown", "DE", " Fr ", "en-US", "x", "", "12", "japanese ")))


def lang_normalize(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in _CODES))
    return table(spark, sf_dir, "documents").select("doc_id", X.language_code(F.get(names, (F.col("doc_id") % len(_CODES)).cast("int"))).alias("code"), X.language_code(F.concat(F.upper("lang"), F.lit("-x"))).alias("own"))


def lang_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.language_label(F.col("lang")).alias("label"), X.epub_language(F.when(F.col("doc_id") % 3 == 0, F.lit("zh_CN")).otherwise(F.col("lang"))).alias("tag"))


def slug_and_file_name(spark, sf_dir):
    raw = F.concat(F.lit("  .."), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit('*?"..  '))
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(raw).alias("slug"), X.file_name(raw).alias("file"), X.file_name(F.when(F.col("p_partkey") % 2 == 0, F.lit("//"))).alias("fallback"))


def flat_and_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.flat(F.col("html")).cast("binary")).alias("flat"), F.md5(X.html_escape(F.col("html")).cast("binary")).alias("escaped"), F.md5(X.body_of(F.col("html")).cast("binary")).alias("body"))


def page_heads(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.head_of(F.col("html")).cast("binary")).alias("head"))


def joined_pages(spark, sf_dir):
    """Twenty pages to a document, as those of a PDF that was converted in parts."""
    parts = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 20).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("p"))
    page = X.one_page(F.transform("p", lambda x: x["html"]), F.concat(F.lit("A & "), "doc"))
    return parts.select("doc", F.md5(page.cast("binary")).alias("digest"), F.length(page).cast("long").alias("chars"))


def vertical_markup(spark, sf_dir):
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("<style>p{-epub-writing-mode : vertical-rl}</style>"))).when(F.col("page_id") % 4 == 1, F.concat("html", F.lit('<p class="x vrtl">'))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", X.looks_vertical(html).alias("vertical"))


def chapter_labels(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", X.chapter_label(title, F.col("doc_id").cast("int")).alias("label"), X.fallback(title, F.col("lang")).alias("shown"))


def loose_json_values(spark, sf_dir):
    damaged = F.array(F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here: "), "props", F.lit(" done")), F.concat(F.lit("[1, "), "props", F.lit("]")), F.concat("props", F.lit("}")), F.lit('{"a": "say "hi" now"}'), F.lit("no value"))
    return table(spark, sf_dir, "events").select("event_id", loose_json(F.get(damaged, (F.col("event_id") % 7).cast("int"))).alias("value"))


def sentence_counts(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, lambda x: F.length(x))).cast("long").alias("longest"))


def content_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.content_key(F.concat(F.lit("\t "), "text", F.lit(" \n"))).alias("key"))


def language_guidance(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 5 == 0, "ja").otherwise(F.col("lang"))
    strategy = F.get(F.array(*(F.lit(x) for x in ("keep", "normalize", "drop", "odd"))), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", F.md5(X.translation_guidance(code, strategy).cast("binary")).alias("guidance"), F.md5(X.term_guidance(code).cast("binary")).alias("terms"))


QUERIES = {
    f.__name__: f
    for f in (punct_ellipsis, punct_double_quotes, punct_gaps, punct_full, punct_segments, lang_normalize, lang_label, language_guidance, slug_and_file_name, flat_and_escape, page_heads, joined_pages, vertical_markup, chapter_labels, loose_json_values, sentence_counts, content_keys)
}

_HEAD = """trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1), '(?is)<title[^>]*>.*?</title>', '', 'g'), '(?i)<meta[^>]*charset[^>]*/?>', '', 'g'))"""
_BODY = "CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END"
_LIST = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.LANGUAGE_CODES.items()) + "}"
_LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.LANGUAGE_LABELS.items()) + "}"
_CJK = "\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ff00}-\\x{ffef}“”‘’（）《》【】、，。！？：；…—"


def _code(c: str) -> str:
    low = f"lower(trim({c}))"
    unknown = ", ".join(f"'{u}'" for u in X.UNKNOWN_LANGUAGES)
    return f"CASE WHEN {low} IN ({unknown}) THEN '' ELSE coalesce({_MAP}[{low}], CASE WHEN regexp_full_match(left({low}, 2), '\\pL+') THEN left({low}, 2) ELSE '' END) END"


_RAW = "'  ..' || p_name || ' / ' || p_type || '*?\"..  '"
ORACLE = {
    "punct_ellipsis": "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + _DASHED
    + ", '。{3,}', '……', 'g'), '・{2,}', '……', 'g'), '\\.{3,}', '……', 'g'), '…+', '……', 'g'), '-{2,}', '——', 'g'), '—+', '——', 'g')) AS digest FROM documents",
    "punct_double_quotes": f"""WITH q AS (SELECT doc_id, translate({_QUOTED}, '「」『』', '“”‘’') AS t FROM documents),
        p AS (SELECT doc_id, unnest(string_split(t, '"')) AS s, generate_subscripts(string_split(t, '"'), 1) - 1 AS i FROM q)
        SELECT doc_id, md5(string_agg(CASE WHEN i = 0 THEN s WHEN i % 2 = 1 THEN '“' || s ELSE '”' || s END, '' ORDER BY i)) AS digest FROM p GROUP BY doc_id""",
    "punct_gaps": f"SELECT doc_id, md5(regexp_replace({_SPACED}, '([，。！？：；、])\\s+', '\\1', 'g')) AS digest FROM documents",
    "lang_normalize": f"SELECT doc_id, {_code(f'{_LIST}[doc_id % {len(_CODES)} + 1]')} AS code, {_code('''upper(lang) || '-x' ''')} AS own FROM documents",
    "language_guidance": f"""SELECT doc_id, md5(CASE c WHEN 'ja' THEN replace('{X.GUIDANCE["ja"]}', '$rule', CASE doc_id % 4 WHEN 0 THEN '{X.HONORIFICS["keep"]}' WHEN 1 THEN '{X.HONORIFICS["normalize"]}' WHEN 2 THEN '{X.HONORIFICS["drop"]}' ELSE '{X.OTHER_HONORIFIC}' END)
        WHEN 'en' THEN '{X.GUIDANCE["en"]}' ELSE '{X.OTHER_GUIDANCE}' END) AS guidance, md5(CASE c WHEN 'ja' THEN '{X.TERM_GUIDANCE["ja"]}' WHEN 'en' THEN '{X.TERM_GUIDANCE["en"]}' ELSE '{X.OTHER_TERM_GUIDANCE}' END) AS terms
        FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ja' ELSE lang END AS c FROM documents)""",
    "lang_label": f"SELECT doc_id, coalesce({_LABELS}[lang], lang || '文') AS label, CASE WHEN doc_id % 3 = 0 THEN 'zh-Hans' ELSE lang END AS tag FROM documents",
    "slug_and_file_name": f"""SELECT p_partkey, regexp_replace(regexp_replace({_RAW}, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
        left(regexp_replace(regexp_replace(trim(regexp_replace({_RAW}, '[\\\\/:*?"<>|\\r\\n\\t]+', ' ', 'g')), '^\\.+|\\.+$', '', 'g'), '\\s+', ' ', 'g'), 120) AS file, 'translated' AS fallback FROM part""",
    "flat_and_escape": """SELECT page_id, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS flat,
        md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS escaped,
        md5(CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END) AS body FROM pages""",
    "page_heads": f"SELECT page_id, md5({_HEAD}) AS head FROM pages",
    "joined_pages": f"""WITH g AS (SELECT page_id // 20 AS doc, arg_min({_HEAD}, page_id) AS head, string_agg({_BODY}, '' ORDER BY page_id) AS body FROM pages GROUP BY 1),
        w AS (SELECT doc, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>A &amp; ' || doc || '</title>' || chr(10) || head || chr(10)
        || '</head>' || chr(10) || '<body>' || chr(10) || body || chr(10) || '</body>' || chr(10) || '</html>' AS page FROM g) SELECT doc, md5(page) AS digest, length(page) AS chars FROM w""",
    "vertical_markup": "SELECT page_id, page_id % 4 IN (0, 1) AS vertical FROM pages",
    "chapter_labels": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '第 ' || (doc_id + 1) || ' 章' ELSE source END AS label, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS shown FROM documents",
    "loose_json_values": """SELECT event_id, CASE event_id % 7 WHEN 3 THEN '[1,' || p || ']' WHEN 5 THEN '{"a":"say \\"hi\\" now"}' WHEN 6 THEN NULL ELSE p END AS value
        FROM (SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS p FROM events)""",
    "sentence_counts": """SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest
        FROM (SELECT doc_id, regexp_extract_all(text, '[^。．.!！？?…\\n]*[。．.!！？?…\\n]|[^。．.!！？?…\\n]+') AS s FROM documents)""",
    "content_keys": "SELECT conv_id, turn, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS key FROM conversations",
}
