"""Queries on books that are translated with a glossary that grows, made anew with images, and kept as templates."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import agents, model, sinks, status
from quire.plans.packing import long
from quire.session import table
from quire.sources import books, html


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("trim(text) <> ''")


def _tells_glossary(messages, tier):
    """The stand-in, but a translation is the glossary that was told."""
    if messages[0]["content"].startswith("[translate]"):
        told = json.loads(json.loads(messages[1]["content"])["brief"] or "{}").get("glossary") or "-"
        return json.dumps({"translations": [told for _ in json.loads(messages[-1]["content"])]}, ensure_ascii=False)
    return model.stand_in(messages, tier)


def glossary_in_run(spark, sf_dir):
    """Every turn is a batch of its own; its target is what it was told: the terms that earlier turns of the
    same run have brought and that occur in it."""
    t = _turns(spark, sf_dir)
    batches = t.select(
        F.col("conv_id").cast("string").alias("path"), F.lit(0).alias("chapter"), F.col("turn").alias("start"), F.lit(False).alias("done"), F.array("turn").alias("segs"),
        F.array("text").alias("items"), F.array(F.lit(None).cast("string")).alias("targets"), F.lit("").alias("brief"),
    )
    known = spark.createDataFrame([], "path string, source string, target string, reading string, type string, gender string, note string, aliases array<string>")
    out = agents.translated_books(batches, model.FakeProvider(_tells_glossary), terms=known, scope="batch")
    return out.select(F.col("path").cast("long").alias("conv_id"), F.col("start").cast("long").alias("turn"), F.md5(F.col("targets")[0].cast("binary")).alias("digest"))


#: What an event of each kind does to the status of its user.
_ACTIONS = {"click": "finish", "view": "start", "purchase": "fail"}


def status_walk(spark, sf_dir):
    action = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv)), F.col("event_type")), F.lit("fall_back"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 == 0, "odd").otherwise(action).alias("action"))
    return status.after_events(events, ["user_id"], "event_id")


def _fb2_files(spark, sf_dir):
    """An FB2 book of each conversation: a paragraph for each turn, and an image after every third."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    escaped = F.replace(F.replace(flat, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    image = F.when(F.col("turn") % 3 == 0, F.format_string('<image l:href="#i%d.png"/>', "turn")).otherwise("")
    picture = F.when(F.col("turn") % 3 == 0, F.format_string('<binary id="i%d.png">aGk=</binary>', "turn")).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<p>"), escaped, F.lit("</p>"), image).alias("p"), picture.alias("b"))))
    whole = _turns(spark, sf_dir).groupBy("conv_id").agg(parts.alias("x"))
    joined = lambda f: F.array_join(F.transform("x", lambda y: y[f]), "")
    text = F.concat(F.lit('<FictionBook xmlns:l="http://www.w3.org/1999/xlink"><body><section>'), joined("p"), F.lit("</section></body>"), joined("b"), F.lit("</FictionBook>"))
    return whole.select(F.format_string("b/c%d.fb2", "conv_id").alias("path"), F.lit("fb2").alias("fmt"), F.encode(text, "utf-8").alias("content"))


def _shown_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, name, place) of the images that the pages of EPUB files show, with the blocks before each."""
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                pages = "".join(z.read(n).decode() for n in sorted(z.namelist()) if re.fullmatch(r"c\d+\.xhtml", n))
                there = {n.rpartition("/")[2] for n in z.namelist() if n.startswith("images/")}
            n = 0
            for m in re.finditer(r'</p>|</h2>|<img src="images/([^"]*)"', pages):
                n += m[1] is None
                if m[1] in there:
                    rows.append((path, m[1], n))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "name", "place"])


def fb2_image_places(spark, sf_dir):
    """FB2 books read, made anew as EPUB, and their images found again."""
    files = _fb2_files(spark, sf_dir)
    segments = books.markup_books(files).withColumn("target", F.concat(F.lit("T "), "source"))
    made = sinks.assembled(segments, "epub", images=books.fb2_images(files))
    shown = made.mapInArrow(_shown_images, "path string, name string, place long")
    return shown.select(F.regexp_extract("path", r"c(\d+)", 1).cast("long").alias("conv_id"), "name", "place")


def _outside(markup: str) -> str:
    """A page without the contents of its blocks."""
    out, at = [], 0
    for _, _, block in html.anchored_blocks(markup):
        out.append(markup[at : block.span[1]])
        at = block.span[2]
    return "".join([*out, markup[at:]])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, before, after = (batch.column(c).to_pylist() for c in ("path", "content", "rewritten"))
        n, translated, same = [], [], []
        for a, b in zip(before, after, strict=True):
            a, b = a.decode(), b.decode()
            old, new = ([block.text().strip() for _, _, block in html.anchored_blocks(x)] for x in (a, b))
            n.append(len(new))
            translated.append(new == ["T: " + t for t in old])
            same.append(_outside(a) == _outside(b))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(translated), pa.array(same)], names=["path", "n", "translated", "same_outside"])


def pages_in_place(spark, sf_dir):
    """Pages translated as their own templates: how many blocks, whether all show their translation, and
    whether everything outside them is as it was."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    files = pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "utf-8").alias("content"))
    found = html.html_segments(pages).select(F.col("page_id").cast("string").alias("path"), "anchor", F.concat(F.lit("T: "), "source").alias("target"))
    new = sinks.translated_pages(files, found).select(F.col("path").alias("_p"), F.col("content").alias("rewritten"))
    both = files.join(new, F.col("path") == F.col("_p")).select("path", "content", "rewritten")
    return both.mapInArrow(_compared, "path string, n long, translated boolean, same_outside boolean").select(long("path").alias("page_id"), "n", "translated", "same_outside")


QUERIES = {f.__name__: f for f in (glossary_in_run, status_walk, fb2_image_places, pages_in_place)}

ORACLE = {
    "glossary_in_run": """WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> ''),
        w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM t),
        f AS (SELECT conv_id, word, min(turn) AS first FROM w WHERE length(word) >= 12 AND regexp_full_match(word, '\\p{L}+') GROUP BY 1, 2)
        SELECT t.conv_id, CAST(t.turn AS BIGINT) AS turn, md5(coalesce(string_agg('- ' || word || ' -> ' || reverse(word), chr(10) ORDER BY word COLLATE C), '-')) AS digest
        FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.first < t.turn AND contains(lower(t.text), lower(word)) GROUP BY 1, 2""",
    "status_walk": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
            CASE WHEN event_id % 10 = 0 THEN 'odd' WHEN event_type = 'click' THEN 'finish' WHEN event_type = 'view' THEN 'start' WHEN event_type = 'purchase' THEN 'fail' ELSE 'fall_back' END AS action FROM events),
        walk(user_id, i, status, refused) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'pending', CAST(0 AS BIGINT) FROM e
            UNION ALL SELECT w.user_id, e.i,
                CASE WHEN action = 'start' AND status <> 'running' THEN 'running' WHEN action = 'finish' AND status = 'running' THEN 'done' WHEN action = 'fail' AND status = 'running' THEN 'failed' WHEN action = 'fall_back' AND status = 'running' THEN 'pending' ELSE status END,
                refused + CASE WHEN (action = 'start' AND status <> 'running') OR (action IN ('finish', 'fail', 'fall_back') AND status = 'running') THEN 0 ELSE 1 END
            FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
        SELECT user_id, arg_max(status, i) AS status, max(i) AS n_events, CAST(arg_max(refused, i) AS BIGINT) AS n_refused FROM walk GROUP BY user_id""",
    "fb2_image_places": """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE trim(text) <> '')
        SELECT conv_id, 'i' || turn || '.png' AS name, place FROM t WHERE turn % 3 = 0""",
    "pages_in_place": """WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?is)^.*?<body[^>]*>', '') AS h FROM pages WHERE html IS NOT NULL)
        SELECT page_id, CAST(len(list_filter(string_split_regex(h, '(?i)<(?:p|li|h[1-6]|blockquote)(?:\\s[^>]*)?>')[2:],
            lambda x: regexp_matches(regexp_replace(regexp_replace(x, '(?is)</(?:p|li|h[1-6]|blockquote)>.*$', ''), '<[^>]*>', '', 'g'), '\\S'))) AS BIGINT) AS n, TRUE AS translated, TRUE AS same_outside FROM b""",
}
