"""Queries on tasks for a model, over the deterministic stand-in, and on whole books made and read again."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quire.operators import agents, checks, folds, model, sinks
from quire.plans.packing import long
from quire.session import table
from quire.sources import books


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("trim(text) <> ''")


def _digest(c):
    return F.md5(F.col(c).cast("binary")).alias("digest")


def document_languages(spark, sf_dir):
    return agents.languages(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def chapter_digests(spark, sf_dir):
    return agents.chapter_digests(table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", _digest("digest"))


def book_synopses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("book", F.floor(F.col("doc_id") / 1000))
    return agents.synopses(d, ["source", "book"], "doc_id", "text").select("source", "book", _digest("synopsis"))


def seed_terms(spark, sf_dir):
    found = agents.analyses(table(spark, sf_dir, "documents").where("text is not null"), ["doc_id"], "text")
    people = agents.seed_terms(found, ["doc_id"]).where("type = '人物'")
    return people.select("doc_id", "source", "target", long("seq"), long("chapter"))


def model_terms(spark, sf_dir):
    found = agents.terms(_turns(spark, sf_dir), ["conv_id", "turn"], F.col("text"), F.upper("text"))
    return found.select("conv_id", "turn", long("position"), "source", "target", "type")


def fixed_segments(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumns({"source": F.col("text"), "feedback": F.lit("missing"), "before": F.array("role"), "after": F.array("role")})
    return agents.fixes(t, ["conv_id", "turn"]).where("target is not null").select("conv_id", "turn", _digest("target"))


def _conversations(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(parts, lambda x: x["text"]).alias("items"), F.transform(parts, lambda x: x["turn"]).alias("turns"))


def polished_batches(spark, sf_dir):
    out = agents.polished(_conversations(spark, sf_dir), ["conv_id"], "items")
    return out.select("conv_id", F.md5(F.array_join("targets", "|").cast("binary")).alias("digest"))


def translated_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("book", F.floor(F.col("p_partkey") / 10000))
    packed = folds.pack(part, ["p_brand", "book"], ["p_partkey"], F.struct("p_partkey", "p_name"), lambda x: F.length(x["p_name"]), 4000, most_items=40)
    asked = packed.select("p_brand", "book", "batch", F.transform("items", lambda x: x["p_partkey"]).alias("keys"), F.transform("items", lambda x: x["p_name"]).alias("names"))
    told = agents.titles(asked, ["p_brand", "keys"], "names")
    return told.select(F.explode(F.arrays_zip("keys", "titles")).alias("x")).select(F.col("x.keys").alias("p_partkey"), F.col("x.titles").alias("title"))


def back_translation_issues(spark, sf_dir):
    turned = F.array_join(F.reverse(F.split("text", " ", -1)), " ")
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("source"), F.when(F.col("turn") % 2 == 0, turned).otherwise(F.col("text")).alias("target"))))
    told = agents.back_translations(_turns(spark, sf_dir).groupBy("conv_id").agg(pairs.alias("_p")).select("conv_id", F.transform("_p", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"))).alias("items")), ["conv_id"])
    return told.select("conv_id", F.col("index").cast("long").alias("position"), "type", "detail")


def _finds(messages: list[dict[str, str]], tier: str) -> str:
    """A reviewer that remarks on texts that were left as they are and on missing ones, by the index it is shown;
    and, told a glossary and chapters, on terms that stand nowhere in the chapters."""
    asked = json.loads(messages[-1]["content"])
    if isinstance(asked, dict):
        lost = [line for line in asked.get("glossary", "").split("\n") if line not in asked.get("chapters", "")]
        return json.dumps([{"index": k, "type": "lost", "detail": line} for k, line in enumerate(lost)])
    kinds = ((x["index"], "missing" if not x.get("target", "").strip() else "copied" if x["target"] == x["source"] else None) for x in asked)
    return json.dumps({"issues": [{"index": i, "type": kind, "detail": f"at {i}"} for i, kind in kinds if kind]})


def reviewed_chunks(spark, sf_dir):
    """Conversations reviewed in chunks of up to 1800 characters; issues are led back to their turns."""
    target = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.lit(" ")).otherwise(F.upper("text"))
    items = _turns(spark, sf_dir).withColumn("target", target)
    chunks = folds.pack(items, ["conv_id"], ["turn"], F.struct("turn", F.col("text").alias("source"), "target"), lambda x: F.length(x["source"]), 1800)
    asked = chunks.select("conv_id", F.transform("items", lambda x: x["turn"]).alias("turns"), "items")
    told = agents.reviews(asked, ["conv_id", "turns"], model.FakeProvider(_finds))
    return told.select("conv_id", F.get("turns", F.col("index").cast("int")).cast("long").alias("turn"), "type", (F.col("detail") == F.concat(F.lit("at "), "index")).alias("named"))


def consistency_issues(spark, sf_dir):
    """The lines of the first words of turns of a conversation as its glossary, the shortened conversation as
    its chapter. A first word may hold line ends, so its lines are what is sorted. Turns of separators only are none."""
    t = _turns(spark, sf_dir).where(F.regexp_like("text", F.lit(r"[^\p{Zs}]")))
    lines = F.flatten(F.transform(F.collect_set(F.substring_index("text", " ", 1)), lambda x: F.split(x, "\n", -1)))
    words = t.groupBy("conv_id").agg(F.array_join(F.array_sort(lines), "\n").alias("glossary"))
    chapters = checks.qa_digest(t.withColumnRenamed("turn", "seg"), ["conv_id"], "text").withColumnRenamed("digest", "chapters")
    told = agents.consistency(words.join(chapters, "conv_id"), ["conv_id"], "glossary", "chapters", model.FakeProvider(_finds))
    return told.select("conv_id", F.col("index").cast("long").alias("position"), F.col("detail").alias("term"))


def translated_in_order(spark, sf_dir):
    items = _turns(spark, sf_dir).withColumn("target", F.when(F.col("role") == "assistant", F.upper("text")))
    packed = folds.pack(items, ["conv_id"], ["turn"], F.struct("turn", "text", "target"), lambda x: F.length(x["text"]), 600)
    cut = folds.resume_batches(packed, ["conv_id"], lambda x: x["target"].isNotNull())
    field = lambda f: F.transform("items", lambda x: x[f])
    asked = cut.select(F.col("conv_id").cast("string").alias("path"), F.lit(0).alias("chapter"), "start", "done", field("turn").alias("segs"), field("target").alias("targets"), field("text").alias("items"), F.lit("").alias("brief"))
    out = agents.translated_books(asked)
    each = out.select(F.col("path").cast("long").alias("conv_id"), F.explode(F.arrays_zip("segs", "targets")).alias("x"))
    return each.select("conv_id", F.col("x.segs").cast("long").alias("turn"), F.md5(F.col("x.targets").cast("binary")).alias("digest"))


def _books(spark, sf_dir):
    """EPUB files made of conversations: two turns to a chapter, the first of them its heading."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    t = _turns(spark, sf_dir).select(
        F.format_string("b/c%d.md", "conv_id").alias("path"), F.lit("Book").alias("title"), F.floor(F.col("turn") / 2).cast("int").alias("chapter"), F.format_string("T %d & more", F.floor(F.col("turn") / 2)).alias("chapter_title"),
        "turn", F.when(F.col("turn") % 2 == 0, "heading").otherwise("text").alias("kind"), flat.alias("source"),
    )
    # The files are read several times below, so they are made once.
    return sinks.assembled(t.withColumnRenamed("turn", "seg").withColumn("target", F.col("source")), "epub").persist(StorageLevel.DISK_ONLY)


def _read_again(files):
    return books.epub_chapters(books.parsed_epubs(files).persist(StorageLevel.DISK_ONLY))


def _conv(path):
    return F.regexp_extract(path, r"c(\d+)", 1).cast("long").alias("conv_id")


def epub_round_trip(spark, sf_dir):
    out = _read_again(_books(spark, sf_dir))
    return out.select(_conv(F.col("path")), long("chapter"), "chapter_title", long("seg"), "kind", _digest("source"))


def epub_in_place(spark, sf_dir):
    files = _books(spark, sf_dir)
    read = _read_again(files).withColumn("target", F.concat(F.lit("T: "), "source"))
    labels = read.where("seg = 0").select("path", "toc_path", "toc_node", F.concat(F.lit("L "), "chapter").alias("label"))
    out = _read_again(sinks.translated_epubs(files, read, labels))
    return out.select(_conv(F.col("path")), long("chapter"), "chapter_title", long("seg"), _digest("source"))


def epub_last_page(spark, sf_dir):
    """What stands on the page that every book is given behind all others."""
    files = sinks.with_last_pages(_books(spark, sf_dir), "About & more", ["one", "two"])
    each = books.parsed_epubs(files).select("path", F.element_at("resources", -1)["href"].alias("last"), F.explode("segments").alias("s")).where("s.href = last")
    return each.select(_conv(F.col("path")), F.col("s.resource").cast("long").alias("resource"), F.col("s.kind").alias("kind"), F.col("s.source").alias("source"))


def resource_lists(spark, sf_dir):
    """Lists of twenty entries, some of them no objects, without a link or with an index that is none."""
    k = F.col("p_partkey") % 5
    href = F.concat(F.lit('{"href": "'), "p_brand", F.lit('"'))
    entry = F.when(k == 0, "7").when(k == 1, F.concat(href, F.lit("}"))).when(k == 2, F.concat(href, F.lit(', "index": '), "p_size", F.lit("}"))).when(k == 3, F.lit('{"href": "", "index": 1}')).otherwise(F.concat(href, F.lit(', "index": "9"}')))
    lists = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("l"))
    asked = lists.select("doc", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]")).alias("list"))
    return books.resource_list(asked, ["doc"], "list").select("doc", long("index"), "href")


QUERIES = {f.__name__: f for f in (document_languages, chapter_digests, book_synopses, seed_terms, model_terms, fixed_segments, polished_batches, translated_titles, back_translation_issues, reviewed_chunks, consistency_issues, translated_in_order, epub_round_trip, epub_in_place, epub_last_page, resource_lists)}

_TURNED = "array_to_string(list_reverse(string_split(text, ' ')), ' ')"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CHAPTERS = """c AS (SELECT conv_id, turn, turn // 2 AS k, text FROM conversations WHERE trim(text) <> ''),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS chapter, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) - 1 AS seg FROM c)"""
#: The synopsis is a fold of unknown depth; it is tested against a plain loop.
ORACLE = {
    "document_languages": "SELECT doc_id, CASE WHEN contains(left(text, 1500), ' und ') THEN 'de' WHEN contains(left(text, 1500), ' les ') THEN 'fr' WHEN contains(left(text, 1500), ' los ') THEN 'es' ELSE 'en' END AS language FROM documents",
    "chapter_digests": "SELECT doc_id, md5(left(text, 80)) AS digest FROM documents WHERE regexp_matches(text, '\\S')",
    "seed_terms": """WITH w AS (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS s FROM documents)),
        f AS (SELECT doc_id, word, min(i) AS i FROM w WHERE regexp_full_match(word, '\\p{Lu}\\p{L}*') GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq FROM f)
        SELECT doc_id, word AS source, reverse(word) AS target, seq, CAST(0 AS BIGINT) AS chapter FROM r WHERE seq < 3""",
    "model_terms": """WITH w AS (SELECT conv_id, turn, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations WHERE trim(text) <> '')),
        f AS (SELECT conv_id, turn, word, min(i) AS i FROM w WHERE length(word) >= 12 AND regexp_full_match(word, '\\p{L}+') GROUP BY 1, 2, 3)
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS position, word AS source, reverse(word) AS target, '术语' AS type FROM f""",
    "fixed_segments": f"SELECT conv_id, turn, md5({_TURNED}) AS digest FROM conversations WHERE trim(text) <> ''",
    "polished_batches": f"SELECT conv_id, md5(string_agg({_TURNED}, '|' ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id",
    "translated_titles": "SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS title FROM part",
    "back_translation_issues": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE trim(text) <> '')
        SELECT conv_id, position, 'meaning' AS type, 'differs' AS detail FROM n WHERE turn % 2 = 1 AND {_TURNED} <> text""",
    "reviewed_chunks": """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'missing' ELSE 'copied' END AS type, true AS named FROM conversations
        WHERE trim(text) <> '' AND (turn % 3 < 2 OR upper(text) = text)""",
    "consistency_issues": """WITH c AS (SELECT * FROM conversations WHERE trim(text) <> ''), t AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM c GROUP BY conv_id),
        d AS (SELECT conv_id, left(array_to_string(list_filter(list_concat(t[1:3], CASE WHEN len(t) > 3 THEN t[len(t) - 1:] ELSE [] END), lambda x: x <> ''), '……'), 600) AS digest FROM t),
        w AS (SELECT DISTINCT conv_id, split_part(text, ' ', 1) AS line FROM c), p AS (SELECT conv_id, unnest(string_split(line, chr(10))) AS term FROM w)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY term) - 1 AS position, term FROM p JOIN d USING (conv_id) WHERE NOT contains(digest, term)""",
    "translated_in_order": f"SELECT conv_id, turn, md5({_TURNED}) AS digest FROM conversations WHERE trim(text) <> '' AND role <> 'assistant'",
    "epub_round_trip": f"WITH {_CHAPTERS} SELECT conv_id, chapter, 'T ' || k || ' & more' AS chapter_title, seg, CASE WHEN turn % 2 = 0 THEN 'heading' ELSE 'text' END AS kind, md5({_FLAT}) AS digest FROM n",
    "epub_last_page": """WITH c AS (SELECT conv_id, count(DISTINCT turn // 2) AS resource FROM conversations WHERE trim(text) <> '' GROUP BY 1)
        SELECT conv_id, resource, x.kind AS kind, x.source AS source FROM c, (VALUES ('heading', 'About & more'), ('text', 'one'), ('text', 'two')) x(kind, source)""",
    "resource_lists": """WITH e AS (SELECT p_partkey // 20 AS doc, p_partkey % 5 AS k, p_brand AS href, p_size AS size, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS place FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc, href ORDER BY place) AS n FROM e WHERE k IN (1, 2, 4))
        SELECT doc, CAST(CASE WHEN k = 2 THEN size ELSE place END AS BIGINT) AS index, href FROM r WHERE n = 1""",
    "epub_in_place": f"WITH {_CHAPTERS} SELECT conv_id, chapter, 'L ' || chapter AS chapter_title, seg, md5('T: ' || {_FLAT}) AS digest FROM n",
}
