"""Tasks for a model, each a plan: a prompt column, one call per row, and columns read from the reply.

Prompts are put together by DataFrame operators and replies are parsed by them where they can; only the
call itself runs in Python. A task that may fail gives an empty reply, one that must not fails the job.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.config import rendered
from quire.functions.loose_json import loose_json
from quire.functions.text import is_blank, language_code
from quire.operators import checks, extraction, folds, glossary, model, usage
from quire.session import lineage_cut

# How much of a text a task is given, in characters.
DETECT_CHARS, DIGEST_CHARS, SYNOPSIS_CHARS = 1500, 8000, 12000
#: The first message of each task; $src and $tgt are languages.
PROMPTS = {
    "language": "[language] Name the language of the text as JSON {language}, empty if unsure.",
    "analysis": "[analysis] Describe genre, tone, characters and terms of this text ($src) as JSON.",
    "digest": "[digest] Sum up this chapter in a few sentences.",
    "synopsis": "[synopsis] Sum up these summaries of one book.",
    "translate": "[translate] Translate each text of the JSON list from $src to $tgt; answer with as many.",
    "fix": "[translate] Translate the text of the JSON list from $src to $tgt anew, heeding the remarks.",
    "polish": "[polish] Polish each text of the JSON list ($tgt); answer with as many.",
    "titles": "[titles] Translate each title of the JSON list from $src to $tgt; answer with as many.",
    "terms": "[terms] List names and terms of source and target as JSON.",
    "review": "[review] List issues of the pairs of source and target as JSON.",
    "back": "[back] Translate each text of the JSON list from $tgt to $src.",
    "compare": "[compare] List pairs whose source and back translation differ in meaning as JSON.",
    "consistency": "[consistency] List inconsistencies between glossary and chapters as JSON.",
}


#: Called with (task, tier, rows) for every task that is asked within ``recording``.
_recorder: ContextVar[Callable[[str, str, DataFrame], None] | None] = ContextVar("recorder", default=None)
_USED = pa.struct([(f, pa.int64()) for f in usage.FIELDS])
USED = StructType([StructField(f, LongType()) for f in usage.FIELDS])


@contextmanager
def recording(record: Callable[[str, str, DataFrame], None]) -> Iterator[None]:
    """Within it, what every task uses is recorded as rows (key, calls, prompt, ...), the key telling the call
    within its task. Replies are then kept once they are there, so no call is made, or counted, twice."""
    token = _recorder.set(record)
    try:
        yield
    finally:
        _recorder.reset(token)


def ask(rows: DataFrame, keep: list[str], task: str, prompt: Column, tier: str, client: model.Provider | None = None, must: bool = False, brief: Column | None = None, **names: str) -> DataFrame:
    """Rows (keep..., reply): one call each, with ``brief`` as a message before the prompt.

    A failed call gives an empty reply, or fails the job if it must not; rows with a null prompt are not
    asked and have an empty reply."""
    client = client or model.FakeProvider()
    system = {"role": "system", "content": rendered(PROMPTS[task], **names)}
    source = rows.select(*keep, prompt.alias("_prompt"), (F.lit(None).cast("string") if brief is None else brief).alias("_brief"))
    schema = source.drop("_prompt", "_brief").schema.add("reply", StringType()).add("_used", USED)

    def reply(text: str | None, before: str | None, meter: model.Meter) -> str:
        if text is None:
            return ""
        try:
            said = [{"role": "user", "content": before}] if before is not None else []
            return meter.complete(client, [system, *said, {"role": "user", "content": text}], tier)
        except Exception:
            if must:
                raise
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meters = [model.Meter() for _ in range(batch.num_rows)]
            replies = [reply(t, b, m) for t, b, m in zip(batch.column("_prompt").to_pylist(), batch.column("_brief").to_pylist(), meters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(replies, pa.string()), pa.array([m.used for m in meters], _USED)], names=[*keep, "reply", "_used"])

    told = source.mapInArrow(run, schema)
    if (record := _recorder.get()) is not None:
        told = lineage_cut(told)
        record(task, tier, told.select(F.sha2(F.to_json(F.struct(*keep)), 256).alias("key"), "_used.*").where("calls > 0"))
    return told.select(*keep, "reply")


def _list(items: Column) -> Column:
    return F.to_json(items)


def languages(samples: DataFrame, key: list[str], text: str, client: model.Provider | None = None) -> DataFrame:
    """(key..., language): the code of the language, empty where it is unknown or the call fails."""
    told = ask(samples, key, "language", F.substring(text, 1, DETECT_CHARS), "cheap", client)
    return told.select(*key, language_code(F.coalesce(F.get_json_object("reply", "$.language"), F.lit(""))).alias("language"))


def analyses(samples: DataFrame, key: list[str], text: str, client: model.Provider | None = None, src: str = "") -> DataFrame:
    """(key..., analysis): the analysis as JSON, null if the call fails or answers none."""
    told = ask(samples, key, "analysis", F.col(text), "strong", client, src=src)
    return told.select(*key, loose_json(F.col("reply")).alias("analysis"))


def seed_terms(analyses_: DataFrame, key: list[str]) -> DataFrame:
    """Proposals of chapter 0 from analyses: characters as people first, then terms, in their order."""
    parts = []
    for rank, (field, kind) in enumerate((("characters", "人物"), ("terms", None))):
        found = extraction.extracted_terms(analyses_.withColumn("_part", F.get_json_object("analysis", f"$.{field}")), key, "_part")
        parts.append(found.withColumns({"type": F.lit(kind) if kind else F.col("type"), "seq": F.col("position") + F.lit(rank * 1_000_000).cast("long"), "chapter": F.lit(0)}))
    return parts[0].unionByName(parts[1]).drop("position").withColumn("aliases", F.array().cast("array<string>"))


def chapter_digests(chapters: DataFrame, key: list[str], text: str, client: model.Provider | None = None) -> DataFrame:
    """(key..., digest): each chapter summed up from its first characters, empty if the call fails."""
    told = ask(chapters.where(~is_blank(F.col(text))), key, "digest", F.substring(text, 1, DIGEST_CHARS), "fast", client)
    return told.withColumnRenamed("reply", "digest")


def synopses(digests: DataFrame, book: list[str], order: str, digest: str = "digest", client: model.Provider | None = None, budget: int = SYNOPSIS_CHARS) -> DataFrame:
    """(book..., synopsis): digests packed into groups under the budget and summed up, again and again until
    one is left; blank ones are dropped. Every round is a plan over all books; of a round in which nothing
    would fit together two go into a group, so the rounds end."""
    level = digests.where(~is_blank(F.col(digest))).select(*book, F.col(order).cast("long").alias("_at"), F.col(digest).alias("_text"))
    while level.groupBy(*book).count().where("count > 1").limit(1).count():
        one = folds.ordered_items(level, book, ["_at"], F.col("_text"))
        starts = folds.batch_starts(F.transform("items", lambda x: F.length(x)), budget, separator=1)
        pairs = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: i % 2 == 0)
        grouped = folds.explode_batches(one, book, F.when((F.size(starts) == F.size("items")) & (F.size("items") > 1), pairs).otherwise(starts))
        alone = F.size("items") == 1
        told = ask(grouped.withColumn("_one", F.when(alone, F.get("items", F.lit(0)))), [*book, "batch", "_one"], "synopsis", F.when(~alone, F.array_join("items", "\n")), "fast", client)
        # Cut, or the next round would ask everything again.
        level = lineage_cut(told.select(*book, F.col("batch").cast("long").alias("_at"), F.coalesce("_one", "reply").alias("_text")).where(~is_blank(F.col("_text"))))
    return level.select(*book, F.col("_text").alias("synopsis"))


#: What of a book's glossary a batch is told: terms of its own texts, of its chapter's, or all.
SCOPES = ("batch", "chapter", "full")
_BATCH = "path string, chapter int, start int, segs array<int>, targets array<string>, calls int, error string, fresh boolean, terms string, used struct<{0}>, terms_used struct<{0}>".format(",".join(f"{f}:bigint" for f in usage.FIELDS))


def translated_books(
    batches: DataFrame, client: model.Provider | None = None, retries: int = 2, context: int = 6, terms: DataFrame | None = None, scope: str = "chapter", **names: str
) -> DataFrame:
    """Translate the batches of each book in order, every one with the last targets before it.

    ``batches`` has (path, chapter, start, done, segs, items, targets, brief): done ones are not asked but
    give context. Returns (path, chapter, start, segs, targets, calls, error, fresh) of the others. A book whose
    batch has no answer ends there with the error; what was done before is returned, so it is not lost.
    One task holds one book; books are independent of each other.

    With ``terms`` (path, source, target, type, reading, gender, note, aliases), the book's glossary goes along
    and grows: after every batch the model is asked for the terms of its texts, and what it finds stands in
    the briefs of the batches that follow (``scope``). Batches whose column ``known`` is true have been asked
    before. The replies come back as ``terms``, also of done batches (``fresh`` is false for these). All of
    it is a function of the rows of the book, so a task that is run again gives the same."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; known: {', '.join(SCOPES)}")
    client = client or model.FakeProvider()
    system = {"role": "system", "content": rendered(PROMPTS["translate"], **names)}
    asks_terms = {"role": "system", "content": PROMPTS["terms"]}
    used = pa.struct([(f, pa.int64()) for f in usage.FIELDS])
    types = pa.schema(
        [("path", pa.string()), ("chapter", pa.int32()), ("start", pa.int32()), ("segs", pa.list_(pa.int32())), ("targets", pa.list_(pa.string())), ("calls", pa.int32()), ("error", pa.string())]
        + [("fresh", pa.bool_()), ("terms", pa.string()), ("used", used), ("terms_used", used)]
    )
    with_terms = terms is not None

    def found_terms(row: dict, targets: list[str], book: glossary.BookTerms, meter: model.Meter) -> str:
        pair = {"source": "\n".join(row["items"]), "target": "\n".join(t or "" for t in targets)}
        try:
            reply = meter.complete(client, [asks_terms, {"role": "user", "content": json.dumps(pair, ensure_ascii=False)}], "fast")
        except Exception:  # a batch without terms is still translated
            return ""
        book.propose(model.terms_of(reply))
        return reply

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        seen: deque[str] = deque(maxlen=max(context, 1))
        book, out = glossary.BookTerms(known.sort_by("source").to_pylist()), []
        ordered = rows.sort_by([("chapter", "ascending"), ("start", "ascending")]).to_pylist()
        chapters: dict[int, list[str]] = {}
        for row in ordered:
            chapters.setdefault(row["chapter"], []).extend(row["items"])
        for row in ordered:
            found, calls, error, meter, meter_of_terms, reply = row["targets"], 0, None, model.Meter(), model.Meter(), None
            if not row["done"]:
                brief = row["brief"] or ""
                if with_terms:
                    text = {"batch": row["items"], "chapter": chapters[row["chapter"]], "full": None}[scope]
                    lines = book.lines(None if text is None else "\n".join(text))
                    brief = json.dumps((json.loads(brief) if brief else {}) | ({"glossary": lines} if lines else {}), ensure_ascii=False)
                said = json.dumps({"brief": brief, "before": list(seen) if context else []}, ensure_ascii=False)
                try:
                    found, calls = model.translate_aligned(row["items"], client, retries, brief=[system, {"role": "user", "content": said}], meter=meter)
                except model.AlignmentError as e:
                    found, error = None, str(e)
            if with_terms and not error and not row["known"]:
                reply = found_terms(row, found, book, meter_of_terms)
            if not row["done"] or reply is not None:
                new = {"targets": found if not row["done"] else None, "calls": calls, "error": error, "fresh": not row["done"], "terms": reply, "used": meter.used, "terms_used": meter_of_terms.used}
                out.append({k: row[k] for k in ("path", "chapter", "start", "segs")} | new)
            if error:
                break
            seen.extend(t for t in found if t and t.strip())
        return pa.Table.from_pylist(out, types)

    known = F.coalesce("known", F.lit(False)) if "known" in batches.columns else F.lit(False)
    cut = batches.select("path", F.col("chapter").cast("int"), F.col("start").cast("int"), "done", F.transform("segs", lambda x: x.cast("int")).alias("segs"), "items", "targets", "brief", known.alias("known"))
    fields = ("path", *extraction.TERM_FIELDS, "aliases")
    own = terms.select(*fields) if with_terms else cut.sparkSession.createDataFrame([], "path string, source string, target string, reading string, type string, gender string, note string, aliases array<string>")
    return cut.groupBy("path").cogroup(own.groupBy("path")).applyInArrow(run, _BATCH)


def fixes(segments: DataFrame, key: list[str], client: model.Provider | None = None, **names: str) -> DataFrame:
    """(key..., source, target): texts (source, feedback, before, after) translated anew with the remarks and
    the neighbours; the target is empty if the call fails, and null if a check speaks against it."""
    told = ask(segments, [*key, "source"], "fix", F.to_json(F.array("source")), "strong", client, brief=F.to_json(F.struct("feedback", "before", "after")), **names)
    target = F.coalesce(F.get_json_object(loose_json(F.col("reply")), "$.translations[0]"), F.get_json_object(loose_json(F.col("reply")), "$[0]"), F.lit(""))
    return told.select(*key, "source", target.alias("target")).withColumn("target", F.when(checks.accepts_fix(F.col("source"), F.col("target")), F.col("target")))


def polished(batches: DataFrame, key: list[str], items: str, client: model.Provider | None = None, **names: str) -> DataFrame:
    """(key..., targets): polished texts, or the given ones if their number changes or the call fails."""
    told = ask(batches, [*key, items], "polish", _list(F.col(items)), "strong", client, **names)
    reply = loose_json(F.col("reply"))
    found = F.coalesce(F.from_json(F.get_json_object(reply, "$.translations"), "array<string>"), F.from_json(reply, "array<string>"))
    return told.select(*key, F.when(F.size(found) == F.size(items), found).otherwise(F.col(items)).alias("targets"))


def titles(batches: DataFrame, key: list[str], items: str, client: model.Provider | None = None, **names: str) -> DataFrame:
    """(key..., titles): one title for each; another number of them is an error."""
    told = ask(batches, [*key, items], "titles", _list(F.col(items)), "strong", client, must=True, **names)
    reply = loose_json(F.col("reply"))
    found = F.coalesce(F.from_json(F.get_json_object(reply, "$.translations"), "array<string>"), F.from_json(reply, "array<string>"))
    same = F.coalesce(F.size(found) == F.size(items), F.lit(False))
    return told.select(*key, F.when(same, found).otherwise(F.raise_error(F.lit("titles: another number of titles than asked for"))).alias("titles"))


def terms(batches: DataFrame, key: list[str], source: Column, target: Column, client: model.Provider | None = None) -> DataFrame:
    """Terms (key..., position, fields) that a model finds in source and target; none if the call fails."""
    told = ask(batches, key, "terms", F.to_json(F.struct(source.alias("source"), target.alias("target"))), "fast", client)
    reply = loose_json(F.col("reply"))
    return extraction.extracted_terms(told.withColumn("_list", F.coalesce(F.get_json_object(reply, "$.terms"), reply)), key, "_list")


def _issues(told: DataFrame, key: list[str]) -> DataFrame:
    """Issues (key..., index as text, type, detail) of replies; items that are no objects are dropped."""
    reply = loose_json(F.col("reply"))
    listed = told.withColumn("_list", F.coalesce(F.get_json_object(reply, "$.issues"), reply))
    return extraction.records(listed, key, "_list", ("index", "type", "detail")).drop("position")


def reviews(chunks: DataFrame, key: list[str], client: model.Provider | None = None) -> DataFrame:
    """Issues of chunks (key..., items array<struct<source, target>>); a failure fails the job."""
    pairs = F.to_json(F.transform("items", lambda x, i: F.struct(i.alias("index"), x["source"].alias("source"), x["target"].alias("target"))))
    return _issues(ask(chunks, key, "review", pairs, "cheap", client, must=True), key)


def back_translations(batches: DataFrame, key: list[str], client: model.Provider | None = None, **names: str) -> DataFrame:
    """Issues (key..., index, type, detail) between sources and what their targets are translated back to.

    ``batches`` has items array<struct<source, target>>; another number of texts gives no issues."""
    told = ask(batches, [*key, "items"], "back", F.to_json(F.transform("items", lambda x: x["target"])), "fast", client, **names)
    back = F.from_json(F.get_json_object(loose_json(F.col("reply")), "$.translations"), "array<string>")
    pairs = F.to_json(F.zip_with("items", back, lambda x, b: F.struct(x["source"].alias("source"), b.alias("back"))))
    return _issues(ask(told, key, "compare", F.when(F.size(back) == F.size("items"), pairs), "cheap", client), key)


def consistency(digests: DataFrame, key: list[str], glossary: str, digest: str, client: model.Provider | None = None) -> DataFrame:
    """Issues between a glossary and the digests of a book's chapters; none where both are empty."""
    some = ~is_blank(F.col(glossary)) | ~is_blank(F.col(digest))
    return _issues(ask(digests, key, "consistency", F.when(some, F.to_json(F.struct(glossary, digest))), "cheap", client), key)


def ordered_briefs(lines: DataFrame, key: list[str], order: list[str], line: str) -> DataFrame:
    """(key..., brief): the lines of each key in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(*order, line)))
    return lines.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x[line]), "\n").alias("brief"))
