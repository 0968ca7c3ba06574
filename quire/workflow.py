"""The steps of translating a shelf of books, over tables in a state folder.

``prepare`` reads books, ``understand`` tells languages, styles and contents, ``translate`` fills targets,
``review`` lists issues, ``fix`` heeds them, ``titles`` names chapters, ``qa`` compares them, ``report``
sums up and ``assemble`` writes books. Every step can be run again: work that is done is not done twice.
Books are independent of each other, so every step runs over all of them at once; within a book the order
of batches counts only where one gives context to the next. Each step writes the table that marks its work
as done last, so that a step that was cut short is taken up where it stopped.
"""

from __future__ import annotations

import argparse
import functools
import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import config
from quire.functions.loose_json import loose_json
from quire.functions.punctuation import normalize
from quire.functions.text import chapter_label, is_blank, translation_guidance
from quire.operators import agents, checks, extraction, folds, glossary, memory, model, ordered, render, sinks, usage
from quire.operators import status as machine
from quire.operators.segments import split_text
from quire.session import lineage_cut
from quire.sources import event_log
from quire.sources.books import book_files, fb2_images, left_out, read_files

# Sizes of batches of titles, and the fields of a style brief.
TITLE_CHARS, TITLE_COUNT = 4000, 40
STYLE = ("genre", "tone", "era", "narration", "audience", "devices", "register", "advice")
#: Events of a chapter and what they do to its status.
CHAPTER_EVENTS = {"chapter_started": "start", "chapter_finished": "finish", "chapter_failed": "fail"}
TABLES = {
    "files": "path string, fmt string, content binary",
    "targets": "path string, chapter int, seg int, target string, seq long",
    "books": "path string, language string, analysis string",
    "digests": "path string, chapter int, digest string",
    "synopses": "path string, synopsis string, n_chapters long",
    "proposals": "path string, source string, target string, reading string, gender string, note string, type string, aliases array<string>, chapter int, seq long",
    "decisions": "path string, source string, target string, seq long",
    "reviews": "path string, chapter int, digest string, run string, seq long, review_status string",
    "issues": "path string, chapter int, seg int, type string, detail string, run string",
    "titles": "path string, chapter int, title_translated string, seq long",
    "usage": "run string, stage string, task string, tier string, key string, calls long, prompt long, completion long, total long, cache_hit long, cache_miss long",
    "qa": "path string, index string, type string, detail string, seq long",
}


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, state: str, name: str) -> DataFrame:
    """A table of the state, empty if nothing has been written to it."""
    path = f"{state}/{name}"
    return spark.read.schema(TABLES[name]).parquet(path) if _there(spark, path) else spark.createDataFrame([], TABLES[name])


def _append(state: str, name: str, rows: DataFrame) -> None:
    columns = [f.split()[0] for f in TABLES[name].split(", ")]
    typed = [F.col(c).cast(f.split(maxsplit=1)[1]).alias(c) for c, f in zip(columns, TABLES[name].split(", "), strict=True)]
    rows.select(typed).write.mode("append").parquet(f"{state}/{name}")


@contextmanager
def locked(spark: SparkSession, state: str) -> Iterator[None]:
    """Only one run writes to a state folder; RuntimeError for a second one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{state}/_lock")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.createNewFile(path):
        raise RuntimeError(f"another run writes to {state}; if none does, delete {state}/_lock")
    try:
        yield
    finally:
        fs.delete(path, False)


def segments(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/segments")


def prepare(spark: SparkSession, books: str, state: str, settings: dict | None = None) -> DataFrame:
    """Read all books below a path into ``segments`` with long segments split; books known are left, and so
    are files of no supported format and PDFs that were not converted, which are logged. EPUBs and HTML pages are kept as they are,
    to be translated in place, and FB2 files for their images."""
    settings = settings or config.DEFAULTS
    _log(state, left_out(book_files(spark, books, contents=False)), "file_left_out")
    files = book_files(spark, books).where("fmt is not null and content is not null")
    if _there(spark, f"{state}/segments"):
        files = files.join(segments(spark, state).select("path").distinct(), "path", "left_anti")
    pieces = read_files(files, settings["segment"]["chapter_split"]).select("*", F.posexplode(split_text(F.col("source"), settings["segment"]["long_segment_chars"])).alias("_k", "_piece"))
    first = F.col("_k") == 0
    dense = F.row_number().over(Window.partitionBy("path", "chapter").orderBy("seg", "_k")) - 1
    out = pieces.withColumns({"_seg": dense, "kind": F.when(first, F.col("kind")).otherwise("text"), "anchor": F.when(first, F.col("anchor")), "cont": ~first})
    _append(state, "files", files.where("fmt in ('epub', 'fb2', 'html')"))
    out.drop("seg", "source", "_k").withColumnsRenamed({"_seg": "seg", "_piece": "source"}).write.mode("append").parquet(f"{state}/segments")
    return segments(spark, state)


def targets(spark: SparkSession, state: str) -> DataFrame:
    """The last target of every segment."""
    return memory.latest(read(spark, state, "targets"), ["path", "chapter", "seg"], "target")


def current(spark: SparkSession, state: str) -> DataFrame:
    """Segments with target and the status of their chapter: done if no text lacks its target, else what
    the events of its runs led to: failed, running while a run holds the state, or pending, to which a
    chapter falls back whose run ended without a word."""
    s = segments(spark, state).join(targets(spark, state), ["path", "chapter", "seg"], "left")
    missing = F.max((is_blank(F.col("target")) & ~is_blank(F.col("source"))).cast("int")).over(Window.partitionBy("path", "chapter"))
    actions = F.create_map(*(F.lit(x) for kv in CHAPTER_EVENTS.items() for x in kv))
    told = _all_events(spark, state).withColumn("action", F.try_element_at(actions, F.col("event"))).where("action is not null")
    after = machine.after_events(told, ["path", "chapter"], "ts").select("path", "chapter", F.col("status").alias("_told"))
    alive = F.lit(_there(spark, f"{state}/_lock"))
    known = F.when(F.col("_told") == "failed", "failed").when((F.col("_told") == "running") & alive, "running").otherwise("pending")
    return s.join(after, ["path", "chapter"], "left").withColumn("status", F.when(missing == 0, "done").otherwise(known)).drop("_told")


def _log(state: str, rows: DataFrame, event: str) -> None:
    event_log.append(rows.withColumns({"event": F.lit(event), "ts": F.current_timestamp()}), f"{state}/events")


def _all_events(spark: SparkSession, state: str) -> DataFrame:
    """Events (path, chapter, key, event, ts)."""
    if not _there(spark, f"{state}/events"):
        return spark.createDataFrame([], "path string, chapter int, key string, event string, ts string")
    data = event_log.read(spark, f"{state}/events")
    text = lambda name: event_log.text_field(F.col("data"), name).alias(name)
    return data.select(text("path"), F.try_variant_get("data", "$.chapter", "int").alias("chapter"), text("key"), text("event"), F.to_timestamp(text("ts")).alias("ts"))


def _events(spark: SparkSession, state: str, event: str) -> DataFrame:
    """Events of one kind (path, chapter, key)."""
    return _all_events(spark, state).where(F.col("event") == event).select("path", "chapter", "key")


def _counted(stage: str) -> Callable:
    """A step whose calls are counted, whatever its tasks: every call once, by run, task and key."""

    def wrap(step: Callable) -> Callable:
        @functools.wraps(step)
        def run(spark: SparkSession, state: str, *args, **kwargs):
            name, asked = uuid.uuid4().hex, itertools.count()

            def record(task: str, tier: str, rows: DataFrame) -> None:
                key = F.concat(F.lit(f"{next(asked)}:"), "key")
                _append(state, "usage", rows.withColumns({"run": F.lit(name), "stage": F.lit(stage), "task": F.lit(task), "tier": F.lit(tier), "key": key}))

            with agents.recording(record):
                return step(spark, state, *args, **kwargs)

        return run

    return wrap


def usage_report(spark: SparkSession, state: str) -> DataFrame:
    """Calls and tokens by tier, by stage and in all; rows that were appended twice count once."""
    once = read(spark, state, "usage").dropDuplicates(["run", "task", "key"])
    return usage.rolled_up(once.select("tier", "stage", *usage.FIELDS))


def chapter_texts(spark: SparkSession, state: str) -> DataFrame:
    """(path, chapter, text): the sources of each chapter in order, a line each."""
    parts = F.array_sort(F.collect_list(F.struct("seg", "source")))
    filled = segments(spark, state).where(~is_blank(F.col("source")))
    return filled.groupBy("path", "chapter").agg(F.array_join(F.transform(parts, lambda x: x["source"]), "\n").alias("text"))


@_counted("understand")
def understand(spark: SparkSession, state: str, client: model.Provider | None = None, settings: dict | None = None) -> DataFrame:
    """Language, analysis, first terms, chapter digests and synopsis of every book that lacks them.

    Books whose language stays unknown, or is the target's, get an event and no translation."""
    settings = settings or config.DEFAULTS
    texts = chapter_texts(spark, state)
    fresh = texts.join(read(spark, state, "books").select("path"), "path", "left_anti")
    long = F.length("text") > 200
    sample = fresh.groupBy("path").agg(F.coalesce(F.min_by(F.when(long, F.col("text")), F.when(long, F.col("chapter"))), F.min_by("text", "chapter")).alias("text"))
    if settings["source_lang"] == "auto":
        told = agents.languages(sample, ["path"], "text", client)
    else:
        told = sample.select("path", F.lit(settings["source_lang"]).alias("language"))
    picks = checks.sample_text(fresh, "path", "chapter", "text")
    place = F.when(F.col("place") == "first", 0).when(F.col("place") == "middle", 1).otherwise(2)
    shown = picks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), "sample"))), lambda x: x["sample"]), "\n\n").alias("shown"))
    asked = sample.join(shown, "path", "left").select("path", F.coalesce("shown", F.substring("text", 1, 6000)).alias("text"))
    found = lineage_cut(agents.analyses(asked, ["path"], "text", client, settings["source_lang"]).join(told, "path"))
    if settings["pipeline"]["understanding"]:
        lacking = texts.join(digests_of(spark, state).select("path", "chapter"), ["path", "chapter"], "left_anti")
        _append(state, "digests", agents.chapter_digests(lacking, ["path", "chapter"], "text", client))
        digests = digests_of(spark, state)
        counts = digests.groupBy("path").agg(F.count("*").alias("n_chapters"))
        stale = counts.join(read(spark, state, "synopses").select("path", "n_chapters"), ["path", "n_chapters"], "left_anti")
        made = agents.synopses(digests.join(stale.select("path"), "path"), ["path"], "chapter", client=client)
        _append(state, "synopses", made.join(counts, "path"))
    failed = found.where("analysis is null").select("path")
    found = found.where("analysis is not null")
    _append(state, "proposals", agents.seed_terms(found, ["path"]))
    refused = found.where((F.col("language") == "") | (F.col("language") == F.substring(F.lit(settings["target_lang"]), 1, 2)))
    _log(state, refused.select("path", "language"), "language_refused")
    _append(state, "books", found)
    _log(state, failed, "analysis_failed")
    if bad := failed.limit(1).collect():  # the other books are kept; these are asked again by the next run
        raise RuntimeError(f"{bad[0]['path']}: no analysis")
    return read(spark, state, "books")


def digests_of(spark: SparkSession, state: str) -> DataFrame:
    """(path, chapter, digest) of chapters that have one; a failed digest is blank and is asked for again."""
    return read(spark, state, "digests").where(~is_blank(F.col("digest"))).groupBy("path", "chapter").agg(F.max("digest").alias("digest"))


def terms(spark: SparkSession, state: str) -> tuple[DataFrame, DataFrame]:
    """(terms, conflicts) of all books after their proposals and decisions."""
    t, c = glossary.upsert(read(spark, state, "proposals"), ("path",))
    decided = memory.latest(read(spark, state, "decisions"), ["path", "source"], "target").withColumnRenamed("target", "_chosen")
    open_ = F.col("_chosen").isNull()
    t = t.join(decided, ["path", "source"], "left").withColumns({"target": F.coalesce("_chosen", "target"), "status": F.when(open_, F.col("status")).otherwise("ok")}).drop("_chosen")
    return t, c.join(decided, ["path", "source"], "left").withColumn("resolved", ~open_).drop("_chosen")


def resolve_term(spark: SparkSession, state: str, path: str, source: str, target: str) -> None:
    """Decide for a target; later proposals do not change it."""
    last = read(spark, state, "decisions").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    _append(state, "decisions", spark.createDataFrame([(path, source, target, last + 1)], TABLES["decisions"]))


def _briefs(spark: SparkSession, state: str, batches: DataFrame, settings: dict) -> DataFrame:
    """The batches (path, chapter, start, items) with ``brief``: style, synopsis, digest and what is to be heeded
    in texts of the book's language; their terms come to it when they are asked, since they grow with the book."""
    fields = {f: F.coalesce(F.get_json_object("analysis", f"$.{f}"), F.lit("")) for f in STYLE}
    style = read(spark, state, "books").groupBy("path").agg(F.max("analysis").alias("analysis")).select("path", ordered.style_brief(fields).alias("_style"))
    synopses = read(spark, state, "synopses").groupBy("path").agg(F.max_by("synopsis", "n_chapters").alias("synopsis"))
    languages = read(spark, state, "books").groupBy("path").agg(F.max("language").alias("_language"))
    code = F.coalesce("_language", F.lit(""))
    guidance = translation_guidance(code, F.lit(settings["honorifics"])).alias("guidance")
    joined = batches.join(style, "path", "left").join(languages, "path", "left").join(synopses, "path", "left").join(digests_of(spark, state), ["path", "chapter"], "left")
    return joined.withColumn("brief", F.to_json(F.struct(F.col("_style").alias("style"), "synopsis", "digest", guidance))).drop("_style", "synopsis", "digest", "_language")


def _append_targets(spark: SparkSession, state: str, rows: DataFrame, settings: dict) -> None:
    last = read(spark, state, "targets").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    shown = rows.withColumn("target", normalize(F.col("target"))) if config.punctuation_wanted(settings) else rows
    _append(state, "targets", shown.withColumn("seq", F.lit(last + 1)))


def _batches(items: DataFrame, settings: dict) -> DataFrame:
    packed = folds.pack(items, ["path", "chapter"], ["seg"], F.struct("seg", "source", "target"), lambda x: F.length(x["source"]), settings["segment"]["batch_chars"])
    cut = folds.resume_batches(packed, ["path", "chapter"], lambda x: ~is_blank(x["target"]))
    field = lambda f: F.transform("items", lambda x: x[f])
    return cut.select("path", "chapter", "start", "done", field("seg").alias("segs"), field("target").alias("targets"), field("source").alias("items"))


@_counted("translate")
def translate(spark: SparkSession, state: str, client: model.Provider | None = None, settings: dict | None = None, only_chapter: int | None = None) -> DataFrame:
    """Translate what has no target, in batches that never mix done and open segments.

    Every batch is asked with style, synopsis, digest, its terms, also those found in the batches before it
    in this run, and the last targets before it. What was translated is saved even if a book could not be
    finished; then the step fails with AlignmentError. Terms that were found are proposed once per batch."""
    settings = settings or config.DEFAULTS
    items = current(spark, state).where(~is_blank(F.col("source")))
    refused = _events(spark, state, "language_refused").select("path").distinct()
    items = items.join(refused, "path", "left_anti")
    if only_chapter is not None:
        last = items.agg(F.max("chapter")).first()[0]
        if not items.where(F.col("chapter") == only_chapter).limit(1).count():
            raise ValueError(f"there is no chapter {only_chapter}; known: 0 to {last}")
    cut = _batches(items, settings)
    if only_chapter is not None:
        cut = cut.where((F.col("chapter") == only_chapter) | F.col("done"))
    p = settings["pipeline"]
    _log(state, cut.where("not done").select("path", "chapter").distinct(), "chapter_started")
    extracted = _events(spark, state, "terms_extracted").select("path", "chapter", F.col("key").alias("_key"), F.lit(True).alias("known"))
    cut = cut.withColumn("_key", F.concat_ws(":", "start", F.size("items")))
    asked = _briefs(spark, state, cut.join(extracted.distinct(), ["path", "chapter", "_key"], "left"), settings)
    books = agents.translated_books(asked, client, p["align_retries"], p["rolling_context"], terms(spark, state)[0], p["glossary_scope"], src=settings["source_lang"], tgt=settings["target_lang"])
    answered = lineage_cut(books)
    _count_batches(state, answered)
    done = answered.where("error is null and fresh")
    if p["polish"]:
        polished = agents.polished(done, ["path", "chapter", "start", "segs"], "targets", client, tgt=settings["target_lang"])
        done = lineage_cut(polished)
    each = done.select("path", "chapter", F.explode(F.arrays_zip("segs", "targets")).alias("x")).select("path", "chapter", F.col("x.segs").alias("seg"), F.col("x.targets").alias("target"))
    _append_targets(spark, state, each, settings)
    _propose(spark, state, answered.where("terms is not null"))
    failed = answered.where("error is not null").select("path", "chapter", F.col("error").alias("key"))
    finished = current(spark, state).where("status = 'done'").join(cut.where("not done").select("path", "chapter").distinct(), ["path", "chapter"], "left_semi")
    _log(state, finished.select("path", "chapter").distinct(), "chapter_finished")
    _log(state, failed, "chapter_failed")
    bad = failed.limit(1).collect()
    if bad:
        raise model.AlignmentError(f"{bad[0]['path']}, chapter {bad[0]['chapter']}: {bad[0]['key']}")
    return current(spark, state)


def _count_batches(state: str, answered: DataFrame) -> None:
    """The calls of the batches of a run, for translations and for terms, to the usage."""
    run, key = uuid.uuid4().hex, F.concat_ws(":", "path", "chapter", "start")
    for task, tier, used in (("translate", "strong", "used"), ("terms", "fast", "terms_used")):
        rows = answered.select(key.alias("key"), f"{used}.*").where("calls > 0")
        _append(state, "usage", rows.withColumns({"run": F.lit(run), "stage": F.lit("translate"), "task": F.lit(task), "tier": F.lit(tier)}))


def _propose(spark: SparkSession, state: str, answered: DataFrame) -> None:
    """The terms that batches were answered with (path, chapter, start, segs, terms), proposed in book order,
    and the events that say so."""
    reply = loose_json(F.col("terms"))
    listed = answered.withColumn("_list", F.coalesce(F.get_json_object(reply, "$.terms"), reply))
    found = extraction.extracted_terms(listed, ["path", "chapter", "start"], "_list")
    last = read(spark, state, "proposals").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    place = F.row_number().over(Window.partitionBy("path").orderBy("chapter", "start", "position"))
    _append(state, "proposals", found.withColumns({"seq": place + last, "aliases": F.array().cast("array<string>")}))
    _log(state, answered.select("path", "chapter", F.concat_ws(":", "start", F.size("segs")).alias("key")), "terms_extracted")


def review_digests(spark: SparkSession, state: str) -> DataFrame:
    """(path, chapter, digest) of done chapters: of their texts and of the terms that occur in them."""
    done = current(spark, state).where("status = 'done'").where(~is_blank(F.col("source")))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("seg", "source", "target"))), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))
    texts = done.groupBy("path", "chapter").agg(shown.alias("t"))
    known, _ = terms(spark, state)
    hits = glossary.terms_in_texts(known, chapter_texts(spark, state), ["path", "chapter"], book=("path",))
    six = F.array_sort(F.collect_list(F.struct("source", "target", "reading", "type", "gender", "note")))
    per = hits.join(known, ["path", "source"]).groupBy("path", "chapter").agg(six.alias("terms"))
    none = F.array().cast(per.schema["terms"].dataType)
    both = texts.join(per, ["path", "chapter"], "left")
    return both.select("path", "chapter", checks.review_digest(F.col("t"), F.coalesce("terms", none), version=2).alias("digest"))


def reviewed(spark: SparkSession, state: str) -> DataFrame:
    """The last review of each chapter (path, chapter, digest, run) that still is of its texts and terms."""
    last = read(spark, state, "reviews").groupBy("path", "chapter").agg(F.max_by(F.struct("digest", "run", "review_status"), "seq").alias("r")).select("path", "chapter", "r.*")
    return last.join(review_digests(spark, state), ["path", "chapter", "digest"])


def issues(spark: SparkSession, state: str) -> DataFrame:
    """The issues of the reviews that hold; those of older reviews and texts are not counted again."""
    runs = reviewed(spark, state).select("path", "chapter", "run")
    return read(spark, state, "issues").join(runs, ["path", "chapter", "run"], "left_semi")


@_counted("review")
def review(spark: SparkSession, state: str, client: model.Provider | None = None, force: bool = False, settings: dict | None = None) -> DataFrame:
    """Issues of done chapters in chunks; chapters reviewed with the same texts and terms are not asked again."""
    settings = settings or config.DEFAULTS
    digests = lineage_cut(review_digests(spark, state))
    stored = read(spark, state, "reviews").groupBy("path", "chapter").agg(F.max_by(F.struct("digest", "review_status"), "seq").alias("r")).select("path", "chapter", "r.*")
    todo = checks.to_review(digests, stored, ["path", "chapter"], force)
    budget = settings["segment"]["review_factor"] * settings["segment"]["batch_chars"]
    done = current(spark, state).where(~is_blank(F.col("source"))).join(todo.select("path", "chapter"), ["path", "chapter"])
    chunks = folds.pack(done, ["path", "chapter"], ["seg"], F.struct("seg", "source", "target"), lambda x: F.length(x["source"]), budget)
    found = agents.reviews(chunks.select("path", "chapter", F.transform("items", lambda x: x["seg"]).alias("segs"), "items"), ["path", "chapter", "segs"], client)
    run, last = uuid.uuid4().hex, read(spark, state, "reviews").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    number = F.expr("try_cast(trim(`index`) AS int)")
    placed = found.withColumn("_i", number).where((F.col("_i") >= 0) & (F.col("_i") < F.size("segs"))).withColumns({"seg": F.get("segs", F.col("_i")), "run": F.lit(run)})
    _append(state, "issues", placed)
    _append(state, "issues", _compared_back(chunks, settings, client).withColumn("run", F.lit(run)))
    _append(state, "reviews", todo.withColumns({"run": F.lit(run), "seq": F.lit(last + 1), "review_status": F.lit("done")}))  # last: it makes the issues count
    return issues(spark, state)


def _compared_back(chunks: DataFrame, settings: dict, client: model.Provider | None) -> DataFrame:
    """Issues (path, chapter, seg, type, detail) of a sample of segments that are translated back and compared
    with their sources. A segment is in the sample by a hash of its place, so a review that is run again
    takes the same; the share is a setting."""
    rate = settings["pipeline"]["back_translation_rate"]
    taken = lambda x: F.pmod(F.xxhash64("path", "chapter", x["seg"]), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))
    picked = chunks.select("path", "chapter", F.filter("items", taken).alias("_picked")).where(F.size("_picked") > 0)
    asked = picked.select("path", "chapter", F.transform("_picked", lambda x: x["seg"]).alias("segs"), F.transform("_picked", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"))).alias("items"))
    found = agents.back_translations(asked, ["path", "chapter", "segs"], client, src=settings["source_lang"], tgt=settings["target_lang"])
    number = F.expr("try_cast(trim(`index`) AS int)")
    inside = found.withColumn("_i", number).where((F.col("_i") >= 0) & (F.col("_i") < F.size("segs")))
    return inside.select("path", "chapter", F.get("segs", F.col("_i")).alias("seg"), F.concat(F.lit("back_translation:"), "type").alias("type"), "detail")


@_counted("fix")
def fix(spark: SparkSession, state: str, client: model.Provider | None = None, settings: dict | None = None) -> DataFrame:
    """Translate what has severe issues anew, with the remarks and the neighbours; a new text is taken if no
    check speaks against it. A chapter with a new text has to be reviewed again."""
    settings = settings or config.DEFAULTS
    told = checks.severe_feedback(issues(spark, state).withColumn("seq", F.col("detail")), ["path", "chapter", "seg"])
    near = checks.neighbours(current(spark, state), ["path", "chapter"], "target")
    asked = near.join(told, ["path", "chapter", "seg"])
    found = lineage_cut(agents.fixes(asked, ["path", "chapter", "seg"], client, src=settings["source_lang"], tgt=settings["target_lang"]))
    _append_targets(spark, state, found.where("target is not null"), settings)
    return current(spark, state)


def chapters(spark: SparkSession, state: str) -> DataFrame:
    """(path, chapter, title, toc_path, toc_node, toc_href, href, source, target): chapters with their first heading."""
    segs = current(spark, state)
    segs = segs if "toc_href" in segs.columns else segs.withColumn("toc_href", F.lit(None).cast("string"))  # state of earlier versions
    of_first = [F.min_by(c, "seg").alias(n) for c, n in (("chapter_title", "title"), ("toc_path", "toc_path"), ("toc_node", "toc_node"), ("toc_href", "toc_href"), ("href", "href"))]
    one = segs.groupBy("path", "chapter").agg(*of_first)
    return one.join(ordered.first_headings(segs, ["path", "chapter"]), ["path", "chapter"], "left")


@_counted("titles")
def titles(spark: SparkSession, state: str, client: model.Provider | None = None, settings: dict | None = None) -> DataFrame:
    """Titles of all chapters that have none yet: that of their heading where it is the same text, else a
    model's, in batches of one book."""
    settings = settings or config.DEFAULTS
    known = chapters(spark, state).where(~is_blank(F.col("title"))).join(read(spark, state, "titles").select("path", "chapter"), ["path", "chapter"], "left_anti")
    named = lineage_cut(ordered.chapter_titles(known.select("path", "chapter", "title"), known.select("path", "chapter", "source", "target"), ["path", "chapter"]))
    packed = folds.pack(named.where(is_blank(F.col("title_translated"))), ["path"], ["chapter"], F.struct("chapter", "title"), lambda x: F.length(x["title"]), TITLE_CHARS, most_items=TITLE_COUNT)
    field = lambda f: F.transform("items", lambda x: x[f])
    told = agents.titles(packed.select("path", field("chapter").alias("at"), field("title").alias("items")), ["path", "at"], "items", client, src=settings["source_lang"], tgt=settings["target_lang"])
    new = told.select("path", F.explode(F.arrays_zip("at", "titles")).alias("x")).select("path", F.col("x.at").alias("chapter"), F.col("x.titles").alias("title_translated"))
    last = read(spark, state, "titles").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    _append(state, "titles", named.where(~is_blank(F.col("title_translated"))).select("path", "chapter", "title_translated").unionByName(new).withColumn("seq", F.lit(last + 1)))
    return read(spark, state, "titles")


@_counted("qa")
def qa(spark: SparkSession, state: str, client: model.Provider | None = None) -> DataFrame:
    """Issues between the glossary and the translated chapters of each book."""
    digest = checks.qa_digest(current(spark, state).where(~is_blank(F.col("source"))), ["path", "chapter", "chapter_title"], "target")
    line = F.concat(chapter_label(F.col("chapter_title"), F.col("chapter")), F.lit(": "), "digest")
    whole = agents.ordered_briefs(digest.withColumn("line", line), ["path"], ["chapter"], "line").withColumnRenamed("brief", "chapters")
    lines = glossary.glossary_lines(terms(spark, state)[0], ["path"])
    found = lineage_cut(agents.consistency(whole.join(lines, "path", "left"), ["path"], "glossary", "chapters", client))
    last = read(spark, state, "qa").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    _append(state, "qa", found.withColumn("seq", F.lit(last + 1)))
    return found


def status(spark: SparkSession, state: str) -> DataFrame:
    """(path, chapter, status, review_status): pending, failed or done; and reviewed or not."""
    there = current(spark, state).select("path", "chapter", "status").distinct()
    done = reviewed(spark, state).select("path", "chapter", "review_status")
    return there.join(done, ["path", "chapter"], "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def report(spark: SparkSession, state: str) -> DataFrame:
    """One row of totals."""
    counts = issues(spark, state).groupBy("path", "chapter").agg(F.count("*").alias("n_issues"))
    empty = F.count_if(is_blank(F.col("target")) & ~is_blank(F.col("source"))).alias("n_empty")
    empties = current(spark, state).groupBy("path", "chapter").agg(empty)
    rows = status(spark, state).join(empties, ["path", "chapter"]).join(counts, ["path", "chapter"], "left")
    return checks.report_summary(rows.withColumn("n_issues", F.coalesce("n_issues", F.lit(0))))


def _joined_paragraphs(segs: DataFrame) -> DataFrame:
    """Continuations joined to what they continue, with what is to be shown as target."""
    running = Window.partitionBy("path", "chapter").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = segs.withColumn("_p", F.sum((~F.col("cont")).cast("int")).over(running)).withColumn("shown", render.shown(F.col("source"), F.col("target")))
    items = F.array_sort(F.collect_list(F.struct("seg", "kind", "anchor", "source", "shown", "level")))
    join = lambda f: F.array_join(F.transform("_x", lambda x: x[f]), "")
    first = lambda f: F.col("_x")[0][f].alias(f)
    grouped = part.groupBy("path", "fmt", "title", "chapter", "chapter_title", F.col("_p").alias("seg")).agg(items.alias("_x"))
    return grouped.select("path", "fmt", "title", "chapter", "chapter_title", "seg", first("kind"), first("anchor"), first("level"), join("source").alias("source"), join("shown").alias("target"))


def assemble(spark: SparkSession, state: str, fmt: str, out: str, bilingual: bool = False, settings: dict | None = None) -> list[str]:
    """Write one file per book, under names that no two books share. An EPUB asked for as EPUB is translated in
    place, entries of its table of contents named like their chapters; an HTML page asked for as HTML is its
    own template; any other book is made anew, with its images at their places."""
    order = (settings or config.DEFAULTS)["output"]["bilingual_order"]
    named = read(spark, state, "titles").groupBy("path", "chapter").agg(F.max_by("title_translated", F.struct(F.coalesce("seq", F.lit(0)), "title_translated")).alias("_title"))
    whole = _joined_paragraphs(current(spark, state)).join(named, ["path", "chapter"], "left").withColumn("chapter_title", F.coalesce("_title", "chapter_title")).drop("_title")
    files = read(spark, state, "files").groupBy("path", "fmt").agg(F.min("content").alias("content"))
    kept = files.where(F.col("fmt") == fmt) if fmt in ("epub", "html") else files.limit(0)
    shelf = whole.select("path")
    rest = whole.join(kept.select("path"), "path", "left_anti")
    new = sinks.assembled(rest, fmt, bilingual, fb2_images(files.where("fmt = 'fb2'")) if fmt == "epub" else None, order, shelf)
    own = whole.join(kept.select("path"), "path", "left_semi")
    if fmt == "html":
        old = sinks.translated_pages(kept, own, bilingual, order)
    elif fmt == "epub":
        with_title = chapters(spark, state).join(named, ["path", "chapter"])
        file_name = F.when(F.col("toc_path").isNull(), F.regexp_extract("href", r"([^/]+)$", 1))
        labels = with_title.select("path", "toc_path", "toc_node", "toc_href", file_name.alias("name"), F.col("_title").alias("label"))
        old = sinks.translated_epubs(kept, own, labels, bilingual, order)
    else:
        return sinks.save_files(new, out)
    every = new.unionByName(sinks.named(old, fmt, bilingual, shelf))
    last = (settings or config.DEFAULTS)["output"]["last_page"]
    if fmt == "epub" and last["title"]:
        every = sinks.with_last_pages(every, last["title"], [p for p in last["text"].split("\n") if p.strip()])
    return sinks.save_files(every, out)


def run(
    spark: SparkSession, books: str, state: str, out: str | None, client: model.Provider | None = None, settings: dict | None = None, fmt: str = "epub", bilingual: bool = False, with_review: bool = True,
    with_qa: bool = True, only_chapter: int | None = None,
) -> list[str]:
    """All steps from books to books, and the files that were written. One chapter of each book is only
    translated; what finishes whole books has to wait for the rest of them."""
    prepare(spark, books, state, settings)
    understand(spark, state, client, settings)
    translate(spark, state, client, settings, only_chapter)
    if only_chapter is not None:
        return []
    if with_review:
        review(spark, state, client, settings=settings)
        fix(spark, state, client, settings)
    titles(spark, state, client, settings)
    if with_qa:
        qa(spark, state, client)
    return assemble(spark, state, fmt, out, bilingual, settings)


#: What asks for a provider, and what of a run is for whole books only.
_ASKING = ("understand", "translate", "review", "fix", "titles", "qa", "run")
_FINISHING = ("format", "out", "review", "qa", "bilingual")


def main(arguments: list[str] | None = None) -> None:
    from quire.session import local_session

    parser = argparse.ArgumentParser(prog="quire", description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="a JSON file of settings")
    steps = parser.add_subparsers(dest="step", required=True)
    for name in ("prepare", "understand", "translate", "review", "fix", "titles", "qa", "report", "status", "usage", "glossary", "assemble", "run", "init-config"):
        step = steps.add_parser(name)
        step.add_argument("state")
        if name in ("prepare", "run"):
            step.add_argument("books")
        if name in _ASKING:
            step.add_argument("--provider")
        if name == "run":
            step.add_argument("--out")
            step.add_argument("--format", choices=sorted(sinks.FORMATS))
            for switch in ("bilingual", "review", "qa"):
                step.add_argument(f"--{switch}", action=argparse.BooleanOptionalAction)
        if name in ("translate", "run"):
            step.add_argument("--chapter", type=int)
            step.add_argument("--polish", action="store_true")
            step.add_argument("--no-punctuation", action="store_true")
        if name in ("understand", "run"):
            step.add_argument("--no-understanding", action="store_true")
        if name == "review":
            step.add_argument("--force", action="store_true")
        if name == "glossary":
            step.add_argument("what", choices=("list", "conflicts", "resolve"))
            step.add_argument("decision", nargs="*", help="for resolve: path source target")
        if name == "assemble":
            step.add_argument("out")
            step.add_argument("--format", default="epub", choices=sorted(sinks.FORMATS))
            step.add_argument("--bilingual", action="store_true")
    a = parser.parse_args(arguments)
    if a.step == "init-config":
        print("written" if config.create_default(a.state) else "there already")
        return
    settings = config.load(a.config)
    pipeline = settings["pipeline"]
    pipeline["polish"] |= getattr(a, "polish", False)
    pipeline["punctuation"] &= not getattr(a, "no_punctuation", False)
    pipeline["understanding"] &= not getattr(a, "no_understanding", False)
    if a.step == "run":
        given = [f"--{n}" for n in _FINISHING if getattr(a, n) is not None]
        if a.chapter is not None and given:
            parser.error(f"--chapter only translates a chapter; leave out {', '.join(given)}")
        if a.chapter is None and a.out is None:
            parser.error("--out is missing")
    client = model.configured(settings, a.provider) if a.step in _ASKING else None  # a key that is missing is told first
    spark = local_session()
    looks = a.step in ("usage", "status", "report") or (a.step == "glossary" and a.what != "resolve")
    with nullcontext() if looks else locked(spark, a.state):
        if a.step == "prepare":
            prepare(spark, a.books, a.state, settings)
        elif a.step == "understand":
            understand(spark, a.state, client, settings)
        elif a.step == "translate":
            translate(spark, a.state, client, settings, a.chapter)
        elif a.step == "review":
            review(spark, a.state, client, a.force, settings)
        elif a.step == "fix":
            fix(spark, a.state, client, settings)
        elif a.step == "titles":
            titles(spark, a.state, client, settings)
        elif a.step == "qa":
            qa(spark, a.state, client).show(truncate=False)
        elif a.step == "usage":
            usage_report(spark, a.state).show()
        elif a.step == "status":
            status(spark, a.state).orderBy("path", "chapter").show(1000, False)
        elif a.step == "glossary" and a.what == "resolve":
            resolve_term(spark, a.state, *a.decision)
        elif a.step == "glossary":
            known, conflicts = terms(spark, a.state)
            (known if a.what == "list" else conflicts.where("not resolved")).show(1000, False)
        elif a.step == "run":
            print("\n".join(run(spark, a.books, a.state, a.out, client, settings, a.format or "epub", bool(a.bilingual), a.review is not False, a.qa is not False, a.chapter)))
        elif a.step == "assemble":
            print("\n".join(assemble(spark, a.state, a.format, a.out, a.bilingual, settings)))
        if a.step in ("report", "translate", "review", "fix", "run"):
            print(json.dumps(report(spark, a.state).first().asDict(), indent=2))


if __name__ == "__main__":
    main()
