"""Reading book files of any supported format into one table of segments.

Files come as Spark's binaryFile rows, so they may lie in any store that Spark reads. Only markup is
parsed in Python; text is cut into chapters, and an EPUB's segments are dealt to the entries of its table
of contents, by DataFrame operators.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import segments, toc
from quire.sources import epub, fb2, html

EXTENSIONS = {".epub": "epub", ".md": "text", ".markdown": "text", ".txt": "text", ".text": "text", ".fb2": "fb2", ".html": "html", ".htm": "html", ".pdf": "pdf"}
#: A page that a PDF was converted to, whole or in numbered parts.
_CONVERTED = r"(?i)^(.*\.pdf)(?:\.(\d+))?\.html?$"
SCHEMA = "path string, fmt string, title string, chapter int, chapter_title string, seg int, kind string, level int, anchor string, source string, href string, toc_path string, toc_node int, toc_href string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_ENTRY = "toc_rank:int,toc_path:string,node:int,parent:int,depth:int,title:string,raw_href:string,href:string,fragment:string,external:boolean"
EPUB = f"path string, title string, segments array<struct<pos:int,resource:int,href:string,kind:string,anchor:string,source:string>>, resources array<struct<href:string,pos:int,size:int>>, fragments array<struct<href:string,fragment:string,pos:int>>, entries array<struct<{_ENTRY}>>"


def format_of(path: str) -> str:
    """The format by extension; ValueError for others."""
    extension = posixpath.splitext(path.lower())[1]
    if extension not in EXTENSIONS:
        raise ValueError(f"unsupported format {extension!r}: {path}")
    return EXTENSIONS[extension]


def _format(path: Column) -> Column:
    """The format by extension, null for others."""
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)))


def book_files(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """The files (path, fmt, content) below a path or glob; fmt is null where the format is not supported.

    The content of a PDF is the page that it was converted to, see ``with_converted``. Without contents nothing
    but names is read, and what would have one has an empty one."""
    content = F.col("content") if contents else F.lit(b"").alias("content")
    return with_converted(spark.read.format("binaryFile").load(path).select("path", _format(F.col("path")).alias("fmt"), content))


def with_converted(files: DataFrame) -> DataFrame:
    """Files with the pages that PDFs were converted to as their content, null where there are none.

    The page of ``a.pdf`` is ``a.pdf.html`` beside it, or ``a.pdf.1.html``, ``a.pdf.2.html`` and so on (UTF-8),
    which are joined in the order of their numbers. Beside their PDF such pages are no books of their own."""
    pdfs = files.where("fmt = 'pdf'").select(F.col("path").alias("_of"))
    others = files.where("fmt is null or fmt <> 'pdf'").withColumn("_of", F.when(F.col("fmt") == "html", F.regexp_extract("path", _CONVERTED, 1)))
    number = F.coalesce(F.regexp_extract("path", _CONVERTED, 2).try_cast("int"), F.lit(0))
    parts = others.join(pdfs, "_of").groupBy("_of").agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), "path", "content"))).alias("_p"))
    texts = F.transform("_p", lambda x: F.make_valid_utf8(x["content"].cast("string")))
    page = F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["content"]).otherwise(text.one_page(texts, _stem(F.col("_of"))).cast("binary"))
    found = pdfs.join(parts, "_of", "left").select(F.col("_of").alias("path"), F.lit("pdf").alias("fmt"), page.alias("content"))
    return others.join(pdfs, "_of", "left_anti").select("path", "fmt", "content").unionAll(found)


def left_out(files: DataFrame) -> DataFrame:
    """(path, reason) of files that are not read: of no supported format, or a PDF that was not converted."""
    reason = F.when(F.col("fmt").isNull(), "unsupported format").when(F.col("content").isNull(), "not converted")
    return files.select("path", reason.alias("reason")).where("reason is not null")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def text_books(files: DataFrame) -> DataFrame:
    """Segments of text and Markdown files, chapters cut at their heading lines."""
    whole = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    texts = files.select("path", whole.alias("text"))
    cut = segments.text_segments(segments.chapters(texts, "path", "text", _stem(F.col("path"))), "path")
    heads = cut.withColumn("anchor", F.concat(F.lit("q"), "chapter", F.lit("_"), "seg"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return heads.select("path", F.lit("text").alias("fmt"), _stem(F.col("path")).alias("title"), F.col("chapter").cast("int"), F.col("title").alias("chapter_title"), F.col("seg").cast("int"), "kind", F.when(F.col("kind") == "heading", F.col("level")).cast("int").alias("level"), "anchor", "source", none("href", "string"), none("toc_path", "string"), none("toc_node", "int"), none("toc_href", "string"))


def markup_books(files: DataFrame) -> DataFrame:
    """Segments of HTML and FB2 files and of converted PDFs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            for path, fmt, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = fb2.chapters(data) if fmt == "fb2" else html.chapters(html.decode(data))
                stem = posixpath.splitext(posixpath.basename(path))[0]
                rows = [(path, fmt, stem, c, ch["title"], s, kind, None, f"q{c}_{s}", text, None, None, None, None) for c, ch in enumerate(found) for s, (kind, text) in enumerate(ch["segments"])]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=COLUMNS)

    return files.select("path", "fmt", "content").mapInArrow(run, SCHEMA)


def fb2_images(files: DataFrame) -> DataFrame:
    """(path, images map<string, binary>, places) of FB2 files: their images, those that cannot be decoded
    left out, and before which segment of which chapter each is shown."""
    place = pa.struct([("chapter", pa.int32()), ("place", pa.int32()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                images = fb2.binaries(data)
                shown = [{"chapter": c, "place": n, "name": name} for c, ch in enumerate(fb2.chapters(data)) for n, name in ch["images"] if name in images]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([list(images.items())], pa.map_(pa.string(), pa.binary())), pa.array([shown], pa.list_(place))], names=["path", "images", "places"])

    return files.select("path", "content").mapInArrow(run, "path string, images map<string,binary>, places array<struct<chapter:int,place:int,name:string>>")


def parsed_epubs(files: DataFrame) -> DataFrame:
    """One row per EPUB: its segments, resources, fragment ids and entries of its tables of contents."""

    def one(path: str, data: bytes) -> dict:
        book = epub.read(data)
        ranks: dict[str, int] = {}
        resources = book["resources"]
        return {
            "path": path,
            "title": book["title"] or posixpath.splitext(posixpath.basename(path))[0],
            "segments": [{"pos": r["start"] + k, "resource": r["index"], "href": r["href"]} | {f: s[f] for f in ("kind", "anchor", "source")} for r in resources for k, s in enumerate(r["segments"])],
            "resources": [{"href": r["href"], "pos": r["start"], "size": len(r["segments"])} for r in resources],
            "fragments": [{"href": r["href"], "fragment": f, "pos": r["start"] + k} for r in resources for f, k in r["ids"].items()],
            "entries": [{"toc_rank": ranks.setdefault(e["toc_path"], len(ranks))} | e for e in book["toc"]],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, whole = pa.string(), pa.int32()
        segment = pa.struct([("pos", whole), ("resource", whole), ("href", text), ("kind", text), ("anchor", text), ("source", text)])
        entry = pa.struct([(n, {"int": whole, "string": text, "boolean": pa.bool_()}[t]) for n, t in (x.split(":") for x in _ENTRY.split(","))])
        schema = pa.schema([("path", text), ("title", text), ("segments", pa.list_(segment)), ("resources", pa.list_(pa.struct([("href", text), ("pos", whole), ("size", whole)]))), ("fragments", pa.list_(pa.struct([("href", text), ("fragment", text), ("pos", whole)]))), ("entries", pa.list_(entry))])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([one(path, data)], schema)

    return files.select("path", "content").mapInArrow(run, EPUB)


def resource_list(lists: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., index, href) of the resources that a JSON list of {href, index} names.

    What is no object, or whose href is no text, empty or named before, is left out; an index that is no whole
    number is the place in the list. What is no list has none."""
    each = lists.select(*key, F.posexplode(F.from_json(value, "array<string>")).alias("_k", "_x")).withColumn("_v", F.try_parse_json("_x"))
    field = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    typed = lambda name, kind, cast: F.when(F.schema_of_variant(field(name)) == kind, F.try_variant_get("_v", f"$.{name}", cast))
    read = each.select(*key, "_k", typed("href", "STRING", "string").alias("href"), F.coalesce(typed("index", "BIGINT", "long"), F.col("_k")).alias("index")).where("href <> ''")
    return read.groupBy(*key, "href").agg(F.min_by("index", "_k").alias("index"))


def epub_chapters(books: DataFrame, split: str = "top-level-toc") -> DataFrame:
    """Segments of parsed EPUBs in the chapters of their tables of contents.

    Entries are located at the start of their resource or at their fragment; groups without a link take the
    place of their first located descendant. The boundaries are the entries that ``split`` chooses (see
    ``toc.STRATEGIES``), as a rule those of the top level, of the first table that has any; what stands before the first is a chapter of its own. A book without a boundary has one
    chapter per resource."""
    part = lambda name: books.select("path", F.explode(name).alias("_x")).select("path", "_x.*")
    here = F.struct("path", "href")
    resources, fragments = part("resources").withColumn("href", here), part("fragments").withColumn("href", here)
    entries = toc.locate(part("entries").withColumn("href", here), resources, fragments)
    ends = resources.select(F.col("href").alias("_h"), (F.col("pos") + F.col("size")).alias("_end"))
    entries = entries.join(ends, F.col("href") == F.col("_h"), "left").withColumns({"anchored": F.coalesce(F.col("pos") < F.col("_end"), F.lit(False)), "_toc": F.struct("path", "toc_rank"), "_own": F.col("pos")})
    linked = F.length(F.coalesce("raw_href", F.lit(""))) > 0
    entries = toc.inherit(entries, "_toc").withColumn("pos", F.when(linked, F.col("_own")).otherwise(F.col("pos"))).withColumn("seq", F.col("node"))
    found = toc.strategy(split)(entries, "_toc").withColumn("_first", F.min("toc_rank").over(Window.partitionBy("path"))).where("toc_rank = _first")
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    marks = found.select("path", "pos", F.col("title").alias("_title"), "toc_path", F.col("node").alias("toc_node"), F.coalesce("raw_href", F.lit("")).alias("toc_href"), number.alias("_n"))
    flat = books.select("path", "title", F.explode("segments").alias("_s")).select("path", "title", "_s.*")
    placed = flat.join(toc.assign(flat, marks.select("path", "pos"), "path"), ["path", "pos"])
    named = placed.join(marks.select("path", F.col("_n").alias("chapter"), "_title", "toc_path", "toc_node", "toc_href"), ["path", "chapter"], "left")
    # Without a boundary the resources are the chapters.
    group = F.when(F.max("chapter").over(Window.partitionBy("path")) > 0, F.col("chapter")).otherwise(F.col("resource"))
    dense = named.withColumn("_bounded", F.max("chapter").over(Window.partitionBy("path")) > 0).withColumn("chapter", F.dense_rank().over(Window.partitionBy("path").orderBy(group)) - 1)
    whole = Window.partitionBy("path", "chapter").orderBy("pos")
    head = F.when(F.col("kind") == "heading", F.col("source"))
    own = F.coalesce(F.when(F.col("_bounded"), F.first(head).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(F.first(head, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), F.lit(""))
    return dense.select(
        "path", F.lit("epub").alias("fmt"), "title", F.col("chapter").cast("int"), F.coalesce("_title", own).alias("chapter_title"), (F.row_number().over(whole) - 1).cast("int").alias("seg"),
        "kind", F.lit(None).cast("int").alias("level"), "anchor", "source", "href", "toc_path", "toc_node", "toc_href",
    )


def read_files(files: DataFrame, split: str = "top-level-toc") -> DataFrame:
    """All segments of book files (path, fmt, content); those that ``left_out`` names are not read.

    An EPUB is parsed once, its parsed rows are kept on disk while they are joined."""
    epubs = parsed_epubs(files.where("fmt = 'epub'")).persist(StorageLevel.DISK_ONLY)
    parts = [text_books(files.where("fmt = 'text'")), markup_books(files.where("fmt in ('html', 'fb2', 'pdf') and content is not null")), epub_chapters(epubs, split)]
    return parts[0].select(COLUMNS).unionByName(parts[1].select(COLUMNS)).unionByName(parts[2].select(COLUMNS))


def read_books(spark: SparkSession, path: str, split: str = "top-level-toc") -> DataFrame:
    """All segments of the book files below a path or glob."""
    return read_files(book_files(spark, path), split)
