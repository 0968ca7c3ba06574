import io
import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import folds, glossary, model, segments, toc
from quire.sources import books, epub, event_log, fb2, html
from quire.streaming import events as streaming


def test_an_oversize_item_is_a_batch_of_its_own(spark):
    df = spark.createDataFrame([("d", k, "x" * n) for k, n in enumerate((3, 3, 9, 2, 2, 5))], "doc string, k int, t string")
    out = folds.pack(df, ["doc"], ["k"], F.col("t"), lambda x: F.length(x), 6).orderBy("batch").collect()
    assert [[len(t) for t in r["items"]] for r in out] == [[3, 3], [9], [2, 2], [5]]
    assert [r["start"] for r in out] == [0, 2, 3, 5]


def test_chapters_and_segments(spark):
    text = "pre\n\n# One\n\na\nb\n\n\nc\n## Two\n"
    df = spark.createDataFrame([("d", text)], "doc string, text string")
    out = segments.text_segments(segments.chapters(df, "doc", "text", F.lit("stem")), "doc").orderBy("chapter", "seg").collect()
    assert [(r["chapter"], r["kind"], r["source"]) for r in out] == [(0, "text", "pre"), (1, "heading", "One"), (1, "text", "a\nb"), (1, "text", "c"), (2, "heading", "Two")]


def test_upsert_keeps_the_first_target_and_logs_each_conflict(spark):
    schema = "source string, target string, reading string, gender string, note string, type string, aliases array<string>, chapter int, seq int"
    rows = [("s", "A", "", "", "", "t", ["z"], 1, 1), ("s", "B", "r", "", "", "t", ["q"], 2, 2), ("s", "A", "rr", "", "", "u", ["a"], 3, 3), ("s", "B", "", "", "", "t", [], 4, 4)]
    terms, conflicts = glossary.upsert(spark.createDataFrame(rows, schema))
    t = terms.first()
    assert (t["target"], t["type"], t["reading"], t["aliases"], t["first_chapter"], t["status"]) == ("A", "t", "rr", ["a", "z"], 1, "conflict")
    assert [r["seq"] for r in conflicts.orderBy("seq").collect()] == [2, 4]


def test_terms_in_blocks(spark, monkeypatch):
    terms = spark.createDataFrame([("he", [], "术语"), ("she", ["hers"], "术语"), ("x", ["his"], "敬称")], "source string, aliases array<string>, type string")
    texts = spark.createDataFrame([(1, "USHERS"), (2, "this"), (3, "")], "id int, text string")
    whole = {tuple(r) for r in glossary.terms_in_texts(terms, texts, ["id"]).collect()}
    monkeypatch.setattr(glossary, "BLOCK", 2)
    assert whole == {tuple(r) for r in glossary.terms_in_texts(terms, texts, ["id"]).collect()} == {(1, "he"), (1, "she")}
    assert glossary.terms_in_texts(terms.limit(0), texts, ["id"]).count() == 0


def test_splitting_takes_linear_time(spark):
    df = spark.createDataFrame([("ab cd " * 300_000,), ("x" * 100_000,), ("One. " * 100_000,)], "t string")
    out = [r["p"] for r in df.select(segments.split_text(F.col("t"), 1200).alias("p")).collect()]
    assert ["".join(p) for p in out] == [r["t"] for r in df.collect()]
    assert all(len(x) <= 1200 for p in out for x in p) and len(out[2]) == 417

    def pieces(text):
        while len(text) > 1200:
            cut = next((k for mark in " \t\n" if (k := text.rfind(mark, 0, 1201)) > 0), 1200)
            yield text[:cut]
            text = text[cut:]
        yield text

    assert out[:2] == [list(pieces(r["t"])) for r in df.collect()[:2]]


def test_inherit_needs_a_descendant(spark):
    # 0 > (1 > (2, 3 located)), 4 > (5), 6 located, 7 > (8 > 9 located)
    rows = [("d", 0, None, None), ("d", 1, 0, None), ("d", 2, 1, None), ("d", 3, 1, 30), ("d", 4, None, None), ("d", 5, 4, None), ("d", 6, None, 60), ("d", 7, None, None), ("d", 8, 7, None), ("d", 9, 8, 90), ("d", 10, 7, 100), ("e", 0, None, None)]
    out = {(r["doc"], r["node"]): r["pos"] for r in toc.inherit(spark.createDataFrame(rows, "doc string, node long, parent long, pos long"), "doc").collect()}
    assert out == {("d", 0): 30, ("d", 1): 30, ("d", 2): None, ("d", 3): 30, ("d", 4): None, ("d", 5): None, ("d", 6): 60, ("d", 7): 90, ("d", 8): 90, ("d", 9): 90, ("d", 10): 100, ("e", 0): None}


def test_alignment_retries_then_goes_one_by_one():
    calls = []

    def half(messages, tier):
        texts = json.loads(messages[-1]["content"])
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("a call that fails is an attempt")
        return json.dumps([t.upper() for t in (texts if len(texts) == 1 else texts[:1])])

    found, n = model.translate_aligned(["a", "b"], model.FakeProvider(half), retries=1)
    assert (found, n, calls) == (["A", "B"], 4, [2, 2, 1, 1])
    calls = []
    with pytest.raises(model.AlignmentError):
        model.translate_aligned(["a"], model.FakeProvider(lambda m, t: calls.append(1) or "no"), retries=0)
    assert len(calls) == 2  # the batch, then the one text once
    with pytest.raises(ValueError):
        model.provider("nobody")


def test_retries_with_growing_delays():
    waited, left = [], [3]

    def flaky(messages, tier):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "ok"

    client = model.RetryingProvider(model.FakeProvider(flaky), 4, 10.0, 30.0, waited.append)
    assert client.complete([], "strong") == "ok" and waited == [10.0, 20.0, 30.0]
    left[0] = 9
    with pytest.raises(OSError):
        client.complete([], "strong")


def test_html_chapters():
    page = "<body>front<p>x</p><h1>A</h1> <h2>B</h2><blockquote><p>in</p> q</blockquote><ul><li>l1<li>l2</ul><h1>C</h1></body>"
    out = html.chapters(page)
    assert [c["title"] for c in out] == ["", "A / B", "C"]
    assert out[1]["segments"] == [("heading", "A"), ("heading", "B"), ("text", "in q"), ("text", "l1"), ("text", "l2")]


def book() -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><metadata><title>T</title></metadata><manifest><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"><itemref idref="a"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a b.xhtml", '<html><body><h1 id="x">H</h1><div><p>one<br/>two</p><p><img src="i"/>pic <ruby>字<rt>r</rt></ruby></p></div></body></html>')
        z.writestr("o/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>H</text></navLabel><content src="a%20b.xhtml#x"/><navPoint><navLabel><text>in</text></navLabel><content src="http://e.x/y"/></navPoint></navPoint></navMap></ncx>')
    return data.getvalue()


def test_epub():
    out = epub.read(book())
    assert out["title"] == "T" and len(out["resources"]) == 1
    assert [s["source"] for s in out["resources"][0]["segments"]] == ["H", "one", "two", "pic 字"]
    assert out["resources"][0]["segments"][3]["images"] == [{"tag": "img", "offset": 0, "placement": "before"}]
    assert [(e["depth"], e["href"], e["fragment"], e["external"]) for e in out["toc"]] == [(0, "o/a b.xhtml", "x", False), (1, "http://e.x/y", "", True)]
    assert epub.resolve("o/t/n.xhtml", "../a+b.xhtml#f%20g") == ("o/a+b.xhtml", "f g", False)


def test_fb2():
    xml = '<?xml version="1.0"?><FictionBook><body><title><p>Book</p></title><section><title><p>One</p></title><p>a</p><section><p>b</p></section></section></body><body name="notes"><section><p>n</p></section></body><binary id="i">aGk=</binary><binary id="bad">*</binary></FictionBook>'
    out = fb2.chapters(xml.encode())
    assert [(c["title"], c["segments"]) for c in out] == [("Book", [("heading", "Book")]), ("One", [("heading", "One"), ("text", "a")]), ("", [("text", "b")])]
    assert fb2.binaries(xml.encode()) == {"i": b"hi"}


def test_books_of_all_formats(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.md").write_text("# X\n\npara")
    (tmp_path / "c.html").write_text("<body><h1>Q</h1><p>r</p></body>")
    (tmp_path / "d.txt").write_text("\ufeff第二章 名前\n\n本文\n\n## 小見出し\n\nx")
    (tmp_path / "e.doc").write_text("left out")
    (tmp_path / "g.txt").write_bytes(b"not \xff UTF-8")
    out = books.read_books(spark, str(tmp_path)).collect()
    assert Counter(r["fmt"] for r in out) == {"epub": 4, "text": 7, "html": 2} and "not \ufffd UTF-8" in {r["source"] for r in out}
    text = sorted((r["chapter"], r["seg"], r["chapter_title"], r["kind"], r["level"], r["source"]) for r in out if r["path"].endswith("d.txt"))
    assert text == [(0, 0, "第二章 名前", "heading", 1, "第二章 名前"), (0, 1, "第二章 名前", "text", None, "本文"), (1, 0, "小見出し", "heading", 2, "小見出し"), (1, 1, "小見出し", "text", None, "x")]
    with pytest.raises(ValueError):
        books.format_of("x.doc")


def shelf_book(toc: str, pages: dict[str, str], nav: str = "") -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in pages) + ('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else "")
        refs = "".join(f'<itemref idref="{n}"/>' for n in pages)
        z.writestr("p.opf", f'<package><metadata><title>T</title></metadata><manifest>{items}<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n">{refs}</spine></package>')
        for n, body in pages.items():
            z.writestr(f"{n}.xhtml", f"<html><body>{body}</body></html>")
        z.writestr("toc.ncx", f"<ncx><navMap>{toc}</navMap></ncx>")
        if nav:
            z.writestr("nav.xhtml", f'<html><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
    return data.getvalue()


def point(title: str, src: str = "", inner: str = "") -> str:
    return f"<navPoint><navLabel><text>{title}</text></navLabel>{f'<content src="{src}"/>' if src else ''}{inner}</navPoint>"


def test_epub_chapters_follow_the_contents(spark, tmp_path):
    pages = {"a": "<p>front</p><h1 id='one'>One</h1><p>1a</p>", "b": "<p>1b</p><a id='mid'></a><h1>Two</h1><p>2a</p><span id='end'></span>", "c": "<p>3a</p><p id='late'>3b</p>"}
    cases = {
        # across files, nested entries do not cut, a broken fragment is passed over, an id between blocks counts
        "x": (point("One", "a.xhtml#one", point("in", "b.xhtml")) + point("gone", "b.xhtml#no") + point("Two", "b.xhtml#mid") + point("Out", "http://e.x/"), "", [("front", ""), ("One", "One"), ("1a", "One"), ("1b", "One"), ("Two", "Two"), ("2a", "Two"), ("3a", "Two"), ("3b", "Two")]),
        # a group without a link stands where its first located descendant does; an id after the last block is the next file
        "y": (point("Part", "", point("One", "a.xhtml#one")) + point("End", "b.xhtml#end"), "", [("front", ""), ("One", "Part"), ("1a", "Part"), ("1b", "Part"), ("Two", "Part"), ("2a", "Part"), ("3a", "End"), ("3b", "End")]),
        # the navigation document goes before the NCX; of two entries at one place the anchored first one counts
        "z": (point("no", "a.xhtml"), '<li><a href="a.xhtml">Start</a></li><li><a href="c.xhtml#late">Late</a></li><li><a href="c.xhtml#late">Again</a></li>', [("front", "Start"), ("One", "Start"), ("1a", "Start"), ("1b", "Start"), ("Two", "Start"), ("2a", "Start"), ("3a", "Start"), ("3b", "Late")]),
        # without a boundary the files are the chapters
        "w": (point("gone", "b.xhtml#no"), "", [("front", "One"), ("One", "One"), ("1a", "One"), ("1b", "Two"), ("Two", "Two"), ("2a", "Two"), ("3a", ""), ("3b", "")]),
    }
    for name, (ncx, nav, _) in cases.items():
        (tmp_path / f"{name}.epub").write_bytes(shelf_book(ncx, pages, nav))
    out = books.read_books(spark, str(tmp_path)).collect()
    for name, (_, _, want) in cases.items():
        rows = sorted((r["chapter"], r["seg"], r["source"], r["chapter_title"]) for r in out if r["path"].endswith(f"{name}.epub"))
        assert [r[2:] for r in rows] == want, name
        assert [r[1] for r in rows] == [k for c in sorted({r[0] for r in rows}) for k in range(sum(r[0] == c for r in rows))]


def test_event_log_round_trip(spark, tmp_path):
    event_log.append(spark.createDataFrame([("batch", 1, "0:3")], "event string, chapter int, key string"), str(tmp_path / "log"))
    (tmp_path / "log" / "more.txt").write_text("{broken\n[1]\n")
    assert [tuple(r) for r in event_log.completed_keys(event_log.read(spark, str(tmp_path / "log")), "batch").collect()] == [(1, "0:3")]


def test_streams(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "z", 3), ("a", "x", 4)]
    spark.createDataFrame(rows, "source string, target string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, target string, seq long").parquet(str(tmp_path / "in"))
    query = streaming.glossary(stream).writeStream.format("memory").queryName("outcomes").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    found = spark.sql("SELECT source, outcome, count(*) AS n FROM outcomes GROUP BY ALL").collect()
    assert {(r["source"], r["outcome"]): r["n"] for r in found} == {("a", "inserted"): 1, ("a", "conflict"): 1, ("a", "unchanged"): 1, ("b", "inserted"): 1}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 3.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("timestamp(ts) AS ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = streaming.counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    # The last hour stays open until the watermark has passed its end.
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM windows").collect()] == [("a", 2, 3.0)]
