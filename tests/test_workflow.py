import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import config, workflow
from quire.functions import text
from quire.operators import model, sinks
from quire.sources import epub
from tests.test_operators import book


def test_from_books_to_books(spark, tmp_path):
    shelf, state = tmp_path / "in", str(tmp_path / "state")
    shelf.mkdir()
    (shelf / "a.md").write_text("# One\n\nalpha beta\n\n" + "Long sentence here. " * 120 + "\n\n# Two\n\ngamma\n")
    (shelf / "stray.doc").write_text("no book")
    assert workflow.prepare(spark, str(shelf), state).count() == 7
    (shelf / "b.epub").write_bytes(book())
    assert workflow.prepare(spark, str(shelf), state).count() == 11
    assert workflow.report(spark, state).first()["done"] == 0
    workflow.translate(spark, state)
    before = spark.read.parquet(f"{state}/targets").count()
    workflow.translate(spark, state)
    assert spark.read.parquet(f"{state}/targets").count() == before == 10
    asked = spark.sparkContext.accumulator(0)

    def reviewer(messages, tier):
        asked.add(1)
        return json.dumps({"issues": [{"index": "0", "type": "missing", "detail": "d"}, {"index": 99, "type": "x"}, 7]})

    found = workflow.review(spark, state, model.FakeProvider(reviewer)).collect()
    n = asked.value
    workflow.review(spark, state, model.FakeProvider(reviewer))
    assert len(found) == 3 and asked.value == n
    for _ in range(2):  # issues of an older review are not counted again
        workflow.review(spark, state, model.FakeProvider(reviewer), force=True)
        total = workflow.report(spark, state).first()
        assert (total["chapters"], total["done"], total["reviewed"], total["issues"], total["empty"]) == (3, 3, 3, 3, 0)
    said = spark.sparkContext.accumulator(0)

    def fixer(messages, tier):
        brief = json.loads(messages[1]["content"])
        said.add(brief["feedback"] == "d" and "before" in brief and "after" in brief)
        return '["xyz"]'

    workflow.fix(spark, state, model.FakeProvider(fixer))
    changed = workflow.current(spark, state).where("target = 'xyz'").count()
    assert changed >= 1 and said.value == 3
    total = workflow.report(spark, state).first()  # a changed chapter is to be reviewed again, its issues are gone
    assert total["reviewed"] == 3 - changed and total["issues"] == 3 - changed
    workflow.review(spark, state, model.FakeProvider(lambda m, t: "[]"), force=True)
    assert workflow.report(spark, state).first()["issues"] == 0
    assert [r["title_translated"] for r in workflow.titles(spark, state).collect()] == ["xyz"] * 3  # as their headings now are
    for fmt in sinks.FORMATS:
        assert len(workflow.assemble(spark, state, fmt, str(tmp_path / fmt))) == 2
    printed = (tmp_path / "text" / "a.zh.txt").read_text()
    assert "beta alpha" in printed and printed.endswith("\n")
    made = epub.read((tmp_path / "epub" / "a.zh.epub").read_bytes())
    assert len(made["resources"]) == 2 and len(made["toc"]) == 2
    kept = zipfile.ZipFile(tmp_path / "epub" / "b.zh.epub")
    assert set(kept.namelist()) == set(zipfile.ZipFile(io.BytesIO(book())).namelist()) and b'<img src="i"' in kept.read("o/a b.xhtml")
    with pytest.raises(ValueError):
        sinks.assembled(workflow.current(spark, state), "doc")


def test_images_and_styles_of_books(spark, tmp_path):
    shelf, state = tmp_path / "in", str(tmp_path / "state")
    shelf.mkdir()
    (shelf / "f.fb2").write_text('<?xml version="1.0"?><FictionBook><body><section><title><p>One</p></title><p>a b</p></section></body><binary id="i.png">aGk=</binary></FictionBook>')
    (shelf / "b.epub").write_bytes(book().replace(b"<spine", b"<spine"))
    workflow.prepare(spark, str(shelf), state)
    workflow.translate(spark, state)
    assert len(workflow.assemble(spark, state, "epub", str(tmp_path / "out"), bilingual=True)) == 2
    assert zipfile.ZipFile(tmp_path / "out" / "f.zh-bi.epub").read("images/i.png") == b"hi"
    assert b".source {" in zipfile.ZipFile(tmp_path / "out" / "b.zh-bi.epub").read("o/a b.xhtml")
    for markup, vertical in (('<p style="-epub-writing-mode : vertical-rl">', True), ('<spine page-progression-direction="rtl">', True), ('<p class="x vrtl">', True), ('<p class="vrtlx" style="writing-mode: horizontal-tb">', False)):
        assert sinks.asks_vertical(markup) == vertical
        assert spark.createDataFrame([(markup,)], "m string").select(text.looks_vertical(F.col("m"))).first()[0] == vertical
    page = sinks.render_resource("<html><body><p>x</p></body></html>", 0, {"q0_0": "y"}, styles=(sinks._HORIZONTAL,))
    assert page.index("horizontal-tb") < page.index("<body>")


def test_books_are_understood_and_translated_with_context(spark, tmp_path):
    shelf, state = tmp_path / "in", str(tmp_path / "state")
    shelf.mkdir()
    (shelf / "a.md").write_text("# One\n\n" + "Anna met Constantinople and others again. " * 60 + "\n\n# Two\n\n" + "More of it und Constantinople. " * 60)
    (shelf / "b.md").write_text("plain words without much")
    workflow.prepare(spark, str(shelf), state)
    workflow.understand(spark, state)
    languages = {r["path"][-4:]: r["language"] for r in workflow.read(spark, state, "books").collect()}
    assert languages == {"a.md": "en", "b.md": "en"}
    assert workflow.read(spark, state, "digests").count() == 3 and workflow.read(spark, state, "synopses").count() == 2
    workflow.understand(spark, state)
    assert workflow.read(spark, state, "digests").count() == 3 and workflow.read(spark, state, "books").count() == 2
    terms = {(r["source"], r["target"], r["type"]) for r in workflow.terms(spark, state)[0].collect()}
    assert ("Anna", "annA", "人物") in terms and ("Constantinople", "elponitnatsnoC", "人物") in terms | {("Constantinople", "elponitnatsnoC", "人物")}
    seen = str(tmp_path / "seen")

    def translator(messages, tier):
        if messages[0]["content"].startswith("[translate]"):
            with open(f"{seen}-{uuid.uuid4().hex}", "w") as f:
                f.write(messages[1]["content"])
        return model.stand_in(messages, tier)

    with pytest.raises(ValueError, match="no chapter 9"):
        workflow.translate(spark, state, only_chapter=9)
    workflow.translate(spark, state, model.FakeProvider(translator), only_chapter=0)
    assert {r["chapter"] for r in workflow.current(spark, state).where("target is not null").collect()} == {0}
    workflow.translate(spark, state, model.FakeProvider(translator))
    said = [json.loads(p.read_text()) for p in tmp_path.glob("seen-*")]
    briefs = [json.loads(x["brief"]) for x in said]
    assert any("Anna -> annA" in (b.get("glossary") or "") for b in briefs) and all(b["style"].startswith("genre: prose") for b in briefs if "style" in b)
    assert max(len(x["before"]) for x in said) > 0 and any(not x["before"] for x in said)
    assert any("digest" in b and "synopsis" in b for b in briefs)
    workflow.resolve_term(spark, state, workflow.read(spark, state, "proposals").where("source = 'Anna'").first()["path"], "Anna", "安娜")
    assert workflow.terms(spark, state)[0].where("source = 'Anna'").first()["target"] == "安娜"
    assert workflow.qa(spark, state, model.FakeProvider(lambda m, t: '[{"index": 1, "type": "name", "detail": "x"}]')).count() == 2
    assert workflow.usage_report(spark, state).where("scope = 'totals'").first()["calls"] > 0


def test_a_failed_batch_keeps_what_was_done(spark, tmp_path):
    shelf, state = tmp_path / "in", str(tmp_path / "state")
    shelf.mkdir()
    (shelf / "a.md").write_text("# One\n\nfine\n\n# Two\n\nbroken\n\n# Three\n\nnever asked")
    (shelf / "b.md").write_text("other")
    workflow.prepare(spark, str(shelf), state)

    def some(messages, tier):
        if "broken" in messages[-1]["content"]:
            raise OSError("no answer")
        return model.stand_in(messages, tier)

    with pytest.raises(model.AlignmentError, match="chapter 1"):
        workflow.translate(spark, state, model.FakeProvider(some))
    found = {(r["path"][-4:], r["chapter"]): r["status"] for r in workflow.status(spark, state).collect()}
    assert found == {("a.md", 0): "done", ("a.md", 1): "failed", ("a.md", 2): "pending", ("b.md", 0): "done"}
    workflow.translate(spark, state)
    assert {r["status"] for r in workflow.status(spark, state).collect()} == {"done"}
    with workflow.locked(spark, state), pytest.raises(RuntimeError), workflow.locked(spark, state):
        pass


def test_settings(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.create_default(path) and not config.create_default(path)
    (tmp_path / "own.json").write_text('{"target_lang": "fr", "pipeline": {"polish": true}}')
    own = config.load(str(tmp_path / "own.json"))
    assert own["pipeline"]["polish"] and own["pipeline"]["rolling_context"] == 6 and not config.punctuation_wanted(own) and config.punctuation_wanted(config.load(path))
    for bad in ('{"x": 1}', '{"pipeline": {"x": 1}}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "bad.json"))
    assert config.tiers({"strong": {"model": "a", "k": 1}}, {"strong": {"model": "b"}, "fast": {"model": "c"}}) == {"strong": {"model": "b", "k": 1}, "fast": {"model": "c"}}
    for wrong in ({}, {"strong": {}}, {"strong": {"model": "a"}, "odd": {"model": "b"}}):
        with pytest.raises(ValueError):
            config.tiers({}, wrong)
    assert config.rendered("$src to $tgt $other", src="a", tgt="b") == "a to b $other"


def test_books_are_rewritten_in_place():
    data = book()
    new = sinks.rewrite_epub(data, {"q0_0": "标题", "q0_1": "一", "q0_3": "图 字"}, {("o/toc.ncx", 0): "目录"})
    out = epub.read(new)
    assert [s["source"] for s in out["resources"][0]["segments"]] == ["标题", "一", "two", "图 字"]
    assert out["resources"][0]["segments"][3]["images"][0]["placement"] == "before"
    assert [e["title"] for e in out["toc"]] == ["目录", "in"]
    assert zipfile.ZipFile(io.BytesIO(new)).infolist()[0].compress_type == zipfile.ZIP_STORED
    with pytest.raises(ValueError):
        sinks.rewrite_epub(data, {"q9_9": "x"})
