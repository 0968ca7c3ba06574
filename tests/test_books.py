"""Books that are told apart, kept as templates and translated with a glossary that grows."""

import json
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import config, workflow
from quire.operators import agents, extraction, glossary, model, sinks, status
from quire.sources import epub, fb2, html

TERMS = "path string, source string, target string, reading string, type string, gender string, note string, aliases array<string>"


def shelf_of(tmp_path, files):
    shelf = tmp_path / "in"
    for name, text in files.items():
        (shelf / name).parent.mkdir(parents=True, exist_ok=True)
        (shelf / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(shelf / "*") if any("/" in n for n in files) else str(shelf), str(tmp_path / "state")


def test_books_of_one_stem_stay_apart(spark, tmp_path):
    shelf, state = shelf_of(tmp_path, {"x/a.md": "first", "y/a.md": "second", "y/b.md": "third", "x/A.md": "fourth"})
    workflow.prepare(spark, shelf, state)
    for fmt in sinks.FORMATS:
        out = tmp_path / fmt
        saved = workflow.assemble(spark, state, fmt, str(out))
        assert len(saved) == len(set(saved)) == 4 and any(p.endswith(f"/b.zh{sinks.FORMATS[fmt]}") for p in saved)
    texts = sorted(p.read_text() for p in (tmp_path / "text").iterdir())
    assert texts == ["first\n", "fourth\n", "second\n", "third\n"]


def test_terms_stay_in_their_books(spark):
    terms = spark.createDataFrame([("A", "Robert", "R1", "", "术语", "", "", ["Bob"]), ("B", "Robert", "R2", "", "术语", "", "", []), ("B", "Ann", "A2", "", "敬称", "", "", ["Annie"])], TERMS)
    texts = spark.createDataFrame([("A", 1, "Bob and Ann"), ("B", 1, "BOB and Annie, ann"), ("B", 2, "Ｒobert"), ("C", 1, "Robert"), ("B", 3, None)], "path string, seg int, text string")
    found = {tuple(r) for r in glossary.terms_in_texts(terms, texts, ["path", "seg"], book=("path",)).collect()}
    assert found == {("A", 1, "Robert"), ("B", 1, "Ann"), ("B", 2, "Robert")}
    named = {(r["path"], r["seg"], r["target"]) for r in glossary.chapter_terms(spark.createDataFrame(sorted(found), "path string, seg int, source string"), terms, ["path", "seg"], ("path",)).collect()}
    assert named == {("A", 1, "R1"), ("B", 1, "A2"), ("B", 2, "R2")}


def test_blocks_and_chunks_find_the_same(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    terms = [(f"s{k % 50}{word()}", "t", "", "术语", "", "", [word(), word()]) for k in range(120)]
    terms = [t for i, t in enumerate(terms) if t[0] not in {x[0] for x in terms[:i]}]
    texts = [(k, " ".join(word() for _ in range(6))) for k in range(90)]
    a = spark.createDataFrame(terms, TERMS.removeprefix("path string, "))
    b = spark.createDataFrame(texts, "id int, text string")
    want = {(k, t[0]) for k, text in texts for t in terms if any(n in text for n in [t[0], *t[6]])}
    for block, chunk in ((50_000, 2000), (7, 10)):
        monkeypatch.setattr(glossary, "BLOCK", block)
        monkeypatch.setattr(glossary, "CHUNK", chunk)
        assert {tuple(x) for x in glossary.terms_in_texts(a, b, ["id"]).collect()} == want


def test_markup_of_any_depth():
    n = 100_000
    deep = "<div>" * n + "<p>hello <b>x</b></p>" + "</div>" * n
    assert html.chapters("<h1>t</h1>" + deep) == [{"title": "t", "segments": [("heading", "t"), ("text", "hello x")]}]
    assert [s["source"] for s in epub.resource_segments(deep, 0)] == ["hello x"]
    assert sinks.serialize(html.parse(deep)) == deep
    assert epub.resource_segments("<div>" * n, 0) == [] and len(html.chapters("<p><i>" * n + "z")[0]["segments"]) == 1
    assert len(epub.nav_entries("<nav><ol>" + "<li><a href='x'>a</a><ol>" * n, "n")) == n
    # An item's label is its direct link; a link further down is not.
    assert [e["title"] for e in epub.nav_entries("<nav><ol><li><p><a href='x'>no</a></p><span>group</span><ol><li><a href='y'>yes</a></li></ol></li></ol></nav>", "n")] == ["group", "yes"]


NCX = b"""<?xml version="1.0"?><n:ncx xmlns:n="http://www.daisy.org/z3986/2005/ncx/"><n:docTitle><n:text>T</n:text></n:docTitle><n:navMap>
<n:navPoint id="a"><n:navLabel><n:text>One</n:text></n:navLabel><n:content src="a.xhtml"/>
 <n:navPoint id="b"><n:content src="a.xhtml#s"/><n:navLabel ><n:text class='a>b' >Two &amp; more</n:text></n:navLabel></n:navPoint></n:navPoint>
<n:navPoint id="c"><n:navLabel><n:text/></n:navLabel><n:content src="c.xhtml"/></n:navPoint></n:navMap></n:ncx>"""


def test_contents_are_relabelled_where_their_links_are_the_same():
    new = sinks.relabel(NCX, {0: ("目 <录>", "a.xhtml"), 1: ("x", "other.xhtml"), 2: ("y", "c.xhtml")}, ncx=True)
    assert new == NCX.replace(b">One<", "目 &lt;录&gt;".encode("ascii", "xmlcharrefreplace").join([b">", b"<"]))
    assert sinks.relabel(NCX, {1: ("zwei", None)}, ncx=True) == NCX.replace(b"Two &amp; more", b"zwei")
    assert [e["title"] for e in epub.ncx_entries(sinks.relabel(NCX, {}, True, {"a.xhtml": "named"}), "n")] == ["named", "named", ""]
    assert sinks.relabel(b"<broken", {0: ("x", None)}, ncx=True) == b"<broken"
    nav = b"<html><body><nav epub:type='toc'><OL><li><a  href='p.xhtml'>A <b>b</b></a><ol><li><span>S</span></li></ol></li></OL></nav><p>A b</p></body></html>"
    assert sinks.relabel(nav, {0: ("neu", "p.xhtml"), 1: ("s", "gone")}, ncx=False) == nav.replace(b"A <b>b</b></a>", b"neu</a>")
    assert sinks.relabel(nav, {1: ("s", "")}, ncx=False) == nav.replace(b">S<", b">s<")


PAGE = "<!DOCTYPE html>\n<HTML><head><title>x</title ></head><body class=a><h1 id='t'>Head</h1>\n<!-- note --><p CLASS='c d'>One <i>two</i><img src=i.png></p><ul><li>item</ul><blockquote>q</blockquote>\n<p>same</p> tail</body></HTML>"


def test_pages_are_their_own_templates():
    targets = {"q0_0": "Kopf", "q0_1": "Eins & zwei", "q0_2": "Punkt", "q0_3": "Z", "q0_4": "same"}
    assert [a for a, _, _ in html.anchored_blocks(PAGE)] == list(targets)
    one = sinks.render_template(PAGE, targets)
    want = PAGE.replace(">Head<", ">Kopf<").replace("One <i>two</i><img src=i.png>", 'Eins &amp; zwei<img src="i.png"/>').replace("<li>item", "<li>Punkt").replace(">q<", ">Z<")
    assert one == want
    assert sinks.render_template(PAGE, {}) == PAGE
    first, last = (sinks.render_template(PAGE, targets, True, order) for order in sinks.ORDERS)
    assert "Eins &amp; zwei<img src=\"i.png\"/></p><p class=\"source\">One two</p><ul><li>Punkt<div class=\"source\">item</div></ul>" in first
    assert "<p class=\"source\">One two</p><p CLASS='c d'>Eins" in last and '<li><div class="source">item</div>Punkt</ul>' in last
    assert "Kopf</h1>\n<!-- note -->" in first and first.count("same") == 1 and first.count(".source {") == 1
    kept = sinks.render_template(PAGE, targets, True, keep_style=True)
    assert '<p class="c d source">One two</p>' in kept and ".source {" not in kept
    data = PAGE.replace("<title>", "<meta charset=latin-1><title>é").encode("latin-1")
    assert sinks.rewrite_page(data, {"q0_0": "中é"}) == data.replace(b">Head<", "&#20013;é".encode("latin-1").join([b">", b"<"]))


def test_images_stand_where_they_stood(spark, tmp_path):
    body = "<title><p>One</p></title><image l:href='#a.png'/><p>x<image l:href='#in.png'/></p><epigraph><p>y</p><image l:href='#b.png'/></epigraph><p>z</p><image l:href='#c d.png'/><image l:href='#gone.png'/>"
    text = f"<FictionBook xmlns:l='x'><body><section>{body}</section><section><image l:href='#a.png'/></section></body>" + "".join(f"<binary id='{n}'>aGk=</binary>" for n in ("a.png", "in.png", "b.png", "c d.png", "cover.jpg")) + "</FictionBook>"
    (chapter,) = fb2.chapters(text.encode())
    assert chapter["images"] == [(1, "a.png"), (1, "in.png"), (3, "b.png"), (4, "c d.png"), (4, "gone.png"), (4, "a.png")]
    shelf, state = shelf_of(tmp_path, {"f.fb2": text})
    workflow.prepare(spark, shelf, state)
    (path,) = workflow.assemble(spark, state, "epub", str(tmp_path / "out"))
    with zipfile.ZipFile(path) as z:
        page, cover = z.read("c1.xhtml").decode(), z.read("c0.xhtml").decode()
        assert len([n for n in z.namelist() if n.startswith("images/")]) == 5
        assert page.index("One</h2>") < page.index("images/a.png") < page.index("images/in.png") < page.index("<p>x") < page.index("<p>y") < page.index("images/b.png") < page.index("<p>z") < page.index("images/c%20d.png")
        assert page.count("<img") == 5 and "cover.jpg" in cover and cover.count("<img") == 1
        assert b'href="images/cover.jpg" media-type="image/jpeg"' in z.read("book.opf")
    made = epub.read(open(path, "rb").read())
    assert [e["title"] for e in made["toc"]] == ["One"]


# ---- a glossary that grows


def replies(rng, n):
    sources = ["Aa", "Bb", "Cc", "Dd e"]
    for _ in range(n):
        yield [{"source": rng.choice(sources), "target": rng.choice("xy"), "reading": rng.choice(["", "r1", "r2"]), "gender": rng.choice(["", "f", "Unknown"]), "note": "", "type": rng.choice(["术语", "敬称"])} for _ in range(rng.randrange(4))]


def test_a_growing_glossary_follows_the_rules_of_proposals(spark):
    rng = random.Random(4)
    found = list(replies(rng, 60))
    book = glossary.BookTerms([])
    for terms in found:
        book.propose(model.terms_of(json.dumps({"terms": terms})))
    rows = [(t["source"], t["target"], t["reading"], "" if t["gender"] == "Unknown" else t["gender"], t["note"], t["type"], [], 0, k) for k, t in enumerate(t for b in found for t in b)]
    kept, _ = glossary.upsert(spark.createDataFrame(rows, "source string, target string, reading string, gender string, note string, type string, aliases array<string>, chapter int, seq long"))
    fields = ("source", "target", "reading", "gender", "type")
    assert sorted(tuple(t[f] for f in fields) for t in book.terms.values()) == sorted(tuple(r[f] for f in fields) for r in kept.collect())
    lines = glossary.glossary_lines(kept.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))).first()["glossary"]
    assert book.lines(None) == lines
    assert book.lines("nothing") == "" and book.lines("ｄD E") == next(x for x in lines.split("\n") if "Dd e" in x)


def test_replies_are_read_alike_in_tasks_and_plans(spark):
    said = ['{"terms": [{"source": " a ", "target": "b", "gender": "UNKNOWN"}, {"source": "x"}, 7, {"source": 3, "target": true}, {"source": 4, "target": 5, "note": null}]}', "[]", "no", '[{"source": "q", "target": "r", "extra": 1}]', '```json\n{"terms": [{"source": "f", "target": "g"}]}\n```']
    from quire.functions.loose_json import loose_json

    df = spark.createDataFrame(list(enumerate(said)), "k int, reply string")
    reply = loose_json(F.col("reply"))
    rows = extraction.extracted_terms(df.withColumn("_list", F.coalesce(F.get_json_object(reply, "$.terms"), reply)), ["k"], "_list").orderBy("k", "position").collect()
    assert [(r["k"], *(r[f] for f in extraction.TERM_FIELDS)) for r in rows] == [(k, *(t[f] for f in extraction.TERM_FIELDS)) for k, s in enumerate(said) for t in model.terms_of(s)]


def test_terms_of_a_batch_stand_in_the_next_brief(spark, tmp_path):
    shelf, state = shelf_of(tmp_path, {"a.md": "\n\n".join(["Constantinople is far", "nothing here", "to Constantinople again"]), "b.md": "Constantinople elsewhere"})
    settings = config.deep_merge(config.DEFAULTS, {"segment": {"batch_chars": 25}, "pipeline": {"glossary_scope": "batch"}})
    workflow.prepare(spark, shelf, state, settings)
    seen = str(tmp_path / "seen")

    def keep(messages, tier):
        if messages[0]["content"].startswith("[translate]"):
            with open(f"{seen}-{uuid.uuid4().hex}", "w") as f:
                json.dump([json.loads(messages[-1]["content"]), json.loads(json.loads(messages[1]["content"])["brief"]).get("glossary")], f)
        return model.stand_in(messages, tier)

    workflow.translate(spark, state, model.FakeProvider(keep), settings)
    told = {x[0][0]: x[1] for x in (json.loads(p.read_text()) for p in tmp_path.glob("seen-*"))}
    line = "- Constantinople -> elponitnatsnoC"
    assert told["to Constantinople again"] == line and told["nothing here"] is None and told["Constantinople is far"] is None and told["Constantinople elsewhere"] is None
    proposed = workflow.read(spark, state, "proposals")
    assert proposed.where("source = 'Constantinople'").count() == 3
    workflow.translate(spark, state, model.FakeProvider(keep), settings)  # nothing is asked, or proposed, again
    assert workflow.read(spark, state, "proposals").count() == proposed.count() == 3
    with pytest.raises(ValueError, match="scope"):
        agents.translated_books(spark.createDataFrame([], "path string"), scope="odd")


# ---- usage, digests, back translations, status


def test_every_call_counts_once(spark, tmp_path):
    shelf, state = shelf_of(tmp_path, {"a.md": "# One\n\nalpha beta\n\n# Two\n\ngamma", "b.md": "other words"})
    workflow.prepare(spark, shelf, state)
    log = str(tmp_path / "calls")

    def counted(messages, tier):
        with open(f"{log}-{uuid.uuid4().hex}", "w") as f:
            f.write(messages[0]["content"])
        return model.stand_in(messages, tier)

    settings = config.deep_merge(config.DEFAULTS, {"pipeline": {"back_translation_rate": 1.0}})
    client = model.FakeProvider(counted)
    workflow.understand(spark, state, client, settings)
    workflow.translate(spark, state, client, settings)
    found = workflow.review(spark, state, client, settings=settings).collect()
    workflow.titles(spark, state, client)
    workflow.qa(spark, state, client)
    total = workflow.usage_report(spark, state).where("scope = 'totals'").first()
    assert total["calls"] == len(list(tmp_path.glob("calls-*"))) and total["total"] == total["prompt"] + total["completion"] > 0
    stages = {r["slot"] for r in workflow.usage_report(spark, state).where("scope = 'stage'").collect()}
    assert {"understand", "translate", "review", "qa"} <= stages
    assert len(found) == 0  # the stand-in turns every text back
    again = workflow.read(spark, state, "usage").limit(3).persist()
    assert again.count() == 3
    again.write.mode("append").parquet(f"{state}/usage")
    assert workflow.usage_report(spark, state).where("scope = 'totals'").first()["calls"] == total["calls"]


def test_back_translations_are_issues_of_their_review(spark, tmp_path):
    shelf, state = shelf_of(tmp_path, {"a.md": "# One\n\nalpha beta\n\ngamma"})
    settings = config.deep_merge(config.DEFAULTS, {"pipeline": {"back_translation_rate": 1.0, "punctuation": False}})
    workflow.prepare(spark, shelf, state)
    workflow.translate(spark, state, model.FakeProvider(lambda m, t: json.dumps({"translations": ["same as all"] * len(json.loads(m[-1]["content"]))}) if m[0]["content"].startswith("[translate]") else model.stand_in(m, t)), settings)
    for _ in range(2):
        found = workflow.review(spark, state, force=True, settings=settings).collect()
        assert {(r["seg"], r["type"]) for r in found} == {(0, "back_translation:meaning"), (1, "back_translation:meaning"), (2, "back_translation:meaning")} and len(found) == 3
    none = config.deep_merge(settings, {"pipeline": {"back_translation_rate": 0.0}})
    assert workflow.review(spark, state, force=True, settings=none).count() == 0


def test_failed_digests_and_analyses_are_asked_again(spark, tmp_path):
    shelf, state = shelf_of(tmp_path, {"a.md": "# One\n\nbad luck\n\n# Two\n\nfine", "b.md": "worse luck"})
    workflow.prepare(spark, shelf, state)

    def some(messages, tier):
        if messages[0]["content"].startswith("[digest]") and "bad" in messages[-1]["content"] or messages[0]["content"].startswith("[analysis]") and "worse" in messages[-1]["content"]:
            raise OSError("no answer")
        return model.stand_in(messages, tier)

    with pytest.raises(RuntimeError, match="b.md: no analysis"):
        workflow.understand(spark, state, model.FakeProvider(some))
    assert workflow.digests_of(spark, state).count() == 2 and workflow.read(spark, state, "books").count() == 1
    workflow.understand(spark, state)
    assert workflow.digests_of(spark, state).count() == 3 and workflow.read(spark, state, "books").count() == 2


def walked(actions):
    state, refused = "pending", 0
    for a in actions:
        new = status.TRANSITIONS.get(a, {}).get(state)
        refused += new is None
        state = new or state
    return state, refused


@pytest.mark.parametrize("run", [1000, 3])
def test_status_follows_the_events(spark, monkeypatch, run):
    monkeypatch.setattr(status, "RUN", run)
    r = random.Random(6)
    events = [(k, i * 7 - 20, r.choice([*status.TRANSITIONS, "odd", None])) for k in range(12) for i in range(r.choice([1, 2, 5, 40]))]
    shuffled = r.sample(events, len(events))
    out = {x["k"]: (x["status"], x["n_refused"], x["n_events"]) for x in status.after_events(spark.createDataFrame(shuffled, "k int, o long, action string"), ["k"], "o").collect()}
    assert out == {k: (*walked([a for key, _, a in events if key == k]), len([1 for key, _, _ in events if key == k])) for k in range(12)}


def test_a_chapter_runs_while_its_run_lives(spark, tmp_path):
    shelf, state = shelf_of(tmp_path, {"a.md": "text"})
    workflow.prepare(spark, shelf, state)
    workflow._log(state, workflow.segments(spark, state).select("path", "chapter"), "chapter_started")
    told = lambda: {r["status"] for r in workflow.status(spark, state).collect()}
    assert told() == {"pending"}
    with workflow.locked(spark, state):
        assert told() == {"running"}
    workflow.translate(spark, state)
    assert told() == {"done"}


def test_failures_that_no_retry_mends_are_not_retried():
    calls = []

    class Refused(Exception):
        retryable = False

    def refuse(messages, tier):
        calls.append(tier)
        raise Refused

    with pytest.raises(Refused):
        model.RetryingProvider(model.FakeProvider(refuse), sleep=lambda s: None).complete([], "strong")
    assert len(calls) == 1


def test_synopses_equal_a_plain_loop(spark):
    r = random.Random(3)
    books = {b: [(k, "w" * r.choice([0, 30, 70, 90]) + f" {b}{k}" if r.random() > 0.2 else " ") for k in range(n)] for b, n in (("a", 1), ("b", 23), ("c", 9))}
    rows = [(b, k, t) for b, items in books.items() for k, t in items]
    got = {x["book"]: x["synopsis"] for x in agents.synopses(spark.createDataFrame(rows, "book string, k int, digest string"), ["book"], "k", budget=120).collect()}
    want = {}
    for b, items in books.items():
        level = [t for _, t in items if t.strip()]
        while len(level) > 1:
            groups = [[level[0]]]
            for t in level[1:]:
                if sum(len(x) for x in groups[-1]) + len(groups[-1]) + len(t) > 120:
                    groups.append([t])
                else:
                    groups[-1].append(t)
            if len(groups) == len(level):
                groups = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [g[0] if len(g) == 1 else "\n".join(g)[:80] for g in groups]
        if level:
            want[b] = level[0]
    assert got == want


def test_epubs_as_a_data_source(spark, tmp_path):
    from quire.sources import book_source, books
    from tests.test_operators import book

    shelf, _ = shelf_of(tmp_path, {"b.epub": book(), "c.EPUB": sinks.build_epub("T", [("One", [("heading", "h"), ("text", "x\ny")]), ("Two", [("text", "z")])]), "d.md": "no"})
    book_source.register(spark)
    found = spark.read.format(book_source.NAME).load(shelf)
    key = ["path", "resource", "href", "kind", "anchor", "source"]
    whole = books.parsed_epubs(books.book_files(spark, shelf).where("fmt = 'epub'")).select("path", F.explode("segments").alias("s")).select("path", "s.*")
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))
    per_book = whole.select("path", "resource").distinct().count()
    assert found.rdd.getNumPartitions() == per_book == 3
    one = found.where("resource = 1 and source like 'z%'")
    assert one.rdd.getNumPartitions() == 1 and [r["source"] for r in one.collect()] == ["z"]
    assert found.where(F.col("href").isin("c0.xhtml", "none")).select("source").distinct().count() == 3
    assert found.where("path = 'nowhere'").count() == 0
    with pytest.raises(Exception, match="missing|nowhere"):
        spark.read.format(book_source.NAME).load(str(tmp_path / "nowhere")).count()


def test_requests_by_dialect():
    from quire.operators import requests

    said = [{"role": "system", "content": "s"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": "u"}]
    plain = requests.chat_request("none", "m", said, max_tokens=10, reasoning=False)
    assert plain == {"model": "m", "messages": said, "stream": False, "max_tokens": 10}
    asked = requests.chat_request("none", "m", said, json_mode=True)
    assert asked["response_format"] == {"type": "json_object"} and [m["content"] for m in asked["messages"]] == ["s\n\nOutput must be valid json.", "a", "u\n\nOutput must be valid json."] and said[0]["content"] == "s"
    assert [m["content"] for m in requests.asking_for_json([{"role": "user", "content": "as JSON"}])] == ["Output must be valid json.", "as JSON"]
    one = requests.chat_request("openai", "m", said, max_tokens=10)
    assert one["reasoning_effort"] == "high" and one["max_completion_tokens"] == 4096 and "extra_body" not in one and "max_tokens" not in one
    assert requests.chat_request("openai", "m", said, reasoning=False)["reasoning_effort"] == "none"
    two = requests.chat_request("deepseek", "m", said, effort="low", max_tokens=9000)
    assert two["reasoning_effort"] == "low" and two["extra_body"] == {"thinking": {"type": "enabled"}} and two["max_tokens"] == 9000
    off = requests.chat_request("deepseek", "m", said, reasoning=False, overrides={"thinking": {"x": 1}, "top": 2})
    assert "reasoning_effort" not in off and off["extra_body"] == {"thinking": {"type": "disabled", "x": 1}, "top": 2}
    assert requests.chat_request("openrouter", "m", said, effort="low")["extra_body"] == {"reasoning": {"effort": "low"}}
    assert requests.chat_request("openrouter", "m", said, reasoning=False)["extra_body"] == {"reasoning": {"enabled": False}}
    with pytest.raises(ValueError):
        requests.chat_request("odd", "m", said)
    turns = requests.turns_request([*said, {"role": "system", "content": " "}, {"role": "system", "content": "t"}, {"content": None}])
    assert turns == ("s\n\nt", [{"role": "model", "parts": [{"text": "a"}]}, {"role": "user", "parts": [{"text": "u"}]}, {"role": "user", "parts": [{"text": ""}]}])


def test_converted_pdfs(spark, tmp_path):
    from quire.sources import books

    page = lambda head, body: f"<html><HEAD><title>t</title><meta charset='utf-8'/><style>{head}</style></HEAD><body class=x>{body}</body></html>"
    files = {
        "x/a.pdf": "%PDF", "x/a.pdf.html": page("", "<h1>One</h1><p>ä</p>"), "x/b.PDF": "%PDF", "x/b.PDF.10.html": page("c", "<p>ten</p>"), "x/b.PDF.2.htm": page("b", "<h2>Two</h2><p>2</p>"),
        "x/c.pdf": "%PDF", "y/a.pdf.html": page("", "<p>of no PDF</p>"), "y/d.doc": "?", "y/e.md": "text",
    }
    shelf, state = shelf_of(tmp_path, files)
    whole = books.book_files(spark, shelf)
    rows = books.read_files(whole).orderBy("path", "chapter", "seg").select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1), "fmt", "title", "chapter_title", "kind", "source").collect()
    assert [tuple(r) for r in rows] == [
        ("x/a.pdf", "pdf", "a", "One", "heading", "One"), ("x/a.pdf", "pdf", "a", "One", "text", "ä"), ("x/b.PDF", "pdf", "b", "Two", "heading", "Two"), ("x/b.PDF", "pdf", "b", "Two", "text", "2"),
        ("x/b.PDF", "pdf", "b", "Two", "text", "ten"), ("y/a.pdf.html", "html", "a.pdf", "", "text", "of no PDF"), ("y/e.md", "text", "e", "e", "text", "text"),
    ]
    joined = next(r["content"] for r in whole.where("path like '%b.PDF'").collect()).decode()
    assert joined.count("<style>") == 1 and "<style>b</style>" in joined and joined.count("<title>") == 1 and joined.index("<p>2</p>") < joined.index("<p>ten</p>") and joined.count("<body") == 1
    names = books.book_files(spark, shelf, contents=False)
    for files in (whole, names):
        assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in books.left_out(files).collect()) == [("c.pdf", "not converted"), ("d.doc", "unsupported format")]
    workflow.prepare(spark, shelf, state)
    assert spark.read.parquet(f"{state}/segments").where("fmt = 'pdf'").count() == 5
    again = workflow.prepare(spark, shelf, state)
    assert again.count() == 7 and again.where("path like '%.pdf.html'").count() == 1
    (tmp_path / "in" / "x" / "c.pdf.html").write_text(page("", "<p>now</p>"))  # converted later
    assert workflow.prepare(spark, shelf, state).where("path like '%c.pdf' and source = 'now'").count() == 1


def test_ways_of_cutting_books(spark, tmp_path):
    from quire.operators import toc
    from quire.sources import books

    data = tmp_path / "b.epub"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", '<package><metadata><title>T</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", '<html><body><p>0</p><p id="a">1</p><p id="b">2</p><p id="c">3</p><p id="d">4</p></body></html>')
        point = lambda name, inner="": f'<navPoint><navLabel><text>{name}</text></navLabel><content src="a.xhtml#{name}"/>{inner}</navPoint>'
        z.writestr("toc.ncx", f"<ncx><navMap>{point('a', point('b', point('c')))}{point('d')}</navMap></ncx>")

    def chapters(split):
        rows = books.read_books(spark, str(data), split).orderBy("chapter", "seg").collect()
        found: dict = {}
        for r in rows:
            found.setdefault((r["chapter"], r["chapter_title"]), []).append(r["source"])
        return [(title, "".join(x)) for (_, title), x in found.items()]

    assert chapters("top-level-toc") == [("", "0"), ("a", "123"), ("d", "4")]
    assert chapters("second-level-toc") == [("", "0"), ("a", "1"), ("b", "23"), ("d", "4")]
    assert chapters("whole-toc") == [("", "0"), ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    with pytest.raises(ValueError, match="top-level-toc"):
        toc.strategy("by-moon")


def test_heads_and_joined_pages(spark):
    from quire.functions import text

    cases = {None: None, "": "", "no head": "", "<head></head>": "", "<HEAD x> <Title>a\nb</Title><meta charset=x> \n<style>s</style> </HEAD><head>2</head>": "<style>s</style>"}
    rows = spark.createDataFrame([(k,) for k in cases], "html string").select("html", text.head_of(F.col("html")).alias("h")).collect()
    assert {r["html"]: r["h"] for r in rows} == cases
    page = spark.range(1).select(text.one_page(F.array(F.lit("<head>h</head><body>1</body>"), F.lit("2")), F.lit("<t>")).alias("p")).first()["p"]
    assert page == '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>&lt;t&gt;</title>\nh\n</head>\n<body>\n12\n</body>\n</html>'


def test_last_pages_and_lists_of_resources(spark):
    import io

    from quire.sources import books

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<o:package xmlns:o="u"><o:manifest><!-- </o:manifest> --><o:item id="about-page" href="About.xhtml" media-type="application/xhtml+xml"/></o:manifest><o:spine><o:itemref idref="about-page"/></o:spine></o:package>')
        z.writestr("o/About.xhtml", "<p>old</p>")
    for k in (1, 2):  # names and ids that are taken are not taken again
        made = io.BytesIO(sinks.with_last_page(made.getvalue(), "A < B", ["x & y"]))
        with zipfile.ZipFile(made) as z:
            assert z.infolist()[0].compress_type == zipfile.ZIP_STORED
            assert epub.read_package(z).spine == ["o/About.xhtml", *(f"o/about-{i}.xhtml" for i in range(1, k + 1))]
    assert [s["source"] for r in epub.read(made.getvalue())["resources"] for s in r["segments"]] == ["old", "A < B", "x & y", "A < B", "x & y"]
    for package in (b"<package><manifest/><spine></spine></package>", b"<package><spine></spine></package>", b"<package", None):
        odd = io.BytesIO()
        with zipfile.ZipFile(odd, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
            if package is not None:
                z.writestr("p.opf", package)
        assert sinks.with_last_page(odd.getvalue(), "T", []) == odd.getvalue()
    lists = {1: '[{"href": "a"}, 3, {"href": 5}, {"href": "b", "index": 9}, {"href": "a", "index": 7}, {"href": ""}, {"href": "c", "index": "2"}, null, {"href": "d", "index": 1.5}]', 2: None, 3: "no list", 4: "[]", 5: '{"href": "a"}'}
    found = books.resource_list(spark.createDataFrame(list(lists.items()), "id int, l string"), ["id"], "l").collect()
    assert sorted((r["id"], r["href"], r["index"]) for r in found) == [(1, "a", 0), (1, "b", 9), (1, "c", 6), (1, "d", 8)]
