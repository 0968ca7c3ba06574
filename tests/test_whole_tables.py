"""Queries over whole texts and tables, on small fixtures that reach beyond the cuts."""

import glob
import os
import random
import re

import duckdb
import pytest

from quire.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_punctuation_beyond_400_characters(spark, tables):
    sf = tables("documents", [(1, "word " * 100 + "end the tail"), (2, "word " * 100 + "end. the, tail"), (3, "word " * 100 + "end. the, taut")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in catalog.QUERIES["punct_full"](spark, sf).collect()}[1].endswith("end “the” tail")
    for name in ("punct_ellipsis", "punct_double_quotes", "punct_gaps"):
        assert catalog.QUERIES[name](spark, sf).select("digest").distinct().count() == 3


def test_fragment_anchors_of_all_orders(spark, tables):
    rows = [(order, 7 + line, 1, line) for order in (3999, 4000, 90_000) for line in (1, 2, 3)]
    sf = tables("lineitem", rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    found = sorted(map(tuple, catalog.QUERIES["fragment_anchors"](spark, sf).collect()))
    assert found == [(3999, "i1", "b2"), (4000, "i1", "b2"), (90_000, "i1", "b2")]


def test_terms_of_all_documents_in_all_texts(spark, tables):
    r = random.Random(3)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(4, 6))) for _ in range(9000)]
    docs = [(60 + k, " ".join(r.choice(words) for _ in range(30)), "de" if k % 2 else "en", f"s{k % 3}") for k in range(1500)]
    terms = {}
    for d, text, _, _ in docs:
        if m := re.search("([A-Za-z]{5,}) ([A-Za-z]{4,})", text):
            terms.setdefault(m[1], []).append((m[2], "敬称" if d % 2 == 0 else "术语"))
    kind = {s: max(t for _, t in found) for s, found in terms.items()}
    keys = {(s, k) for s, found in terms.items() for k in [s, *(a for a, _ in found if kind[s] != "敬称")]}
    assert len(keys) > 2000
    want = {(d, s) for d, text, _, _ in docs for s, k in keys if k in text}
    sf = tables("documents", docs, "doc_id long, text string, lang string, source string")
    found = [tuple(x) for x in catalog.QUERIES["terms_in_text"](spark, sf).collect()]
    assert len(found) == len(want) and set(found) == want
    book = {d: source for d, _, _, source in docs}
    counts = {}
    for b, s in {(book[d], s) for d, s in want}:
        counts[b, kind[s]] = counts.get((b, kind[s]), 0) + 1
    assert {(x["book"], x["type"]): x["n"] for x in catalog.QUERIES["chapter_terms"](spark, sf).collect()} == counts


def test_memory_is_probed_with_all_documents(spark, tables):
    tables("benchmark", [(0, "text 3"), (1, "unknown")], "item_id long, text string")
    sf = tables("documents", [(k, f"text {k}", f"s{k}") for k in range(12)], "doc_id long, text string, source string")
    found = {r["doc_id"]: r["target_text"] for r in catalog.QUERIES["tm_lookup"](spark, sf).collect()}
    assert found == {k: f"s{k}" for k in range(12)} | {-1: "s3", -2: None}


def test_synopsis_groups_of_whole_texts(spark, tables):
    sizes = (5000, 6998, 1, 13_000, 700, 700)
    sf = tables("documents", [(k, "s", "x" * n) for k, n in enumerate(sizes)] + [(5000, "s", "x")], "doc_id long, source string, text string")
    found = sorted(map(tuple, catalog.QUERIES["synopsis_groups"](spark, sf).collect()))
    assert found == [("s", 0, 0, 0, 2), ("s", 0, 1, 2, 1), ("s", 0, 2, 3, 1), ("s", 0, 3, 4, 2), ("s", 5, 0, 0, 1)]


def against_sql(spark, sf, name):
    """Rows of a query and of its SQL over the tables of a folder, columns by name."""
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(map(tuple, found.select(*columns).collect()), key=repr), sorted(duck.sql(catalog.ORACLE[name]).select(*columns).fetchall(), key=repr)


def test_consistency_sorts_the_lines_of_first_words(spark, tables):
    first = ["This.\nIn a", "Hello b", "x c", "Lost\nAway d", "Lost e", "\r\u2028Odd\rly\n f", "\u3000\u00a0", "y g", "z h"]
    sf = tables("conversations", [(1, k, "user", text) for k, text in enumerate(first)] + [(2, 0, "user", "\u3000"), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    found, want = against_sql(spark, sf, "consistency_issues")
    assert found == want and [x[2] for x in found] == ["\r\u2028Odd\rly", "Away", "Lost", "Lost"]


def test_block_counts_show_references_as_their_sql_does(spark, tables):
    titles = ["a &amp; b", "token = &quot;0b", "cut &amp", "&lt;i&gt; &#65; &amp;lt;", "x &", "&nbsp;", "plain"]
    pages = [(k, f"<body><h1>{t}</h1><p>one</p><ul><li>&nbsp;</li></ul></body>") for k, t in enumerate(titles)]
    sf = tables("pages", [*pages, (90, "<body><p> </p></body>"), (91, ""), (92, None)], "page_id long, html string")
    found, want = against_sql(spark, sf, "html_block_counts")
    assert found == want and len(found) == 10


def test_terms_as_their_sql_finds_them(spark, tables):
    rows = [(1, "Alphabet ingess", "a"), (2, "Ingess word here", "a"), (4, "Ingess hope", "b"), (5, "the ingeß ALPHABET", "b"), (7, "fullwidth Ａｌｐｈａｂｅｔ", "b"), (9, "fİngess", None), (11, None, "c"), (None, "Hopeful word", "c"), (None, "alphabet", "c"), (1, "hope", "a")]
    sf = tables("documents", rows, "doc_id long, text string, source string")
    for name in ("terms_in_text", "chapter_terms"):
        found, want = against_sql(spark, sf, name)
        assert found == want


def test_found_terms_are_not_shuffled(spark, tables):
    sf = tables("documents", [(k, f"Alphabet word{k} ingess", "a") for k in range(9)], "doc_id long, text string, source string")
    plans = {name: catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString() for name in ("terms_in_text", "chapter_terms")}
    # Rows for terms of texts go from the tasks that find them to whoever takes them; texts are dealt once, by number.
    plan = plans["terms_in_text"]
    assert not re.search("Exchange|Aggregate", plan[: plan.index("MapInArrow")]) and len(re.findall(r"MapInArrow", plan)) == 1
    # For terms of books there is no row for each term of each text.
    assert "doc_id" not in re.search(r"MapInArrow.*\[([^\[\]]*)\]", plans["chapter_terms"])[1]
