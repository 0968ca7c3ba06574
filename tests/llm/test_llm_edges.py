"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, decontamination, jaccard_join, line_dedup, packing, pii, quality, suffix_dedup, token_counts, url_filter
from quire.llm.ann import nearest_neighbours

LONG = "w" * 60_000 + " x" * 20_000
ROWS = [
    (1, "one two three four five six\nseven eight nine ten\neleven twelve thirteen\nfourteen fifteen"),
    (1, "one two three four five six\nseven eight nine ten\neleven twelve thirteen\nfourteen fifteen"),
    (2, "one two three four five six\nseven eight nine ten\neleven twelve thirteen\nfourteen fifteen"),
    (2, "another text under the same id"),
    (3, None), (4, ""), (5, "   \n \n"), (None, "no id here\nbut two lines"), (None, None), (6, LONG), (7, "\n"), (8, "é ß 😀 \u0000 x"),
]
CLASHES = ("score", "spans", "k", "h", "size", "key", "root", "hash", "n_lines", "item_id", "found", "pair", "block", "class_id", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("extra") for c in CLASHES}).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 1), (8, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_quality(odd, labels, spark):
    model = quality.train(odd, labels)
    out = quality.score_quality(odd, model)
    assert ids(out) == ALL and set(out.columns) == set(odd.columns)
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    nothing = quality.train(odd, labels.limit(0))
    assert nothing is None and {r["score"] for r in quality.score_quality(odd, nothing, ["doc_id"]).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_ann(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (40, [float("inf"), 1.0]), (None, [1.0, 1.0]), (60, [0.0, 2.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    out = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert out == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.5), (60, 1, 3, 2.0), (60, 2, 1, 0.0), (60, 3, 2, 0.0)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_with_repeated_ids_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 12)).astype(np.float32)
    vectors[::3] *= rng.uniform(0.1, 5, (300, 1)).astype(np.float32)
    vectors[100:400] = vectors[7]  # a common vector under many ids
    ids = rng.integers(0, 500, 900)
    ids[500:800] = 77  # a common id with many vectors
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, vectors, strict=True)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for shard, block in ((16384, 4096), (200, 7)):
        monkeypatch.setattr(ann, "SHARD", shard)
        monkeypatch.setattr(ann, "QUERIES", block)
        out = nearest_neighbours(df, F.col("vec_id") % 7 == 0, 20).collect()
        found = {}
        for r in sorted(out, key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        hits = 0
        for q in {i for i, _ in rows if i % 7 == 0}:
            asked = np.array(min(v for i, v in rows if i == q), np.float64)
            best, scores = {}, {}
            for i, v in rows:
                if i != q:
                    score = float((np.array(v) * asked).sum())
                    best[i] = max(best.get(i, -np.inf), score)
                    scores.setdefault(i, []).append(score)
            want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
            got = found[q]
            assert len(got) == 20 == len(dict(got)) and [x for x in sorted(got, key=lambda x: (-x[1], x[0]))] == got
            assert all(min(abs(x - s) for x in scores[i]) < 1e-9 for i, s in got)
            hits += sum(abs(best[i] - s) < 1e-9 for i, s in got if i in dict(want))
        assert hits >= 0.9 * 20 * len(found)


def test_suffix_dedup(odd):
    out = suffix_dedup.remove_repeats(odd)
    assert ids(out) == ALL
    by_size = {r["n_bytes"]: r for r in out.collect()}
    long = by_size[len(LONG)]
    assert bytes(long["kept"]) == b"" or len(long["kept"]) < 400  # both of its parts repeat themselves
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_pii(odd):
    assert ids(pii.find_pii(odd)) == ALL
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_line_dedup(odd):
    out = line_dedup.line_dedup(odd)
    assert ids(out) == ALL and set(out.columns) == {*odd.columns, "n_removed_lines", "n_removed_chunks"}
    left = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, ROWS[0][1]) in left and (2, "") in left and (3, None) in left and (6, LONG) in left
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


def test_decontamination(odd, spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, ""), (4, "another text under the same"), (5, "x"), (6, "another text under the same")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, items).collect()}
    assert found == {(1, 1), (2, 1), (2, 4), (6, 5), (8, 5)}
    assert ids(decontamination.decontaminate(odd, items)) == [x for x in ALL if x not in [(False, d) for d in (1, 2, 6, 8)]]
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0
    assert decontamination.contaminated(odd.limit(0), items).count() == 0


def test_jaccard_join(odd):
    out = jaccard_join.jaccard_join(odd)
    assert ids(out) == ALL
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out.collect()}
    assert found[1] == found[2] == (1, 0) and found[4] == (4, 0)
    unnamed = [r["class_id"] for r in out.collect() if r["doc_id"] is None]
    assert len(unnamed) == 2 and None in unnamed and max(c or 0 for c in unnamed) >= jaccard_join.OWN_NUMBER
    kept = jaccard_join.drop_near_duplicates(odd)
    assert ids(kept) == [*((False, k) for k in range(1, 9)), (True, 0), (True, 0)] and set(kept.columns) == set(odd.columns)
    assert {r["text"] for r in kept.collect()} == {r[1] for r in ROWS}  # every distinct text stays
    assert jaccard_join.jaccard_join(odd.limit(0)).count() == 0


def test_jaccard_join_tells_texts_apart_whatever_their_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, other = base.replace("w59", "v"), " ".join(f"x{k}" for k in range(30))
    rows = [(1, base), (2, base), (2, other), (2, near), (None, near + " end"), (None, other), (None, "alone"), (None, "alone"), (3, other + " y z q"), (2, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["class_id"], r["n_links"], r["n_linked_docs"]) for r in jaccard_join.jaccard_join(df).collect()]
    assert len(out) == len(rows)
    # base with its copy, near and near + end are one class; other and its extension another; alone is apart.
    assert sorted(n for _, c, n, _ in out if c == 1) == [2, 2, 2, 2]
    classes = {c for d, c, *_ in out}
    assert len(classes) == 3 and sum(c >= jaccard_join.OWN_NUMBER for c in classes) >= 1
    kept = sorted(r["text"] for r in jaccard_join.drop_near_duplicates(df).collect())
    assert len(kept) == 3 and base in kept and "alone" in kept


def test_urls(spark):
    urls = ["http://Www.Example.COM/en/a", "https://a.example.com/en/x?q#f", "http://b.com", "http://b.com/", "ftp://x.net/es/1", "x.net/es/", None, "", "http://", "http://c.org/é?x://y", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    out = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert [(out[k]["host"], out[k]["path"], out[k]["rule"]) for k in range(len(urls))] == [
        ("www.example.com", "/en/a", "www.example.com/en/"), ("a.example.com", "/en/x", "example.com/en/"), ("b.com", "", None), ("b.com", "/", "com/"), ("x.net", "/es/1", "net/es/"),
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("c.org", "/é", None), ("b:", "//c/d", None),
    ]
    assert {out[0]["verdict"], out[3]["verdict"]} == {"allow"} and {out[1]["verdict"], out[4]["verdict"]} == {"block"}
    assert all(r["verdict"] in ("allow", "block") for r in out.values())
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    none = url_filter.filter_urls(df.where("page_id = 9")).first()
    assert none["threshold"] == 0


def test_packing_and_token_counts(odd):
    out = packing.pack(odd)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in ROWS}
    assert packing.pack(odd.limit(0)).count() == 0
    counts = token_counts.token_counts(odd)
    assert {r["doc_id"] for r in counts.collect()} == {r[0] for r in ROWS}
    assert token_counts.token_counts(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(odd, rule="none")


def test_every_stage_of_the_pipeline(odd, labels, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs anywhere in the texts at all so it is clean really")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert set(out.columns) == set(docs.columns), name
            out.count()
