"""What every stage of the pipeline keeps, each on its own input, against plain loops."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import quality
from quire.llm.tokenization import byte_bpe, default_path
from tests.llm.test_llm_results import SF, brute_force_lines, near_duplicate_classes, overlapping

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The documents that go into each stage, written as the pipeline writes them, and its result."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = f"{folder}/{name}"
        stage(spark, docs, SF).write.parquet(result)
        out[name] = (docs, spark.read.parquet(result))
        docs = spark.read.parquet(result)
    return out


def texts(df):
    rows = df.select("doc_id", "text").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality(spark, inputs):
    docs, kept = inputs["quality"]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    before = texts(docs)
    want = {}
    for d, t in before.items():
        x, sizes = quality.block_features([t or ""])
        if model.scores(x, sizes)[0] >= 0.3:
            want[d] = t
    assert texts(kept) == want and 0 < len(want) < len(before)


def test_line_dedup(inputs):
    docs, kept = inputs["line_dedup"]
    before = texts(docs)
    left = brute_force_lines(list(before.items()))
    assert texts(kept) == {d: t for d, t in left.items() if t == before[d] or t.strip()}
    assert {r["n_chars"] == len(r["text"]) for r in kept.collect()} == {True}


def test_near_duplicates(inputs):
    docs, kept = inputs["near_duplicates"]
    before = texts(docs)
    classes = near_duplicate_classes(before)
    assert texts(kept) == {d: t for d, t in before.items() if classes[d] == d}


def test_benchmark(spark, inputs):
    docs, kept = inputs["benchmark"]
    before = texts(docs)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    gone = {d for d, _ in overlapping(before, dict(zip(items.item_id.tolist(), items.text, strict=True)))}
    assert texts(kept) == {d: t for d, t in before.items() if d not in gone} and gone


def test_packing(inputs):
    docs, pieces = inputs["packing"]
    bpe = byte_bpe(default_path())
    ids = {d: np.append(bpe.ids(t or ""), 0).astype("<u4") for d, t in texts(docs).items()}
    at = Counter()
    for r in sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
    assert dict(at) == {d: len(x) for d, x in ids.items()}


def test_run_is_all_stages(spark, inputs):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = {(r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, SF).select(columns).collect()}
    assert found == {(r["doc_id"], r["doc_tokens"]) for r in inputs["packing"][1].collect()}


def test_benchmark_of_documents_over_several_partitions(spark, tmp_path):
    """The stage on more text than one partition holds; long texts against short items."""
    r = random.Random(12)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(5000)]
    items = [(k, " ".join(r.choices(words, k=20))) for k in range(30)]
    rows = [(k, " ".join([*r.choices(words, k=2000), items[k % 30][1] if k % 2 else "", *r.choices(words, k=2000)])) for k in range(300)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert texts(kept) == {k: t for k, t in rows if k % 2 == 0}
