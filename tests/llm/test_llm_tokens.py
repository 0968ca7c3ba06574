"""Ids of very long runs of one character, and of what stands around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import tokenization
from quire.llm.packing import pack
from quire.llm.token_counts import token_counts
from quire.llm.tokenization import byte_bpe, default_path


@pytest.fixture(scope="module")
def hugging():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.mark.parametrize("mark", ["\n", " ", "\t", "a", "^", " ", "\x1c"])
def test_a_million_of_one_character(hugging, mark):
    text = mark * 1_000_000
    assert byte_bpe(default_path()).ids(text).tolist() == hugging.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("mark", ["\n", " ", "\t"])
def test_twenty_million_blanks(mark):
    bpe = byte_bpe(default_path())
    ids = bpe.ids(mark * 20_000_000)
    assert int(bpe.lengths[ids].sum()) == 20_000_000


def test_runs_among_other_text(hugging, monkeypatch):
    monkeypatch.setattr(tokenization, "LONG_RUN", 5)
    bpe = byte_bpe(default_path())
    special = next(iter(bpe.special))
    runs = ["", " ", "\n", " " * 9, "\n" * 9, " \n\t" * 4, "　" * 8, "\x85" * 7, "\x1c" * 9, "\t" * 6 + " "]
    for a in runs:
        for b in ("x", "'s", "1", "!", "é", special, "", " x"):
            for text in (f"word{a}{b}", f"{a}{b}{a}", f"{special}{a}{b}", f"{a}{special}{a}"):
                assert bpe.ids(text).tolist() == hugging.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_and_counts_survive(spark):
    rows = [(1, "\n" * 1_000_000), (2, "a b"), (3, " " * 1_000_000 + "end"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for packed in (pack(df), corpus_pipeline.packing(spark, df, "")):
        pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
        assert len(pieces) == 4 and all(r["n"] == r["all"] for r in pieces)
    counts = {r["doc_id"]: r["n"] for r in token_counts(df).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    bpe = byte_bpe(default_path())
    assert counts == {k: len(bpe.ids(t or "")) for k, t in rows}
    assert np.all(bpe.lengths[bpe.ids("a b")] > 0)
