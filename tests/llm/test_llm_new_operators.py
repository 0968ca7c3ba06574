"""Whitening, tensored MinHash and collocations against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.llm import collocations, minhash_dedup, quality, queries, url_filter, whitening

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {"op11_whitening", "op12_minhash_dedup", "op13_collocations"} <= set(names)


# ---- 11


def whitened_plainly(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(0)
    z = x - s / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    return [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x], z @ u[:, :8] / np.sqrt(e[:8]), e[:8] / e.sum()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_whitening_equals_the_eigenvectors(spark, parts):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = table.toPandas()
    deviation, coordinates, share = whitened_plainly(vectors.embedding)
    out = whitening.whiten(table.repartition(parts)).toPandas()
    assert len(out) == 8 * len(vectors) and set(out.n) == {len(vectors)}
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[vectors.vec_id].to_numpy()
    assert np.abs(np.abs(got) - np.abs(coordinates)).max() < 1e-7
    assert out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9
    by = out.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert [by[v] for v in vectors.vec_id] == deviation
    assert np.abs(out[out.vec_id == vectors.vec_id[0]].sort_values("component").explained.to_numpy() - share).max() < 1e-12


def test_whitening_reads_the_given_query(spark):
    assert queries.op11_whitening(spark, SF).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (None, [3.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "component": F.lit(1)})
    out = whitening.whiten(df.repartition(4)).collect()
    assert Counter((r["vec_id"], r["n"]) for r in out) == {(1, 5): 4, (2, 5): 2, (None, 5): 2, (9, 5): 2, (8, 1): 3}
    lone = [r for r in out if r["vec_id"] == 8]
    assert all(r["whitened"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in lone)
    assert all(r["deviation"] is None for r in out if r["vec_id"] == 9)
    assert all(np.isfinite(r["whitened"]) for r in out)
    same = whitening.whiten(df.where("vec_id = 1")).collect()
    assert all(r["whitened"] == 0 and r["explained"] == 0 for r in same)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_merged_states_keep_every_dimension():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(500, 6)) * [1000, 100, 10, 3, 1, 0.4]).round().astype(np.int64) + 100_000
    whole = whitening.State.of_rows(x)
    merged = None
    for k in range(0, 500, 7):
        new = whitening.State.of_rows(x[k : k + 7])
        merged = new if merged is None else merged.merged(whitening.State.unpacked(*new.packed()))
    assert merged.sums == whole.sums and merged.n == 500
    a, b = np.linalg.svd(merged.factor)[1], np.linalg.svd(whole.factor)[1]
    assert np.abs(a / b - 1).max() < 1e-12


# ---- 12


def dedup_plainly(rows):
    texts = sorted({t for _, t in rows if t is not None})
    sets = {}
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", t.translate(_LOWER))
        sets[t] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for d, t in rows:
        if t is not None and sets[t] and d is not None:
            k = find(t)
            least[k] = d if least[k] is None else min(least[k], d)
    out = []
    for d, t in rows:
        filled = t is not None and bool(sets[t])
        c = least[find(t)] if filled else d
        out.append((d, len(sets[t]) if filled else 0, c, d == c))
    return out


def near_copies(rng):
    """Chains of texts that are linked step by step, crowds around one text, and texts of middling
    similarity that meet in tables without being linked."""
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for size in (3, 40, 120):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 6, 9])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    w = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((n, ("\n" if n % 2 else "  ").join(w).upper() if n % 3 else " ".join(w)))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = near_copies(random.Random(5)) + [(9000, "one two"), (9001, "One\ttwo"), (9002, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash_dedup.near_duplicates(df).collect()]
    want = dedup_plainly(rows)
    assert sorted(got) == sorted(want)
    assert len({r[2] for r in want}) < len(want)


def test_near_duplicates_of_odd_rows(spark):
    long = "w " * 50_000 + "end"
    rows = [(5, "a b c"), (5, "a b c"), (4, "A b\nc"), (None, "a b c"), (1, None), (None, None), (2, ""), (3, " \t\r\n"), (7, "é x \u0000"), (6, long), (8, long), (None, "alone"), (9, "x\u001cy")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("sig", "key", "core", "kept", "n_shingles", "team")})
    got = sorted(map(repr, (tuple(r) for r in minhash_dedup.near_duplicates(df.repartition(3)).collect())))
    want = [
        (5, 1, 4, False), (5, 1, 4, False), (4, 1, 4, True), (None, 1, 4, False), (1, 0, 1, True), (None, 0, None, True), (2, 0, 2, True), (3, 0, 3, True), (7, 1, 7, True),
        (6, 2, 6, True), (8, 2, 6, False), (None, 1, None, True), (9, 1, 9, True),
    ]
    assert got == sorted(map(repr, want))
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


# ---- 13


def collocations_plainly(rows, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, b in found.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and b >= c[q[i:j]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), (a, c[p[:k]], c[p[k:]], n[lang], s)))
        out += [(lang, i + 1, r[2].decode(), *r[3]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "top"), [(12_000_000, 2000), (3000, 2000), (3000, 5)])
def test_collocations_equal_brute_force(spark, shard, top):
    rng = random.Random(2)
    few = ["the", "of", "New", "York", "a", "b", "é", "x|y", " ", "\x1c"]
    rows = []
    for k in range(400):
        w = []
        for _ in range(rng.randrange(40)):
            w += rng.choice([["New", "York"], ["New", "york", "City"], ["a", "a", "a"], [rng.choice(few)], ["as", "well", "as", "the", "one"], [f"r{rng.randrange(5000)}"]])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for x in w)))
    rows += [("en", None), (None, ""), ("xx", "  . "), ("en", "x" * 30_000 + " y")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "f", "phrase", "score", "key")})
    got = sorted(tuple(r) for r in collocations.collocations(df.repartition(3), top=top, shard_bytes=shard).collect())
    want = collocations_plainly(rows, top=top)
    assert got == want and {r[0] for r in got} == {"en", "de", "und"}


def test_collocations_with_a_full_filter_and_empty(spark):
    df = spark.createDataFrame([("en", "so it goes " * 150 + " ".join(f"w{k} z{k % 7}" for k in range(30_000)))], "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(df, filter_bits=1 << 16).collect())
    assert got == collocations_plainly([tuple(r) for r in df.collect()])
    assert collocations.collocations(df.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    a, n, left, right = 10**11, 10**13, 3 * 10**11, 7 * 10**11
    wide = {"a": a, "n": n, "l": left, "r": right}
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(collocations.exact_score()).first()[0] == 1000 * wide["a"] * wide["n"] // (wide["l"] * wide["r"])


# ---- 1 and 8, what changed


def made_bags(seed, share, noise, n=600):
    rng = np.random.default_rng(seed)
    sizes, truth = rng.integers(1, 25, n), (rng.random(n) < share).astype(float)
    x, at = rng.normal(size=(sizes.sum(), quality.FEATURES)), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for i in np.flatnonzero(truth):
        x[at[i] + rng.choice(sizes[i], max(1, sizes[i] // 4), replace=False), :4] += 2.0
    return x, sizes, truth, np.where(rng.random(n) < noise, 1 - truth, truth)


def auc(score, truth):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    p = truth == 1
    return (rank[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())


def test_stopping_loses_nothing_on_an_unbalanced_noisy_set():
    x, sizes, _, labels = made_bags(1, 0.1, 0.02, 1500)
    other, other_sizes, truth, _ = made_bags(2, 0.1, 0.0, 1500)
    stopped, full = (auc(quality.fit(x, sizes, labels, patience=p).scores(other, other_sizes), truth) for p in (quality.PATIENCE, None))
    assert stopped > 0.9 and stopped > full - 0.01
    assert not quality.held_back(np.array([0.0] * 50 + [1.0] * 3)).any()
    assert quality.held_back(np.array([0.0, 1.0] * 40)).sum() == 10


def test_urls_of_a_million_characters(spark):
    long = "http://a.org/" + "ab/c-1" * 170_000
    rows = [(1, long), (2, long), (3, long + "?q"), (4, "http://x.example.com/en/" + "z" * 1_000_000), (5, "http://a.com/b")]
    out = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumns({"url_no": F.lit(1), "grams": F.lit(2)})).collect()}
    assert len(out) == 5 and out[1]["score"] == out[2]["score"] == out[3]["score"] and out[4]["rule"] == "example.com/en/"


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_collocations_add_up_the_shards_of_a_task(most):
    """A task writes each string once, however many shards it has, as long as it can hold them."""
    r = random.Random(4)
    texts = [(r.choice(["en", "de"]), " ".join(r.choices(["a", "b", "c"], k=40))) for _ in range(50)]
    want = Counter()
    for lang, text in texts:
        w = text.split()
        want[lang, "", 0] += len(w)
        want.update((lang, " ".join(w[i : i + k]), k) for k in range(1, 6) for i in range(len(w) - k + 1))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*texts, strict=True)], names=["lang", "text"])
    all_pass = np.full(1 << 13, 255, np.uint8)
    rows = [x for b in collocations.added_up(collocations.shards(iter([batch]), 100), all_pass, most) for x in b.to_pylist()]
    got = Counter()
    for x in rows:
        got[x["lang"], x["phrase"], x["length"]] += x["f"]
    assert got == want and (len(rows) == len(want)) == (most > 3)
