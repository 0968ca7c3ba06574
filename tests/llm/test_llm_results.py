"""Results of the operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from quire.llm import decontamination, jaccard_join, line_dedup, pii, quality, queries, suffix_dedup, token_counts, words
from quire.llm.tokenization import byte_bpe, default_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def hugging():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_words_and_sample_cover():
    texts = ["A b_c Dé", "", "  ", "x" * 50, "ß 中文 1a"]
    h, counts = words.block_words(texts)
    assert counts.tolist() == [len(plain_words(t)) for t in texts]
    h2, _ = words.block_words(["dé a"])
    assert h2[0] == h[3] and h2[1] == h[0]
    x = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    for w in (1, 7, 169):
        assert suffix_dedup.sliding_least(x, w).tolist() == [x[k : k + w].min() for k in range(len(x) - w + 1)]


def test_seeds_miss_no_two_substitutions():
    for gone in itertools.combinations(range(decontamination.WINDOW), 2):
        assert any(not {s + o for o in mask} & set(gone) for mask in decontamination.MASKS for s in range(decontamination.WINDOW - mask[-1]))


def test_quality_on_held_out_labels(spark):
    out = queries.op1_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert len(m) > 30 and (m.predicted == m.quality).mean() >= 0.95
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == h for d, h in zip(out.doc_id, out.held_out, strict=True))


def test_gradients():
    rng = np.random.default_rng(3)
    x, sizes = rng.normal(size=(30, quality.FEATURES)).astype(np.float32), np.array([3] * 10)
    y = (np.add.reduceat(x[:, 0], np.arange(0, 30, 3)) > 0).astype(float)
    model = quality.fit(x, sizes, y, steps=150)
    assert ((model.scores(x, sizes) > 0.5) == y).mean() >= 0.9


def test_gradients_against_differences():
    rng = np.random.default_rng(8)
    x, sizes = rng.normal(size=(23, quality.FEATURES)), np.array([1, 5, 9, 3, 5])
    y = np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    model = quality.fit(x, sizes, y, steps=3)

    def loss():
        p = model.forward(x, sizes)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = quality.gradients(model, x, sizes, y)
    for name, weight in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in weight.shape) for _ in range(6)]:
            kept = weight[at]
            weight[at] = kept + 1e-5
            up = loss()
            weight[at] = kept - 1e-5
            down = loss()
            weight[at] = kept
            assert abs((up - down) / 2e-5 - found[name].reshape(weight.shape)[at]) < 1e-7, (name, at)


def test_ann_recall(spark):
    out = queries.op2_ann(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    hits = []
    for q, g in out.groupby("query_id"):
        score = (x * x[ids == q][0]).sum(1)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits.append(np.isin(ids[best], g.vec_id).mean())
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 21))
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        depth = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                depth[i] += 1
                depth[i + 200] -= 1
        gone = np.cumsum(depth)[:-1] > 0
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abé \n"), 2500))
    texts = []
    for k in range(40):
        a, b = sorted(rng.integers(0, 2500, 2))
        texts.append("".join(rng.choice(list("abc"), rng.integers(0, 300))) + base[a:b] + ("a" * rng.integers(0, 700) if k % 5 == 0 else ""))
    texts += [None, "", texts[3], texts[3], "x" * 199, "y" * 200, "z" * 201, "ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted(brute_repeats(texts))


def test_suffix_dedup_of_long_texts_of_a_short_period(spark):
    texts = [" " * 300_000, "ab" * 100_000 + "c" * 500, "x" + " " * 250, "line of a form\n" * 4000, "unlike " + "".join(chr(97 + k * k % 23) for k in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sampled = list(suffix_dedup._sample_rows(iter([pa.record_batch([pa.array([1, 2]), pa.array([1, 2]), pa.array(texts[:2])], names=["doc", "hash", "text"])])))
    assert sum(b.num_rows for b in sampled) < 400  # not one for each byte
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert [sum(x["end"] - x["start"] for x in out[k]["spans"]) for k in range(5)] == [300_000, 200_500, 250, len(texts[3]), 0]
    assert bytes(out[2]["kept"]) == b"x"


def brute_pii(text):
    out = []
    for kind, p in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans():
    r = random.Random(7)
    for _ in range(8000):
        text = "".join(r.choice("ab1234567890.@+- ()%") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute_pii(text), text


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("write john.smith [at] mail8 [dot] example [dot] com now", "email", "john.smith [at] mail8 [dot] example [dot] com"),
        ("so john dot smith at mail dot example dot com", "email", "so john dot smith at mail dot example dot com"[3:]),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("a\u200bb.c@ex\u200bample.com", "email", "a\u200bb.c@ex\u200bample.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one nine eight eight five five five two four eight five ok", "phone", "plus one nine eight eight five five five two four eight five"),
        ("no four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("at 192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10"),
    ],
)
def test_disguises_map_back(text, kind, shown):
    found = pii.disguised_spans(text, pii.base_spans(text))
    assert [(k, text[a:b]) for a, b, k, _ in found] == [(kind, shown)]


@pytest.mark.parametrize("shown", ["john.smith at example.com", "john_smith at example.com", "john+news at example.com", "a%b at example.com", "j7smith at mail.example.com", "john.smith\nat example.com", "mary.jo at example.com", "john.smith arroba example.com"])
def test_written_at_after_a_local_part(shown):
    text = f"Please write to {shown} today"
    found = pii.disguised_spans(text, pii.base_spans(text))
    assert [(k, text[a:b]) for a, b, k, _ in found] == [("email", shown)]


@pytest.mark.parametrize("text", ["We met at example.com today", "It was the end. at example.com", "A cut of 50% at example.com", "john.smith at home"])
def test_written_at_after_a_word(text):
    assert pii.disguised_spans(text, pii.base_spans(text)) == []


def test_any_text_takes_linear_time():
    started = time.monotonic()
    blanks = " " * 1_000_000
    found = pii.disguised_spans(f"x john{blanks}(at){blanks}mail (dot) example.com y", [])
    assert [(k, v) for _, _, k, v in found] == [("email", "john@mail.example.com")]
    words = "some words of a sentence. " * 770_000  # 20 MB
    text = words + "john (at) mail (dot) example.com " + words[:1000]
    found = pii.disguised_spans(text, pii.base_spans(text))
    assert [text[a:b] for a, b, _, _ in found] == ["john (at) mail (dot) example.com"]
    for shape in ("(at)" + " " * 300_000 + "x " * 50_000, "a" * 1_000_000 + " at b.com", "+1" + "(" * 1_000_000, "[ " * 500_000 + "at", "one " * 300_000, "x@ " * 300_000):
        pii.disguised_spans(shape, pii.base_spans(shape))
    assert time.monotonic() - started < 90


def test_clean_text_has_no_disguises(documents):
    assert sum(len(pii.disguised_spans(t, pii.base_spans(t))) for t in documents.text) == 0


def test_line_dedup(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    chunks = df.select("doc_id", "text", line_dedup.line_chunks(F.col("text")).alias("c")).orderBy("doc_id").collect()
    seen, want = set(), {}
    for r in chunks:
        assert "\n".join(c["chunk"] for c in r["c"]) == r["text"]
        kept = []
        for c in r["c"]:
            if c["n_lines"] >= 2 and c["chunk"].strip():
                if c["chunk"] in seen:
                    continue
                seen.add(c["chunk"])
            kept.append(c["chunk"])
        want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()} == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chunk_starts(lines):
    """Where chunks start, by the rule: local minima of the rolling hash of two line hashes."""
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    r = [signed(xxhash.xxh64_intdigest(struct.pack("<Q", b), 42 if a is None else xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))) for a, b in zip([None, *h], h, strict=False)]
    return [0] + [i for i in range(2, len(r) - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]]


def test_line_chunks_against_a_model(spark, documents):
    r = random.Random(6)
    texts = [t for t in documents.text if t] + ["\n".join(r.choice(["a", "b", "", "c é", "dd"]) for _ in range(n)) for n in range(1, 60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", line_dedup.line_chunks(F.col("t")).alias("c")).collect()
    for x in rows:
        lines = texts[x["k"]].split("\n")
        at = chunk_starts(lines)
        assert [c["chunk"] for c in x["c"]] == ["\n".join(lines[a:b]) for a, b in zip(at, [*at[1:], len(lines)], strict=True)]


def test_line_chunks_resist_shifts(spark):
    lines = [f"line {k * 7919 % 101}" for k in range(60)]
    a, b = "\n".join(lines), "\n".join(["new first line", *lines])
    x, y = ({c["chunk"] for c in r["c"]} for r in spark.createDataFrame([(a,), (b,)], "t string").select(line_dedup.line_chunks(F.col("t")).alias("c")).collect())
    assert len(x & y) >= len(x) - 2


def brute_force_lines(rows):
    """{doc_id: text left} by comparing the texts of all units themselves; ids and texts are distinct."""
    units = []
    for d, text in rows:
        lines = text.split("\n")
        shown = [i for i, line in enumerate(lines) if line.strip()]
        units += [("\n".join(lines[i : j + 1]), d, i, j + 1) for i, j in zip(shown, shown[1:], strict=False)]
        units += [(lines[i], d, i, i + 1) for i in shown if len(lines[i].split()) > 50]
    first, gone = {}, set()
    for unit, d, a, b in sorted(units, key=lambda x: x[1:]):
        fd, fb = first.setdefault(unit, (d, b))
        if (fd, fb) != (d, b) and not (fd == d and fb > a):
            gone |= {(d, i) for i in range(a, b)}
    return {d: "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone) for d, text in rows}


def test_short_repeats_against_brute_force(spark, documents):
    rows = [(d, t) for d, t in zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True) if t is not None]
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short_repeats=True).collect()}
    assert out == brute_force_lines(rows)


def test_short_repeats_go_whatever_stands_around(spark):
    long = " ".join(f"word{k}" for k in range(51))
    shared = {n: [f"shared {n} {k}" for k in range(n)] for n in (2, 3, 4, 5, 6)}
    rows = []
    for n, lines in shared.items():
        for copy in (0, 1):
            rows.append((10 * n + copy, "\n".join([f"a {n} {copy} {k}" for k in range(copy + 3)] + lines + [f"b {n} {copy} {k}" for k in range(4 - copy)])))
    rows += [(100, f"x\n{long}\ny"), (101, f"p\n{long}\nq"), (102, "x\nshort\nz"), (103, "r\nshort\ns"), (110, "A\nA\nA"), (111, "B\nB\nB\nB\nB"), (120, "one\n\ntwo\nthree"), (121, "0\none\n\ntwo\n4")]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short_repeats=True).collect()}
    for n, lines in shared.items():
        assert out[10 * n]["n_removed_lines"] == 0
        assert not set(lines) & set(out[10 * n + 1]["text"].split("\n")) and out[10 * n + 1]["n_removed_lines"] == n and out[10 * n + 1]["n_removed_chunks"] == 1
    want = {100: f"x\n{long}\ny", 101: "p\nq", 102: "x\nshort\nz", 103: "r\nshort\ns", 110: "A\nA\nA", 111: "B\nB", 120: "one\n\ntwo\nthree", 121: "0\n4"}
    assert {d: out[d]["text"] for d in want} == want


def overlapping(texts, items):
    """{(doc_id, item_id)}: windows of 13 words with 11 equal, place by place; the items have 13 words or more."""
    vocabulary: dict[str, int] = {}
    number = lambda ws: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws])
    docs = {d: number(plain_words(t)) for d, t in texts.items()}
    want = set()
    for i, t in items.items():
        b = number(plain_words(t))
        assert len(b) >= 13
        for d, e in docs.items():
            if len(np.intersect1d(e, b)) < 8:
                continue
            for shift in range(13 - len(b), len(e) - 12):
                lo, hi = max(0, shift), min(len(e), len(b) + shift)
                if hi - lo >= 13:
                    c = np.concatenate(([0], np.cumsum(e[lo:hi] == b[lo - shift : hi - shift])))
                    if (c[13:] - c[:-13] >= 11).any():
                        want.add((d, i))
                        break
    return want


def test_decontamination(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    r = random.Random(5)
    extra = []
    for n, t in enumerate(items.text[:12]):  # substituted copies
        w = plain_words(t)
        for k in range(r.randint(0, 12), len(w), 6 + n % 3):
            w[k] = "zzz"
        extra.append((10_000 + n, "start of it " + " ".join(w) + " and an end"))
    texts = dict(zip(documents.doc_id.tolist(), documents.text, strict=True)) | dict(extra)
    want = overlapping(texts, dict(zip(items.item_id.tolist(), items.text, strict=True)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = decontamination.contaminated(df, spark.createDataFrame(items)).collect()
    assert {(x["doc_id"], x["item_id"]) for x in out} == want and len(want) > 10


def test_decontamination_with_a_full_filter(spark, documents, monkeypatch):
    items, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.createDataFrame(documents[["doc_id", "text"]])
    whole = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    kept = {r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()}
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 16)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == whole
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()} == kept == set(documents.doc_id) - {x[0] for x in whole}


def test_decontamination_of_texts_over_several_partitions(spark):
    """Texts weigh far more than what is joined with the items, so that their shuffles are cut apart differently."""
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(5000)]
    items = [(k, " ".join(r.choices(words, k=20))) for k in range(30)]
    texts = [(k, " ".join([*r.choices(words, k=2000), items[k % 30][1] if k % 3 else "", *r.choices(words, k=2000)])) for k in range(300)]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k % 30) for k in range(300) if k % 3}
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(docs, benchmark).collect()} == want
    assert {x["doc_id"] for x in decontamination.decontaminate(docs, benchmark).collect()} == set(range(0, 300, 3))


def best_overlap(doc, item):
    """(start in text, start in item, words, equal words) on all diagonals, word by word."""
    m = len(item)
    window, least = (13, 11) if m >= 13 else (m, m)
    best = None
    for d in range(1 - m, len(doc)):
        lo, hi = max(0, d), min(len(doc), m + d)
        covered = set()
        for s in range(lo, hi - window + 1):
            if sum(doc[p] == item[p - d] for p in range(s, s + window)) >= least:
                covered |= set(range(s, s + window))
        if covered:
            row = (sum(doc[p] == item[p - d] for p in covered), -min(covered), d - min(covered), len(covered))
            best = row if best is None or row > best else best
    return None if best is None else (-best[1], -best[2], best[3], best[0])


def test_short_and_repetitive_items_against_all_diagonals(spark):
    r = random.Random(8)
    texts = [(k, " ".join(r.choice("ab" if k % 3 else "abcdefgh") for _ in range(r.randrange(60)))) for k in range(40)]
    texts += [(41, "a " * 90), (42, "a b " * 40), (43, "x a"), (44, "x a"), (None, "a b c d e")]
    items = [(k, " ".join(r.choice("ab" if k % 2 else "abcdefgh") for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 12, 13, 14, 20, 30])] + [(50, "a " * 40), (51, "h"), (52, "h"), (53, "")]
    got = sorted(map(str, map(tuple, decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())))
    by_text: dict[str, int] = {}
    for i, t in items:
        by_text.setdefault(t, i)
    want = [(d, i, *found) for d, t in texts for w, i in by_text.items() if w.split() and (found := best_overlap(t.split(), w.split()))]
    assert got == sorted(map(str, want)) and len(want) > 100


def test_repetitive_texts_take_bounded_work():
    one = np.full(20_000, 7, np.uint64)
    began = time.time()
    assert decontamination.Text(one).overlap(one[:800]) == (0, 0, 800, 800)
    period = np.tile(np.arange(3, dtype=np.uint64), 7000)
    assert decontamination.Text(period).overlap(period[1:801]) == (1, 0, 800, 800)
    assert time.time() - began < 20


def near_duplicate_links(texts):
    """{doc_id: doc_ids whose five-word shingles have a Jaccard similarity of at least 0.8}."""
    sets = {d: set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w := plain_words(t)) >= 5 else ({tuple(w)} if w else set()) for d, t in texts.items()}
    by_shingle = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by_shingle[g].append(d)
    common = Counter(p for ds in by_shingle.values() for p in itertools.combinations(ds, 2))
    links = {d: set() for d in texts}
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a].add(b)
            links[b].add(a)
    return links


def near_duplicate_classes(texts):
    """{doc_id: the least doc_id that links lead to}."""
    links, out = near_duplicate_links(texts), {}
    for d in sorted(texts):
        todo = [d] if d not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = d
                todo += links[x]
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_jaccard_join(spark, documents, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(2)
    texts = dict(zip(documents.doc_id.tolist(), documents.text, strict=True))
    base = [f"w{r.randint(0, 500)}" for _ in range(150)]
    for k in range(25):  # a large group of near copies, some of them exact
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(len(w))] = f"v{r.randint(0, 9)}"
        texts[5000 + k] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links, classes = near_duplicate_links(texts), near_duplicate_classes(texts)
    for x in jaccard_join.jaccard_join(df).collect():
        d = x["doc_id"]
        assert (x["class_id"], x["n_links"], x["n_linked_docs"]) == (classes[d], len({texts[o] for o in links[d]} - {texts[d]}), len(links[d])), d


def test_packing_is_a_round_trip(spark, documents, hugging):
    out = queries.op9_packing(spark, SF).toPandas()
    ids = {d: np.array([*hugging.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in zip(documents.doc_id, documents.text, strict=True)}
    assert set(out.doc_id) == set(ids)
    for d, g in out.groupby("doc_id"):
        at = 0
        for x in g.sort_values("start").itertuples():
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[d][at : at + x.length].tobytes()) and x.doc_tokens == len(ids[d])
            at += x.length
        assert at == len(ids[d])
    padding = 0
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and (n := g.length.sum()) <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding == 0


def counted(text, offsets, bounds, rule):
    """Tokens per section from offsets of characters, one by one; a token of part of a character covers it."""
    size = lambda a, b: len(text[a:b].encode())
    out = [0] * (len(bounds) - 1)
    for a, b in offsets:
        held = [k for k in range(len(out)) if bounds[k] < b and bounds[k + 1] > a]
        if rule == "majority":
            held.sort(key=lambda k: -size(max(a, bounds[k]), min(b, bounds[k + 1])))  # stable: ties to the earliest
        out[held[-1] if rule == "last" else held[0]] += 1
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, documents, hugging, rule):
    texts = dict(zip(documents.doc_id.tolist(), documents.text, strict=True)) | {9000: "a\n\nb\n   c\n\n\n", 9001: "x" * 300 + "\n" + " y\n" * 50, 9002: "<|endoftext|>\nend"}
    out = token_counts.token_counts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), rule).toPandas()
    crossing = 0
    for d, g in out.groupby("doc_id"):
        g, offsets = g.sort_values("section"), hugging.encode(texts[d], add_special_tokens=False).offsets
        assert g.start.tolist()[1:] == g.end.tolist()[:-1] and g.end.iloc[-1] == len(texts[d]) and "".join(texts[d][a:b] for a, b in zip(g.start, g.end, strict=True)) == texts[d]
        assert g.doc_tokens.iloc[0] == len(offsets) == g.n_tokens.sum()
        assert g.n_tokens.tolist() == counted(texts[d], offsets, [*g.start, len(texts[d])], rule), d
        crossing += g.n_crossing.sum()
    assert crossing > 0


def test_token_counts_of_fields(spark, hugging):
    rows = [(1, "A title", "the body\nof it"), (2, None, "only"), (3, "no body", None), (4, "", "")]
    out = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, title string, text string"), fields=("title", "text")).collect()
    for d, title, text in rows:
        a, b = title or "", text or ""
        g = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["section"])
        whole = f"{a}\n{b}"
        assert [(r["kind"], r["start"], r["end"]) for r in g] == [("title", 0, len(a) + 1), ("text", len(a) + 1, len(whole))]
        assert [r["n_tokens"] for r in g] == [sum(s <= len(a) for s, _ in hugging.encode(whole, add_special_tokens=False).offsets), sum(s > len(a) for s, _ in hugging.encode(whole, add_special_tokens=False).offsets)]


def test_ids_of_odd_texts(hugging):
    bpe = byte_bpe(default_path())
    assert bpe.ids("<|endoftext|> x").tolist() == [50256, 2124] and bpe.lengths[50256] == 13
    for text in ["", " ", "a  b", "\n x", "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n", "x <|endoftext", "é <|endoftext|>é", "é😀中", "w" * 300, " 's it's"]:
        assert bpe.ids(text).tolist() == hugging.encode(text, add_special_tokens=False).ids


def test_decontamination_of_short_items(spark, tmp_path):
    items = [(1, "one two three four five six"), (2, "a b c d"), (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (4, "x y z u v")]
    docs = [(1, "so one two three four five six so"), (2, "a b c d"), (3, "one two three four five"), (4, "One, two; THREE four five six seven eight NO ten eleven no thirteen fourteen"), (5, "x y z u v"), (6, "x y z q v")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = queries.op6_decontamination(spark, str(tmp_path))
    want = c.execute(queries.ORACLE["op6_decontamination"])
    columns = [d[0] for d in want.description]
    rows = sorted(tuple(r[k] for k in columns) for r in found.collect())
    assert rows == sorted(want.fetchall()) and {r[:2] for r in rows} == {(1, 1), (2, 2), (4, 1), (4, 3), (5, 4)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    cursor = c.cursor()
    cursor.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(tuple(r[k] for k in columns) for r in found.collect()) == sorted(cursor.fetchall())
