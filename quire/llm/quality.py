"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. An encoder maps the features of each passage to
a small vector; gated attention weighs the passages; the weighted sum is scored. Encoder, attention
and scorer are learned together from labels of whole documents. Features describe form only (kinds of
characters, word lengths, repetition), so they hold for any language.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.llm.runtime import small_batches
from quire.llm.words import BLOCK, codes

PASSAGE = 48
#: At most so many labelled documents are learned from, the first by hash of doc_id, each by all passages of
#: its whole text. Only the form features of this sample reach the driver.
MAX_TRAINING_DOCUMENTS = 2000
#: Every so manieth document of the sample is not learned from but tells when to stop: when so many steps
#: have not lowered the log loss on them, learning ends and the weights with the lowest one are taken.
HELD_BACK, PATIENCE, LOOK = 8, 60, 5
_KINDS = 10  # space, lower, upper, other letter, digit, stop, comma, loud, newline, other sign
FEATURES = _KINDS + 9


@functools.cache
def _kind() -> np.ndarray:
    """The kind of each character below 0x10000."""
    out = np.full(0x10000, 9, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.isspace():
            out[c] = 8 if x == "\n" else 0
        elif x.isalpha():
            out[c] = 1 if x.islower() else 2 if x.isupper() else 3
        elif x.isdigit():
            out[c] = 4
        elif x in ".;:":
            out[c] = 5
        elif x == ",":
            out[c] = 6
        elif x in "!?":
            out[c] = 7
    return out


def block_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, one row each, and the number of passages of each text (at least 1)."""
    big = "\n".join(texts)
    words = big.split()
    c = codes(big)
    kind = _kind()[np.minimum(c, 0xFFFF)]
    kind[c > 0xFFFF] = 9
    inside = (kind != 0) & (kind != 8)
    first = inside & ~np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    passages = np.maximum(1, -(-per_text // PASSAGE))
    offset = np.concatenate(([0], np.cumsum(passages)))
    text_of_word = np.repeat(np.arange(len(texts)), per_text)
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    passage_of_word = offset[text_of_word] + rank // PASSAGE
    n, total = len(starts), int(offset[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not n:
        return x, passages
    word_of_char = np.maximum(np.cumsum(first) - 1, 0)
    counts = np.bincount(passage_of_word[word_of_char] * _KINDS + kind, minlength=total * _KINDS).reshape(total, _KINDS)
    size = np.bincount(passage_of_word, minlength=total)
    chars = np.maximum(counts.sum(1), 1)
    some = np.maximum(size, 1)
    x[:, :_KINDS] = counts / chars[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 3], 1)
    lengths = np.bincount(word_of_char[inside], minlength=n)
    h = np.fromiter(map(hash, words), np.int64, n)  # only compared within this process
    grid = np.zeros((total, PASSAGE), np.int64) + np.arange(-PASSAGE, 0)  # padding differs from place to place
    place = rank % PASSAGE
    grid[passage_of_word, place] = h
    ordered = np.sort(grid, axis=1)
    distinct = (ordered[:, 1:] != ordered[:, :-1]).sum(1) + 1 - (PASSAGE - size)
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (passage_of_word[1:] == passage_of_word[:-1])
    by = lambda flag: np.bincount(passage_of_word, weights=flag, minlength=total) / some
    mean = by(lengths)
    x[:, _KINDS + 0] = counts[:, 2] / letters
    x[:, _KINDS + 1] = mean / 10
    x[:, _KINDS + 2] = np.sqrt(np.maximum(by(lengths.astype(float) ** 2) - mean**2, 0)) / 10
    x[:, _KINDS + 3] = np.where(size, distinct / some, 0)
    x[:, _KINDS + 4] = by(same)
    x[:, _KINDS + 5] = by(lengths <= 3)
    x[:, _KINDS + 6] = by(lengths == 1)
    last = np.minimum(starts + lengths - 1, len(kind) - 1)
    x[:, _KINDS + 7] = by((kind[last] == 9) | (kind[last] == 7))
    x[:, _KINDS + 8] = size / PASSAGE
    return x, passages


def feature_blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of consecutive texts in blocks of bounded size; null counts as empty."""
    block, size = [], 0
    for t in texts:
        t = t or ""
        if block and size + len(t) > BLOCK:
            yield block_features(block)
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block_features(block)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Standardisation, encoder, gated attention (v, u, w) and scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bag = np.repeat(np.arange(len(sizes)), sizes)
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(s @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"at": at, "bag": bag, "s": s, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), sizes)["y"]


def gradients(model: Model, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The derivatives of the mean log loss by each weight."""
    weights, f = model.weights, model.forward(x, sizes)
    dy = (f["y"] - labels) / len(labels)
    dz = dy[:, None] * weights["c"]
    dh = f["a"][:, None] * dz[f["bag"]]
    da = (f["h"] * dz[f["bag"]]).sum(1)
    da = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["bag"]])
    tg = f["t"] * f["g"]
    dt = da[:, None] * weights["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = da[:, None] * weights["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh += dt @ weights["v"].T + dg @ weights["u"].T
    ds = dh * (1 - f["h"] ** 2)
    return {"e": f["s"].T @ ds, "eb": ds.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "w": tg.T @ da, "c": f["z"].T @ dy, "b": np.array([dy.sum()])}


def log_loss(scores: np.ndarray, labels: np.ndarray) -> float:
    y = np.clip(scores, 1e-9, 1 - 1e-9)
    return float(-(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean())


def held_back(labels: np.ndarray) -> np.ndarray:
    """Every HELD_BACK-th bag of each label; none if a label has fewer bags than that."""
    out = np.zeros(len(labels), bool)
    for value in np.unique(labels):
        own = np.flatnonzero(labels == value)
        if len(own) < HELD_BACK:
            return np.zeros(len(labels), bool)
        out[own[HELD_BACK - 1 :: HELD_BACK]] = True
    return out


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 250, rate: float = 0.03, decay: float = 1e-4, seed: int = 0, patience: int | None = PATIENCE) -> Model:
    """Learn from bags (rows of x, ``sizes`` rows each) and their labels by Adam on the log loss, in at most
    ``steps`` steps. Every HELD_BACK-th bag of either label is held back; learning ends when the loss on
    those has not fallen for PATIENCE steps, and the best weights are taken. With a sample too small to
    hold both labels back all bags are learned from, in all steps."""
    x = x.astype(np.float64)
    back = held_back(labels)
    if back.any():
        of_bag = np.repeat(back, sizes)
        kept_x, kept_sizes, kept_labels = x[of_bag], sizes[back], labels[back]
        x, sizes, labels = x[~of_bag], sizes[~back], labels[~back]
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"e": draw(x.shape[1], hidden), "eb": np.zeros(hidden), "v": draw(hidden, gate), "u": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1)}
    model = Model(x.mean(0), x.std(0) + 1e-3, weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    best, best_step, best_weights = np.inf, 0, None
    for step in range(1, steps + 1):
        for k, d in gradients(model, x, sizes, labels).items():
            d = d + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if back.any() and step % LOOK == 0:
            loss = log_loss(model.scores(kept_x, kept_sizes), kept_labels)
            if loss < best:
                best, best_step, best_weights = loss, step, {k: w.copy() for k, w in weights.items()}
            elif patience is not None and step - best_step >= patience:
                break
    if best_weights is not None:
        weights.update(best_weights)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_DOCUMENTS) -> Model | None:
    """A model from at most ``most`` labelled documents that are not held out.

    Labels that are null or contradict each other for one document are left out. Only passage features
    of the sample reach the driver. None if there are not both labels among them."""
    known = (
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", F.col("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            quality = np.array(batch.column("quality").to_pylist(), float)
            done = 0
            for x, sizes in feature_blocks(batch.column("text").to_pylist()):
                bags = np.split(x, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_pydict(
                    {"quality": quality[done : done + len(sizes)], "bag": pa.array([b.tobytes() for b in bags], pa.binary())}
                )
                done += len(sizes)

    chosen = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")
    rows = chosen.mapInArrow(features, "quality double, bag binary").collect()
    target = np.array([r["quality"] for r in rows])
    if len(set(target.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    # The same model whatever order rows arrive in; by a hash, so that what is held back is of all kinds.
    order = sorted(range(len(bags)), key=lambda k: (zlib.crc32(rows[k]["bag"]), target[k], rows[k]["bag"]))
    return fit(np.concatenate([bags[k] for k in order]), np.array([len(bags[k]) for k in order]), target[order])


def score_quality(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text; returns the columns ``keep`` (default: all) and score, a double in [0, 1].

    Empty and null texts are one empty passage and get the score the model gives to it; without a
    model every score is 0.5. Rows are scored each on its own; an existing column score is replaced.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c != "score"]
    source = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = source.drop("_text").schema.add("score", DoubleType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            found = [np.full(len(texts), 0.5)] if model is None else [model.scores(x, sizes) for x, sizes in feature_blocks(texts)]
            score = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*keep, "score"])

    return source.mapInArrow(run, schema)
