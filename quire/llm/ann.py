"""Approximate nearest neighbours by collision counting.

Every shard of vectors keeps one sorted array per single projection. A query opens windows, centred on its
own projected value, in the arrays where it lies farthest from the middle, for these tell most about its
neighbours. The windows are widened bucket by bucket (virtual rehashing); each step counts only what it
adds, and a vector whose collisions reach a threshold is verified with the exact inner product. Widening
ends when a vector as near as the k-th verified one would most likely have passed the threshold, so the
work follows from how near the neighbours are and not from a share of the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import written

#: Sorted arrays of a shard, and in how many of them a query opens a window.
PROJECTIONS, OPENED = 512, 32
#: A vector that lies in this many of the windows is verified.
COLLISIONS = 10
#: Widening ends when a vector as near as the k-th passes with this many standard deviations to spare.
SPARE = 1.0
#: Buckets of an array, over this many standard deviations of a random projection to either side.
BUCKETS, SPREAD = 64, 4.0
#: Vectors of a shard and queries of a block: what one task holds.
SHARD, QUERIES = 16384, 4096
SCHEMA = "query_id long, vec_id long, score double"


def _normal(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to about 0.0002."""
    return 1 / (1 + np.exp(-x * (1.5976 + 0.07056 * x * x)))


class Shard:
    """Sorted projections of the distinct vectors of one shard.

    Vectors are lifted by one coordinate to norm 1, so that the nearest is the one with the largest inner
    product. Copies of a vector are one entry with its ids in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 0):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.flatnonzero(np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1))))
        self.vectors = vectors[first]
        self.ids = [np.unique(x) for x in np.split(ids, first[1:])]
        # The id that an entry counts for; one with several ids always counts.
        self.owner = np.array([x[0] if len(x) == 1 else -1 - k for k, x in enumerate(self.ids)], np.int64)
        self.repeated = len(np.unique(np.concatenate(self.ids))) < sum(map(len, self.ids))
        n, d = self.vectors.shape
        self.largest = np.abs(self.vectors).max()  # before squaring, so that no norm overflows
        scaled = self.vectors / self.largest
        norms = np.sqrt((scaled**2).sum(1))
        self.norm = norms.max()
        self.unit = scaled / self.norm
        lifted = np.concatenate([self.unit, np.sqrt(np.maximum(1 - (norms / self.norm) ** 2, 0))[:, None]], axis=1).astype(np.float32)
        rng = np.random.default_rng(seed)
        turns = -(-PROJECTIONS // (d + 1))
        self.rotation = np.concatenate([np.linalg.qr(rng.normal(size=(d + 1, d + 1)))[0] for _ in range(turns)], axis=1)[:, :PROJECTIONS]
        self.unit = self.unit.astype(np.float32)
        projected = (lifted @ self.rotation.astype(np.float32)).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.width = 2 * SPREAD / BUCKETS / np.sqrt(d)
        edges = ((np.arange(BUCKETS + 1) - BUCKETS // 2) * self.width).astype(np.float32)
        # Where each bucket starts in its sorted array; the outermost buckets are open.
        self.starts = np.stack([np.searchsorted(p[o], edges) for p, o in zip(projected, self.order, strict=True)])
        self.starts[:, 0], self.starts[:, -1] = 0, n
        self.level = BUCKETS // 8

    def candidates(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of the vectors that its windows let pass, with their cosines to the
        query times their norms, as shares of the largest norm, in single precision."""
        asked = queries / np.abs(queries).max(1, keepdims=True)
        asked /= np.sqrt((asked**2).sum(1, keepdims=True))
        at = asked @ self.rotation[:-1]
        opened = np.argsort(-np.abs(at), axis=1, kind="stable")[:, :OPENED]
        return [self._search(int(query_ids[i]), asked[i], opened[i], at[i, opened[i]], k) for i in range(len(asked))]

    def _search(self, query_id: int, query: np.ndarray, arrays: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, d = self.unit.shape
        own = np.clip(np.floor(at / self.width).astype(np.int64) + BUCKETS // 2, 0, BUCKETS - 1)
        need = min(COLLISIONS, len(arrays))
        query = query.astype(np.float32)
        level, counts, low, high = self.level, np.zeros(n, np.int64), None, None
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
        while True:
            left, right = np.maximum(own - level, 0), np.minimum(own + level + 1, BUCKETS)
            new_low, new_high = self.starts[arrays, left].tolist(), self.starts[arrays, right].tolist()
            if low is None:
                added = [self.order[j, a:b] for j, a, b in zip(arrays, new_low, new_high, strict=True)]
            else:
                added = [self.order[j, a:b] for j, a, b in zip(arrays, new_low, low, strict=True)] + [self.order[j, a:b] for j, a, b in zip(arrays, high, new_high, strict=True)]
            more = np.bincount(np.concatenate(added), minlength=n)
            passed = np.flatnonzero((counts + more >= need) & (counts < need))
            counts += more
            places, scores = np.concatenate((places, passed)), np.concatenate((scores, self.unit[passed] @ query))
            counting = self._other(query_id, places, scores) if self.repeated else scores
            if len(counting) > k:  # one more than k, as the query itself may be among them
                kth = float(np.partition(counting, -k - 1)[-k - 1])
                spread = np.sqrt(max(1 - kth * kth, 1e-9) * np.maximum(1 - at * at, 1e-9) / d)
                ends = (np.stack((left, right)) - BUCKETS // 2) * self.width - kth * at
                ends[0][left == 0], ends[1][right == BUCKETS] = -np.inf, np.inf
                chance = _normal(np.clip(ends[1] / spread, -8, 8)) - _normal(np.clip(ends[0] / spread, -8, 8))
                if chance.sum() - need + 0.5 >= SPARE * np.sqrt((chance * (1 - chance)).sum()):
                    break
            if level >= BUCKETS:
                break
            low, high, level = new_low, new_high, level + 1
        # The next query starts where this one ended, or a step before if the first step was enough.
        self.level = level if low is not None else max(1, level - 1)
        return places, scores

    def _other(self, query_id: int, places: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best score of each id but the query's own."""
        order = np.argsort(-scores, kind="stable")
        order = order[self.owner[places[order]] != query_id]
        return scores[order[np.unique(self.owner[places[order]], return_index=True)[1]]]

    def nearest(self, query_id: int, query: np.ndarray, places: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best ids but the query's own among the candidates; ties to the smaller id."""
        best = np.argsort(-rough, kind="stable")
        take = k + 1
        while True:
            # All that single precision cannot tell from the last one taken are compared in double.
            cut = rough[best[min(take, len(best)) - 1]] if len(best) else 0
            near = places[best[: np.searchsorted(-rough[best], -(cut - 1e-5), "right")]]
            # Summed row by row, so equal vectors have equal scores wherever they stand.
            scores = (self.vectors[near] * query).sum(1)
            found = [self.ids[p][: k + 1] if len(self.ids[p]) <= k + 1 else self.ids[p][self.ids[p] != query_id][:k] for p in near]
            ids = np.concatenate(found) if found else np.zeros(0, np.int64)
            score = np.repeat(scores, [len(x) for x in found])
            order = np.lexsort((ids, -score))
            order = order[ids[order] != query_id]
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
            if len(order) == k or len(near) == len(places):
                return ids[order], score[order]
            take *= 2


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _search(k: int, shards: int):
    # Vectors are dealt to shards at random, so of the k nearest of all a shard holds k / shards on average.
    rank = min(k, 4 + -(-2 * k // shards))

    def run(group: pa.Table) -> pa.Table:
        role = group.column("query").to_numpy(zero_copy_only=False)
        ids, vectors = group.column("vec_id").to_numpy(), _matrix(group.column("vector"))
        out = []
        if role.any() and not role.all():
            shard = Shard(ids[~role], vectors[~role])
            order = np.flatnonzero(role)[np.argsort(ids[role], kind="stable")]
            for q, (places, rough) in zip(order.tolist(), shard.candidates(ids[order], vectors[order], rank), strict=True):
                found, score = shard.nearest(int(ids[q]), vectors[q], places, rough, k)
                out.append((np.full(len(found), ids[q]), found, score))
        columns = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2]})

    return run


def nearest_neighbours(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of each row of (vec_id, embedding) for which ``is_query`` holds.

    Nearness is the largest inner product in double precision; ties go to the smaller vec_id. Returns
    query_id, rank (from 1), vec_id, score. Every row is indexed; candidates are all rows but those of
    the query's own vec_id. Rows with a null vec_id, and vectors that are null, zero or hold null or
    non-finite components, take no part; vectors of different dimensions do not meet. Of several vectors
    under one vec_id the least one asks, and as a candidate the vec_id counts once, with its best score.
    A query with fewer candidates gets all; an empty table gives no rows; further columns are ignored.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")).where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    counts = usable.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // SHARD)), max(1, -(-counts["q"] // QUERIES))
    own = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")  # also spreads the vectors of one vec_id
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")
    index = usable.select("vec_id", "vector", F.lit(False).alias("query"), own.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = usable.where("query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asking.select("vec_id", "vector", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))
    met = index.unionByName(asked).withColumn("dimension", F.size("vector")).groupBy("dimension", "shard", "block").applyInArrow(_search(k, shards), SCHEMA)
    found = written(met, "neighbours").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
