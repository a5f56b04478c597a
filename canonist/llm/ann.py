"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them.

The trees are fitted on a bounded sample; every row is indexed. A query enters every tree at once: the queue always opens
the node whose splits the query misses by least, whichever tree it stands in, until it has reached `visits` leaves. What
these leaves hold is ranked by the exact cosine in double precision. The first fifth of the leaves gives each query a bound,
and from the others only candidates that reach it are passed on. Members and queries of a leaf are dealt to blocks of a bounded
size, so a leaf that holds a third of all rows is many groups. Unless given, `visits` is the least number that finds
`recall` of the true neighbours of a bounded number of trial queries, which are held against all rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
vec_id, nor vectors of another length than the commonest (the shorter one, if as common). Equal query vectors are searched
once; of equal vectors only the k + 1 smallest ids are indexed: no other could be among k nearest. With fewer than k
candidates all are returned; without usable vectors or queries there are no rows. Rows repeated under one vec_id are one
candidate, the nearest of them. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE = 20_000
TREES = 8
LEAF = 256
RECALL = 0.96
TRIALS = 96
BLOCK = 2048
FIRST = 0.2  # share of a query's leaves that give its bound


def usable(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, v of the rows that may take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and size(v) > 0")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


class Forest:
    """Complete trees of one depth: node i has children 2i + 1 and 2i + 2; directions and thresholds by tree and node."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 3):
        rng, inner = np.random.default_rng(seed), 2**depth - 1
        self.depth, self.dirs, self.cuts = depth, np.zeros((trees, inner, sample.shape[1]), np.float32), np.zeros((trees, inner), np.float32)
        for t in range(trees):
            rows = [np.arange(len(sample))]
            for i in range(inner):
                own = rows[i]
                picks = sample[rng.choice(own, 2)] if len(own) > 1 else rng.normal(size=(2, sample.shape[1]))
                way = picks[0] - picks[1] if (picks[0] != picks[1]).any() else rng.normal(size=sample.shape[1])
                way = way / np.linalg.norm(way)
                far = sample[own] @ way
                cut = np.median(far) if len(own) else 0.0
                self.dirs[t, i], self.cuts[t, i] = way, cut
                right = far > cut
                rows += [own[~right], own[right]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every row of x in every tree."""
        x, out = x.astype(np.float32), np.zeros((len(x), len(self.dirs)), np.int64)
        for t, (dirs, cuts) in enumerate(zip(self.dirs, self.cuts, strict=True)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("nd,nd->n", x, dirs[at]) > cuts[at])
            out[:, t] = at - (2**self.depth - 1)
        return out

    def visit(self, x: np.ndarray, visits: int) -> Iterator[list[tuple[int, int]]]:
        """(tree, leaf) pairs for every row of x, nearest first, from one queue over all trees."""
        inner = 2**self.depth - 1
        margins = np.einsum("nd,tid->nti", x.astype(np.float32), self.dirs) - self.cuts if inner else np.zeros((len(x), len(self.dirs), 0))
        for of in margins.tolist():
            queue, got = [(0.0, t, 0) for t in range(len(of))], []
            while queue and len(got) < visits:
                miss, t, i = heapq.heappop(queue)
                own = of[t]
                while i < inner:
                    m = own[i]
                    heapq.heappush(queue, (max(miss, abs(m)), t, 2 * i + 1 + (m <= 0)))
                    i = 2 * i + 1 + (m > 0)
                got.append((t, i - inner))
            yield got


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(q: np.ndarray, m: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of m, cosine) of the k nearest of m for each q that reach its bound; ties to the smaller id. The products
    of whole blocks only choose; the cosines are made pair by pair, alike wherever a pair meets."""
    scores = unit(q) @ unit(m).T
    least = np.partition(scores, -k, axis=1)[:, -k] if len(m) > k else np.full(len(q), -2.0)
    at, of = np.nonzero(scores >= np.maximum(least, bound)[:, None] - 1e-12)
    exact = np.einsum("pd,pd->p", q[at], m[of]) / (np.sqrt(np.einsum("qd,qd->q", q, q))[at] * np.sqrt(np.einsum("md,md->m", m, m))[of])
    order = np.lexsort((ids[of], -exact, at))
    at, of, exact = at[order], of[order], exact[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], of[nth < k], exact[nth < k]


def enough(forest: Forest, rows: DataFrame, trial: np.ndarray, k: int, recall: float) -> int:
    """How many leaves to visit so that this share of the trial vectors' k nearest rows (the vector itself aside) is met."""
    kind = dict(rows.dtypes)["v"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                own = (unit(trial) @ unit(v).T > 1 - 1e-9).sum(axis=1).max()
                at, of, scores = best_of(trial, v, np.arange(len(v)), np.full(len(trial), -2.0), k + int(own))
                keep = scores <= 1 - 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(at[keep], pa.int32()), pa.array(scores[keep]), batch.column("v").take(pa.array(of[keep]))], ["trial", "score", "v"])

    found = rows.select("v").mapInArrow(rank, f"trial int, score double, v {kind}")
    first = Window.partitionBy("trial").orderBy(F.desc("score"))
    near = found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).select("trial", "v").collect()
    if not near:
        return 1
    order = [{place: nth for nth, place in enumerate(places)} for places in forest.visit(unit(trial), 2**62)]
    leaves = forest.leaves(unit(np.asarray([r["v"] for r in near], np.float64)))
    met = sorted(min(order[r["trial"]][t, int(i)] for t, i in enumerate(own)) for r, own in zip(near, leaves, strict=True))
    return 1 + met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, trials: int = TRIALS, visits: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) the k nearest of vectors under other ids."""
    spark = vectors.sparkSession
    scratch, kind = Scratch(spark), "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = scratch.stored(usable(vectors, kind), "vectors")
    told = rows.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", -F.col("d"))).alias("d"), F.sum("count").alias("n")).first()
    d, n = told["d"] or 0, told["n"] or 0
    rows = rows.filter(F.size("v") == d)
    ids = scratch.stored(usable(queries, kind).filter(F.size("v") == d).groupBy("v").agg(F.min("vec_id").alias("query"), F.collect_set("vec_id").alias("ids")), "queries")
    asked = ids.select("query", "v").repartition(max(1, min(4096, ids.count() // 64)), "query")
    some = np.asarray([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()], np.float64)
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / leaf, len(some) / 8))))))
    model = Forest(unit(some) if n else np.zeros((0, 1)), trees, depth)
    visits = visits or (enough(model, rows, some[:trials], k, recall) if depth else trees)
    forest = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = forest.value.leaves(unit(matrix(batch.column("v"))))
                again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array((np.arange(at.shape[1]) * 2**40 + at).ravel())], ["vec_id", "v", "place"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                found = list(forest.value.visit(unit(matrix(part.column("v"))), visits))
                again = part.take(pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found])))
                place, nth = [t * 2**40 + i for f in found for t, i in f], [n for f in found for n in range(len(f))]
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(place, pa.int64()), pa.array(nth, pa.int32())], ["query", "v", "place", "nth"])

    few = Window.partitionBy("v").orderBy("vec_id")
    members = rows.dropDuplicates().withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= k + 1).select("vec_id", "v").mapInArrow(index, f"vec_id long, v {kind}, place long")
    members = scratch.stored(members, "members")
    visited = scratch.stored(asked.mapInArrow(search, f"query long, v {kind}, place long, nth int"), "visits")

    def rank(held: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if held.num_rows and queries.num_rows:
            ids, m = held["vec_id"].to_numpy(), matrix(held["v"])
            at, of, scores = best_of(matrix(queries["v"]), m, ids, queries["bound"].to_numpy(), k + 1)
            out = [queries["query"].to_numpy()[at], ids[of], scores]
        return pa.table(out, ["query", "vec_id", "score"])

    def ranked(asked: DataFrame) -> DataFrame:
        """query, vec_id, score of what the leaves of asked (query, v, place, bound) hold, k + 1 a block at most."""
        held = members.groupBy("place").agg(F.ceil(F.count("place") / block).cast("int").alias("mb"))
        grid = held.join(asked.groupBy("place").agg(F.ceil(F.count("place") / block).cast("int").alias("qb")), "place")
        left = members.join(grid, "place").withColumn("m", F.pmod(F.xxhash64("vec_id"), "mb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("place", "m", F.col("q").cast("long").alias("q"), "vec_id", "v")
        right = asked.join(grid, "place").withColumn("q", F.pmod(F.xxhash64("query"), "qb")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select("place", F.col("m").cast("long").alias("m"), "q", "query", "v", "bound")
        return left.groupBy("place", "m", "q").cogroup(right.groupBy("place", "m", "q")).applyInArrow(rank, "query long, vec_id long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)

    first = F.col("nth") < max(trees, int(FIRST * visits))
    near = scratch.stored(top(ranked(visited.filter(first).withColumn("bound", F.lit(-2.0)))).drop("nth"), "near")
    bounds = near.groupBy("query").agg(F.when(F.count("score") > k, F.min("score")).alias("bound"))
    rest = visited.filter(~first).join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    near = scratch.stored(top(near.unionByName(ranked(rest))).drop("nth"), "nearest")
    scratch.drop("vectors", "members", "visits", "near")
    each = ids.select("query", F.explode("ids").alias("query_id")).join(near, "query").filter("vec_id != query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
