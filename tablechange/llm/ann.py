"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph; the graph is divided into parts of nearly
equal size that cut few edges; a small network learns which part a vector belongs to. It then places
every vector in its likeliest part and sends each query to as many of its likeliest parts as reach
``aim`` of the true neighbours on sample vectors kept out of the training. What is found there is
reranked by exact distance.

The number of parts goes with the vectors, as far as the sample can tell parts apart. A query whose parts hold
fewer than it asks for is sent to all parts, so no list is short while there are candidates.

Equal vectors are searched once: of each distinct vector only the rows with the smallest ids can be
among the nearest, and a limit per group before the shuffle leaves no more than those. Parts are
dealt out in blocks of vectors and blocks of queries, so a large part is many tasks and no block
outgrows memory. The sample, the network and the sizes of the parts are all that reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablechange.session import discard, materialize

SAMPLE, SAMPLE_MOST, PARTS, PART_VECTORS, AIM = 4_000, 20_000, 16, 20_000, 0.97
BLOCK_VECTORS, BLOCK_QUERIES = 20_000, 20_000
_PER_PART = 50  # sample vectors a part needs at least
_NEIGHBOURS = 10


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(points: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` points nearest to each query, without the point of the same place."""
    out = np.empty((len(queries), k), np.int64)
    norms = (points**2).sum(1)
    for a in range(0, len(queries), 512):
        q = queries[a : a + 512]
        d = norms[None, :] - 2 * q @ points.T
        d[np.arange(len(q)), np.arange(a, a + len(q))] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + len(q)] = part
    return out


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 12) -> np.ndarray:
    """A part per point. Halving along the longest direction gives equal sizes; points then move to
    the part of most of their neighbours, where that leaves sizes within ``slack``."""
    part = np.zeros(len(points), np.int64)
    todo = [(np.arange(len(points)), parts, 0)]
    while todo:
        rows, n, first = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        centred = points[rows] - points[rows].mean(0)
        direction = np.ones(centred.shape[1])
        for _ in range(20):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-300
        order = rows[np.argsort(centred @ direction, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], left, first), (order[cut:], n - left, first + left)]
    most = math.ceil(len(points) / parts * (1 + slack))
    least = math.floor(len(points) / parts * (1 - slack))
    sizes = np.bincount(part, minlength=parts)
    # an edge counts for both of its ends
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(len(points)), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(len(points)), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        pull = np.zeros((len(points), parts))
        np.add.at(pull, (starts, part[ends]), 1)
        gain = pull.max(1) - pull[np.arange(len(points)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(pull[i].argmax())
            if sizes[to] < most and sizes[part[i]] > least:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer that gives the parts of a vector in order of probability."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def ranked(self, vectors: np.ndarray, n: int) -> np.ndarray:
        z = np.maximum(vectors * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def train_router(points: np.ndarray, part: np.ndarray, parts: int, hidden: int = 96, rounds: int = 60, seed: int = 7) -> Router:
    rng = np.random.default_rng(seed)
    scale = 1 / (float(np.sqrt((points**2).mean())) + 1e-300)
    x, y = points * scale, np.eye(parts)[part]
    w = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            rows = order[a : a + 128]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - y[rows]) / len(rows)
            dh = dz @ w[2].T * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ dz + 1e-4 * w[2], dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return Router(scale, *w)


def learn_partitions(points: np.ndarray, parts: int, aim: float = AIM) -> Router:
    """A router over ``parts`` parts. A fifth of the points is kept out of the training and used to
    choose how many parts a query must visit."""
    k = min(_NEIGHBOURS, len(points) - 1)
    if parts < 2 or k < 1:
        size = points.shape[1] if points.ndim == 2 else 1
        return Router(1.0, np.zeros((size, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = nearest(points, points, k)
    part = balanced_parts(points, graph, parts)
    held = np.arange(len(points)) % 5 == 0
    router = train_router(points[~held], part[~held], parts)
    place = router.ranked(points, 1)[:, 0]
    order = router.ranked(points[held], parts)
    rank = np.argsort(order, axis=1)  # rank[i, p]: how many parts come before part p
    found = np.take_along_axis(rank, place[graph[held]], axis=1)
    for n in range(1, parts + 1):
        if (found < n).mean() >= aim or n == parts:
            router.probes = n
            break
    return router


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    parts: int | None = None, sample: int | None = None, aim: float = AIM,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest other rows found for each row for which
    ``queries`` holds, by Euclidean distance in double precision, nearest first, ties to the smaller id.

    The sample for training are the ``sample`` distinct vectors with the smallest hashes (unless given, 50 for each
    part, 4,000 at least and 20,000 at most); every vector is indexed. Unless given, there is a part for each 20,000
    vectors, 16 at least and 400 at most. Vectors that are null, zero or hold a null or a component that is not finite
    take no part, nor do rows with a null id or with another dimension than most rows. Rows that
    repeat an id are other rows only if their vector differs; each of them has its own list. Fewer other rows than ``k``: all of
    them. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"), queries.alias("__q"))
    rows = rows.filter(usable(F.col("__v")) & F.col("__id").isNotNull())
    sizes = rows.groupBy(F.size("__v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if not sizes:
        return empty
    rows = rows.filter(F.size("__v") == sizes[0]["n"])
    # Of equal vectors only the first k + 1 ids can matter: one of them may be the query itself.
    first = F.row_number().over(W.partitionBy("__v").orderBy("__id"))
    points = materialize(rows.select("__id", "__v").dropDuplicates().withColumn("__r", first).filter(F.col("__r") <= k + 1), "points")
    asked = materialize(rows.filter(F.coalesce("__q", F.lit(False))).select("__id", "__v").dropDuplicates(), "queries")
    if parts is None:
        parts = min(max(PARTS, math.ceil(points.count() / PART_VECTORS)), SAMPLE_MOST // _PER_PART)
    if sample is None:
        sample = min(max(SAMPLE, parts * _PER_PART), SAMPLE_MOST)
    few = points.filter("__r = 1").orderBy(F.xxhash64("__v"), "__id").limit(sample).select("__v").collect()
    learned = np.array([r[0] for r in few], np.float64)
    router = learn_partitions(learned, max(1, min(parts, len(learned) // _PER_PART)), aim)
    given = spark.sparkContext.broadcast(router)

    def place(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            part = given.value.ranked(flat, 1)[:, 0] if b.num_rows else np.empty(0, np.int64)
            packed = pa.array([v.tobytes() for v in np.ascontiguousarray(flat)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), packed], names=["part", "id", "v"])

    def route(probes: int):
        def run(batches):
            for b in batches:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                part = given.value.ranked(flat, probes) if b.num_rows else np.empty((0, 1), np.int64)
                at = np.repeat(np.arange(b.num_rows), part.shape[1])
                packed = pa.array([v.tobytes() for v in np.ascontiguousarray(flat)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel(), pa.int32()), b.column(0).take(pa.array(at)), packed.take(pa.array(at))], names=["part", "id", "v"])

        return run

    schema = "part int, id long, v binary"
    placed = materialize(points.select("__id", "__v").mapInArrow(place, schema), "placed")
    # Equal query vectors are searched once, under a number of their own, which is written before it is used.
    distinct = materialize(asked.select("__v").distinct().withColumn("__as", F.monotonically_increasing_id()), "distinct")
    n_points = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}

    def rerank(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = {"as": [], "id": [], "score": []}
        if len(q) and len(p):
            a = np.frombuffer(b"".join(q["v"]), np.float64).reshape(len(q), -1)
            b = np.frombuffer(b"".join(p["v"]), np.float64).reshape(len(p), -1)
            # by a power of two, which changes no digit, so that squares of large components stay finite
            largest = max(np.abs(a).max(), np.abs(b).max())
            shift = math.frexp(largest)[1] if largest > 1e150 else 0
            a, b = np.ldexp(a, -shift), np.ldexp(b, -shift)
            ids, norms = p["id"].to_numpy(), (b**2).sum(1)
            top = min(k + 1, len(b))
            for at in range(0, len(a), 64):
                some = a[at : at + 64]
                rough = (some**2).sum(1)[:, None] + norms[None, :] - 2 * some @ b.T
                # whatever rounding could bring among the first is measured exactly
                edge = np.partition(rough, top - 1, axis=1)[:, top - 1]
                margin = 1e-11 * (norms.max() + (some**2).sum(1))
                for i in range(len(some)):
                    near = np.flatnonzero(rough[i] <= edge[i] + margin[i])
                    exact = np.sqrt(((b[near] - some[i]) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))[:top]
                    out["as"] += [q["id"].iloc[at + i]] * len(best)
                    out["id"] += ids[near[best]].tolist()
                    out["score"] += np.ldexp(exact[best], shift).tolist()
        return pd.DataFrame(out)

    def search(few: DataFrame, probes: int) -> DataFrame:
        """``(as, id, score)``: the nearest ``k + 1`` of the ``probes`` likeliest parts of each of ``few``."""
        routed = materialize(few.select("__as", "__v").mapInArrow(route(probes), schema), "routed")
        n_queries = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
        both = [p for p in n_points if p in n_queries]
        if not both:
            return spark.createDataFrame([], "as long, id long, score double")

        def blocks(rows: dict[int, int], size: int) -> Column:
            return F.create_map(*[x for p in both for x in (F.lit(p), F.lit(math.ceil(rows[p] / size)))])[F.col("part")]

        def block(n: Column) -> Column:
            return F.pmod(F.xxhash64("id"), n).cast("int")

        v_blocks, q_blocks = blocks(n_points, BLOCK_VECTORS), blocks(n_queries, BLOCK_QUERIES)
        right = placed.filter(F.col("part").isin(both)).withColumn("vb", block(v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), q_blocks - 1)))
        left = routed.filter(F.col("part").isin(both)).withColumn("qb", block(q_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), v_blocks - 1)))
        keys = ("part", "qb", "vb")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "as long, id long, score double")
        place_of = F.row_number().over(W.partitionBy("as").orderBy("score", "id"))
        out = materialize(found.withColumn("r", place_of).filter(F.col("r") <= k + 1).select("as", "id", "score"), "found")
        discard(routed)
        return out

    best = search(distinct, router.probes)
    # lists that are short although there are more candidates: all parts
    most = min(k + 1, sum(n_points.values()))
    full = best.groupBy("as").count().filter(F.col("count") >= most).select(F.col("as").alias("__as"))
    short = distinct.join(full, "__as", "left_anti")
    if not short.isEmpty():
        again = search(short, len(router.b2))
        best = best.join(full.withColumnRenamed("__as", "as"), "as", "left_semi").union(again)
    # Back to the queries: each drops itself from the list of its vector.
    named = asked.join(distinct, "__v").select(F.col("__id").alias("query_id"), F.col("__as").alias("as"))
    listed = named.join(best, "as").filter((F.col("query_id") != F.col("id")) | (F.col("score") > 0))
    rank = F.row_number().over(W.partitionBy("query_id", "as").orderBy("score", "id"))
    return listed.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
