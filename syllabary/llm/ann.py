"""Nearest neighbours by learned partitions: a neighbour graph cut into balanced parts, and a classifier that routes to them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that the partitions are fitted on, the most of them on large tables, and further ones that the number of probes
#: is chosen on: those whose vec_id has the least hash.
SAMPLE, MOST_SAMPLE, HELD_OUT = 8_192, 20_480, 1_024
NEIGHBOURS = 10
#: Vectors that a part is meant to hold, the least number of parts, and the sample vectors that a part needs.
PART_SIZE, FEWEST, PER_PART = 1_024, 8, 4 * NEIGHBOURS
#: Share of true neighbours that the probed parts have to hold on the held-out vectors.
RECALL = 0.98
#: Candidates and queries that meet in one task at a time.
CHUNK, QUERIES = 4_096, 512


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Numbers of the k nearest rows of each query, in any order."""
    out = np.empty((len(queries), k), np.int64)
    norms = (rows**2).sum(axis=1)
    step = max(1, (1 << 23) // max(len(rows), 1))
    for a in range(0, len(queries), step):
        part = norms[None, :] - 2 * queries[a : a + step] @ rows.T
        if skip_self:
            part[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
        out[a : a + step] = np.argpartition(part, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Part of each node of a neighbour graph (row: neighbours of a node), parts as even as can be, few edges between.

    Nodes are halved again and again: by the slow vector of the graph's random walk, cut at its median, and then by
    exchanges of the pairs of nodes that save most edges. ``parts`` is a power of two.
    """
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    label = np.zeros(n, np.int64)
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    source, target = np.concatenate((source, target)), np.concatenate((target, source))
    while label.max(initial=0) + 1 < parts:
        inner = label[source] == label[target]
        a, b = source[inner], target[inner]
        degree = np.maximum(np.bincount(a, minlength=n), 1)
        sizes = np.bincount(label)
        value = rng.standard_normal(n)
        for _ in range(60):
            value = (value + np.bincount(a, value[b], minlength=n) / degree) / 2
            value -= (np.bincount(label, value) / sizes)[label]
            value /= np.sqrt(np.bincount(label, value**2) / sizes + 1e-30)[label]
        order = np.lexsort((value, label))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        side = place >= (sizes // 2)[label]
        for _ in range(8):
            across = np.bincount(a, side[a] != side[b], minlength=n)
            gain = 2 * across - np.bincount(a, minlength=n)
            moved = False
            for part in range(len(sizes)):
                own = np.flatnonzero(label == part)
                left, right = own[~side[own]], own[side[own]]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                swaps = int(((gain[left[:m]] + gain[right[:m]]) > 0).sum()) // 2
                if swaps:
                    side[left[:swaps]], side[right[:swaps]] = True, False
                    moved = True
            if not moved:
                break
        label = 2 * label + side
    return label


@dataclass
class Router:
    """A network of one hidden layer that gives the probability that a vector's neighbours lie in each part."""

    mean: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, aims: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 1) -> Router:
    """Fits a router to the shares of each vector's neighbours in the parts, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), max(float(x.std()), 1e-12)
    d, parts = x.shape[1], aims.shape[1]
    layers = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    scaled, step = (x - mean) / scale, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows, step = order[at : at + 256], step + 1
            inner = np.maximum(scaled[rows] @ layers[0] + layers[1], 0)
            z = inner @ layers[2] + layers[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - aims[rows]) / len(rows)
            back = error @ layers[2].T * (inner > 0)
            grads = [scaled[rows].T @ back, back.sum(axis=0), inner.T @ error, error.sum(axis=0)]
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            for w, g, m, v in zip(layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, layers)


def fit(sample: np.ndarray, held_out: np.ndarray, rows: int, recall: float = RECALL) -> Router:
    """Graph, parts and router on a sample; the probes are the fewest that hold ``recall`` of the neighbours of held-out vectors.

    The parts grow with the table, as far as the sample has ``PER_PART`` vectors for each.
    """
    parts = 1 << int(max(np.log2(max(rows, 1) / PART_SIZE), np.log2(FEWEST)))
    while parts > 1 and len(sample) < PER_PART * parts:
        parts //= 2
    k = min(NEIGHBOURS, len(sample) - 1)
    if parts == 1 or k < 1:
        d = sample.shape[1]
        return Router(np.zeros(d), 1.0, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = nearest(sample, sample, k, skip_self=True)
    label = balanced_parts(graph, parts)
    near = np.concatenate((label[:, None], label[graph]), axis=1)
    aims = np.stack([(near == p).mean(axis=1) for p in range(parts)], axis=1)
    router = train(sample, aims)
    router.probes = parts
    if len(held_out):
        put = router.scores(sample).argmax(axis=1)
        wanted = put[nearest(held_out, sample, k)]
        ranks = np.argsort(np.argsort(-router.scores(held_out), axis=1, kind="stable"), axis=1)
        found = np.take_along_axis(ranks, wanted, axis=1)
        shares = [(found < p).mean() for p in range(1, parts + 1)]
        router.probes = 1 + int(np.argmax(np.array(shares) >= recall))
    return router


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~wrong & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, d)


def search(vectors: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE, held_out: int = HELD_OUT, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id; nearness is
    the least Euclidean distance, computed in double precision on the original vectors. Every row is put in the part its
    router score is highest for, and each query looks at all rows of its most probable parts. Parts are cut into chunks
    by a hash of vec_id, and the queries of a part into blocks, so the rows that meet in a task are bounded however many
    vectors are alike; a query keeps k rows of each chunk.

    Vectors null, zero or with a null or non-finite component, rows without vec_id and vectors of another length than the most common
    take no part. Repeated rows are candidates each. With less than k candidates all found are returned; an empty table gives
    no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    d, n = sizes
    rows = rows.where(F.size("v") == d)
    sample = max(sample, min(MOST_SAMPLE, PER_PART * (n // PART_SIZE)))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample + held_out).select("v").collect()
    known = np.array([r["v"] for r in picked])
    share = max(1, len(known) * sample // (sample + held_out))
    router = fit(known[:share], known[share:], n, recall)
    parts = len(router.layers[3])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            scores = router.scores(_matrix(batch.column(1), d)) if len(ids) else np.zeros((0, parts))
            best = np.argsort(-scores, axis=1, kind="stable")[:, : router.probes].astype(np.int32)
            asks = ids % every == 0
            probes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(asks * router.probes))).astype(np.int32)), pa.array(best[asks].ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(best[:, 0] if len(ids) else np.zeros(0, np.int32)), probes], names=["vec_id", "v", "part", "probes"])

    put = stored(rows.mapInArrow(route, "vec_id long, v array<double>, part int, probes array<int>"), "routed")
    asked = put.where(F.size("probes") > 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("probes").alias("part"))
    held = put.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    routed = asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    # At most one row per part, so the broadcast is bounded.
    chunks = {r["part"]: -(-r["n"] // CHUNK) for r in held}
    blocks = {r["part"]: -(-r["n"] // QUERIES) for r in routed}
    both = [(p, chunks[p], blocks[p]) for p in chunks if p in blocks]
    if not both:
        return spark.createDataFrame([], result)
    dealt = F.broadcast(spark.createDataFrame(both, "part int, chunks int, blocks int"))
    own = lambda key, count: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    candidates = put.join(dealt, "part").select("part", own("vec_id", "chunks").alias("chunk"), each("blocks").alias("block"), "vec_id", "v")
    queries = asked.join(dealt, "part").select("part", each("chunks").alias("chunk"), own("query_id", "blocks").alias("block"), "query_id", "q")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        ids, query_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        x, q = _matrix(left.column("v").combine_chunks(), d), _matrix(right.column("q").combine_chunks(), d)
        lengths, own_lengths = (x**2).sum(axis=1), (q**2).sum(axis=1)
        out = []
        for i, query in enumerate(query_ids):
            rough = lengths - 2 * x @ q[i] + own_lengths[i]
            rough[ids == query] = np.inf
            most = min(k, int(np.isfinite(rough).sum()))
            if not most:
                continue
            slack = 1e-9 * (lengths.max() + own_lengths[i])  # far above the rounding of the rough distances
            near = np.flatnonzero(rough <= np.partition(rough, most - 1)[most - 1] + slack)
            exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))[:most]
            out.append((np.full(most, query), ids[near[best]], exact[best]))
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    keys = ("part", "chunk", "block")
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
