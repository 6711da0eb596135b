"""From band hashes to verified links and their components, without a pair per two members of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored
from .shingles import mixed

#: A block of a candidate cluster holds about so many members, and so many shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1_000_000
#: Clusters of up to so many members share groups of about so many shingles.
FEW, SHARED_SHINGLES = 16, 250_000
#: Edges of a graph in one part.
EDGES = 250_000


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``limit``; a larger item is a range of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begin = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + limit, "right")))
        yield at, to
        at = to


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (band, id): a row (id, leader, null) for each id after the first of its band, and for the
    first and last band of the partition (null, leader, band), as these may go on in other partitions."""
    schema = pa.schema([("id", pa.int64()), ("leader", pa.int64()), ("band", pa.int64())])
    band = leader = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bands, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.concatenate(([bands[0] != band], bands[1:] != bands[:-1]))
        run = np.cumsum(fresh) - 1  # -1: goes on from the batch before
        leaders = ids[fresh] if leader is None or fresh[0] else np.concatenate((ids[fresh], [leader]))
        own = leaders[run]
        edge = ids != own
        if band is None:
            yield pa.record_batch([[None], [int(own[0])], [int(bands[0])]], schema=schema)
        if edge.any():
            yield pa.record_batch([pa.array(ids[edge]), pa.array(own[edge]), pa.nulls(int(edge.sum()), pa.int64())], schema=schema)
        band, leader = int(bands[-1]), int(own[-1])
    if band is not None:
        yield pa.record_batch([[None], [leader], [band]], schema=schema)


def star_edges(items: DataFrame, name: str) -> DataFrame:
    """(id, leader): each member of a band's bucket with one leader of it. ``items`` has id and an array of band hashes.

    One shuffle by ranges of (band, id): a bucket that holds a third of all rows lies in many tasks, each with a leader of
    its own, and a table of two rows per task joins these.
    """
    rows = items.select(F.explode("bands").alias("band"), "id")
    ranged = rows.repartitionByRange("band", "id").sortWithinPartitions("band", "id")
    found = stored(ranged.mapInArrow(_runs, "id long, leader long, band long"), f"{name}-runs")
    inner = found.where("band is null").select("id", "leader")
    across = found.where("band is not null").groupBy("band").agg(F.collect_set("leader").alias("all"))
    joined = across.select(F.explode("all").alias("id"), F.array_min("all").alias("leader"))
    return inner.unionByName(joined).where("id <> leader")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) of every id on an edge, root the least id of its component: alternating large and small stars.

    Each round links neighbours to the least id that a node sees, first those above the node, then those below; stars
    of the final roots remain after about log(n) rounds. Rounds are written tables, so a lost executor repeats one at most.
    """
    a, b = edges.columns
    current = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), f"{name}-edges"
    )
    mark = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            return current.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            )
        mark = seen
        # As many parts as the edges need, so that the last rounds of a small graph are a few tasks each.
        parts = 1 + seen[0] // EDGES
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(parts, "a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.repartition(parts, "a").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        under = large.join(lowest.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = lowest.select("a", F.col("m").alias("b")).unionByName(under).where("a <> b").repartition(parts, "a")
        current = stored(small.distinct(), f"{name}-stars")


def _held(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the hash, item) of the distinct hashes of each item, in this order."""
    n = max(len(counts), 1)
    order = np.argsort(hashes)
    ordered = hashes[order]
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    # Two sorts of plain numbers, which take a third of one sort by two columns.
    both = np.sort((np.cumsum(fresh) - 1) * n + np.repeat(np.arange(len(counts)), counts)[order])
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    return np.divmod(both[first], n)


def _jaccard_links(hashes: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which (left, right) items have a Jaccard index of their sets of hashes at or above ``threshold``."""
    n = len(counts)
    column, item = _held(hashes, counts)
    sizes = np.bincount(item, minlength=n)
    common = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    item, column = item[common], column[common]
    shared = np.zeros((len(left), len(right)))
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        width = max(1, 4_000_000 // n)
        for at in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, (at, at + width))
            dense = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
            dense[item[lo:hi], column[lo:hi] - at] = 1
            shared += dense[left] @ dense[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0) >= threshold


def _few_links(hashes: np.ndarray, counts: np.ndarray, cluster: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of items of one cluster, many small clusters at once, with a Jaccard index at or above ``threshold``."""
    n = len(counts)
    # Mixed with its cluster, a hash is shared inside the cluster only.
    run, item = _held(hashes ^ np.repeat(mixed(cluster.astype(np.uint64)), counts), counts)
    sizes = np.bincount(item, minlength=n)
    lengths = np.bincount(run)
    start = np.cumsum(lengths) - lengths
    codes = [np.zeros(0, np.int64)]
    for length in range(2, int(lengths.max(initial=0)) + 1):
        runs = item[start[lengths == length][:, None] + np.arange(length)]
        left, right = np.triu_indices(length, 1)
        codes.append((runs[:, left] * n + runs[:, right]).ravel())
    pairs, shared = np.unique(np.concatenate(codes), return_counts=True)
    a, b = pairs // max(n, 1), pairs % max(n, 1)
    linked = shared / (sizes[a] + sizes[b] - shared) >= threshold
    return a[linked], b[linked]


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least item of each item's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


#: Bits of the filter that rows pass before they are sent, and bits in one of its rows.
FILTER_BITS, WORD = 1 << 24, 32


def _bit(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(FILTER_BITS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """Hashes of the keys as a bitmap of at most half a million rows, whatever the number of keys."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % WORD).cast("int"))
    bits = keys.select(_bit(key).alias("_bit")).select(F.floor(F.col("_bit") / WORD).alias("_word"), mask.alias("_mask"))
    return stored(bits.groupBy("_word").agg(F.bit_or("_mask").alias("_mask")), "bitmap")


def marked(rows: DataFrame, bits: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether ``key`` may be one of the bitmap's; false is certain. Only the bitmap is sent."""
    bit, at, word, mask = free(rows, "_bit", "_at", "_word", "_mask")
    placed = rows.withColumn(bit, _bit(key)).withColumn(at, F.floor(F.col(bit) / WORD))
    met = placed.join(F.broadcast(bits.toDF(word, mask)), F.col(at) == F.col(word), "left")
    here = F.call_function("shiftright", F.col(mask), (F.col(bit) % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(here, F.lit(False)).alias(flag))


def prefiltered(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``keys``, and with all others; an exact join has to follow."""
    return marked(rows, bitmap(keys, key), key, "_maybe").where("_maybe").drop("_maybe")


def verified(
    members: DataFrame, texts: DataFrame, shingles: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]], width: int, threshold: float, name: str
) -> DataFrame:
    """(id, links, other): verified links of each id inside its cluster, and an id of its component, by block pair.

    ``members`` has cluster, id, weight (about the number of shingles) and key, ``texts`` key and text, perhaps many rows of
    one key. A cluster is cut into blocks by a hash of the id, and each pair of blocks is one group, so no group grows with
    the cluster; a pair of members meets in exactly one. Small clusters share groups. Texts join by key, by one plan at every
    size: most that nobody asks for are left out by a bitmap first. Links are counted there and never written as pairs.
    """
    members = stored(members, f"{name}-members")
    bodies = prefiltered(texts.select("key", "text"), members, "key").groupBy("key").agg(F.first("text").alias("text"))
    sums = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    small = (blocks == 1) & (F.col("n") <= FEW) & (F.col("w") <= SHARED_SHINGLES / FEW)
    sized = stored(sums.select("cluster", blocks.alias("blocks"), "w", small.alias("small")), f"{name}-sizes")
    together = sized.where("small").agg(F.sum("w")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("cluster"), F.lit(1 + together // SHARED_SHINGLES))
    placed = (
        members.join(sized, "cluster")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.when(F.col("small"), bucket).otherwise(F.col("cluster")).alias("place"), "small", F.least("own", "meets").alias("i"),
            F.greatest("own", "meets").alias("j"), "own", "id", "key", "cluster",
        )
        .join(bodies.hint("merge"), "key")
        .select("place", "small", "i", "j", "own", "id", "cluster", "text")
    )
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
        hashes, counts = shingles(group.column("text").to_pylist(), width)
        if group.column("small")[0].as_py():
            a, b = _few_links(hashes, counts, group.column("cluster").to_numpy(), threshold)
            links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            label = _least_labels(len(ids), a, b)
        else:
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            met = _jaccard_links(hashes, counts, left, right, threshold) & (ids[left][:, None] != ids[right][None, :])
            whole = np.zeros((len(ids), len(ids)), bool)
            whole[np.ix_(left, right)] = met
            if i != j:
                whole[np.ix_(right, left)] = met.T
            links, label = whole.sum(axis=1), _least_labels(len(ids), *np.nonzero(whole))
        some = links > 0
        return pa.table([ids[some], links[some], ids[label][some]], schema=schema)

    found = placed.groupBy("place", "small", "i", "j").applyInArrow(compare, "id long, links long, other long")
    return stored(found, f"{name}-links")
