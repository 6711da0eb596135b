"""Groups that lie in several ranges: what a range has to know about its neighbours, and hashes over groups in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of joined pieces that are passed on at once for a group that may go on in another range.
CHUNK = 256 * 1024


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` by ranges of (keys, order), written; ``_range`` numbers them. A group that holds most rows lies in many."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), name)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of the columns ``keys`` of ``left`` with those named ``_k_<key>`` of ``right``, null like any value."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_k_{k}"])
    return out


def spanning(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_k_<key>...) of the groups in more than one range: fewer than there are ranges, as each is the last of one and the
    first of another."""
    key = F.struct(*keys)
    ends = stored(ranged.groupBy("_range").agg(F.min(key).alias("first"), F.max(key).alias("last")), "range-ends")
    firsts = ends.select(F.col("_range").alias("_to"), "first")
    both = ends.select("_range", "last").join(firsts, (F.col("last") == F.col("first")) & (F.col("_range") < F.col("_to")))
    return both.select(*(F.col(f"last.{k}").alias(f"_k_{k}") for k in keys)).distinct()


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``first``, the least ``value`` of the row's group; no task needs all rows of a group.

    Ranges find their own least value; only for the groups that lie in several ranges, fewer than there are ranges, a
    table of the least one of all is sent to each task."""
    ranged = dealt(df.withColumn("_value", value), keys, order, name)
    local = ranged.withColumn("_own", F.min("_value").over(Window.partitionBy("_range", *keys)))
    wide = spanning(ranged, keys)
    least = ranged.join(F.broadcast(wide), same(ranged, wide, keys)).groupBy(*wide.columns).agg(F.min("_value").alias("_least"))
    return local.join(F.broadcast(least), same(local, least, keys), "left").select(
        *(F.col(f"`{c}`") for c in df.columns), F.coalesce("_least", "_own").alias("first")
    )


def carried(ranged: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """(_k_<key>..., _at, <sum>...): what earlier ranges hold of a group, for the groups in several ranges and each of
    these; at most two groups of a range, so fewer than twice as many rows as ranges."""
    wide = spanning(ranged, keys)
    totals = ranged.join(F.broadcast(wide), same(ranged, wide, keys)).groupBy(*wide.columns, F.col("_range").alias("_at"))
    earlier = Window.partitionBy(*wide.columns).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return totals.agg(*(c.alias(k) for k, c in sums.items())).select(
        *wide.columns, "_at", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums)
    )


def _cut(separator: bytes):
    """Over rows (group, piece) sorted by group: (group, sha, null, null) for each group that is short and whole here, and
    numbered chunks (group, null, part, piece) of the others: long ones, and the first and last of the partition."""
    schema = pa.schema([("group", pa.binary()), ("sha", pa.binary()), ("part", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, part, held, buffer, rows = None, True, 0, 0, [], []
        for batch in batches:
            for group, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != current:
                    if buffer and (first or part):
                        rows.append((current, None, part, separator.join(buffer)))
                    elif buffer:
                        rows.append((current, hashlib.sha256(separator.join(buffer)).digest(), None, None))
                    first = first and current is None
                    current, part, held, buffer = group, 0, 0, []
                elif held >= CHUNK:
                    rows.append((current, None, part, separator.join(buffer)))
                    part, held, buffer = part + 1, 0, []
                    yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)
                    rows = []
                buffer.append(piece)
                held += len(piece)
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if buffer:
            yield pa.record_batch([[current], [None], [part], [separator.join(buffer)]], schema=schema)

    return run


def _hashed(separator: bytes):
    """Over rows (group, piece) sorted by group: (group, sha), holding one piece at a time."""
    schema = pa.schema([("group", pa.binary()), ("sha", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, groups, digests = None, None, [], []
        for batch in batches:
            for group, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != current:
                    if state is not None:
                        groups.append(current)
                        digests.append(state.digest())
                    current, state = group, hashlib.sha256(piece)
                else:
                    state.update(separator)
                    state.update(piece)
            yield pa.record_batch([groups, digests], schema=schema)
            groups, digests = [], []
        if state is not None:
            yield pa.record_batch([[current], [state.digest()]], schema=schema)

    return run


def joined_sha256(df: DataFrame, group: str, order: Sequence[str], piece: str, separator: str, name: str) -> DataFrame:
    """(group, sha): lower-case hex SHA-256 of each group's pieces in ``order``, joined by ``separator``.

    ``group`` and ``piece`` are binary columns without nulls. Rows are dealt by ranges of (group, order); a range hashes the
    groups of up to a chunk that it holds whole, and sends the others on as joined chunks. Those are hashed chunk by
    chunk, one task a group, as SHA-256 cannot be split; that task never holds more than a chunk or one piece.
    """
    mark = separator.encode()
    named = df.select(F.col(group).alias("group"), *order, F.col(piece).alias("piece"))
    rows = named.repartitionByRange("group", *order).sortWithinPartitions("group", *order).select("group", "piece")
    cut = rows.mapInArrow(_cut(mark), "group binary, sha binary, part long, piece binary")
    found = stored(cut.withColumn("_range", F.spark_partition_id()), name)
    parts = found.where("part is not null").repartition("group").sortWithinPartitions("group", "_range", "part")
    rest = parts.select("group", "piece").mapInArrow(_hashed(mark), "group binary, sha binary")
    return found.where("sha is not null").select("group", "sha").unionByName(rest).select("group", F.lower(F.hex("sha")).alias("sha"))
