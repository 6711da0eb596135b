"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running, stored

SHARDS = 40
#: Rows that the driver holds of the table of group ends: first bins, and bins that one bin is refined into.
FIRST_BINS, REFINED = 16_384, 64


class GroupEnds:
    """Running sums at the ends of the groups, known to the driver by bins: the least and greatest end in each.

    A bin that a search asks about and that has further ends inside is refined by one query for all such bins; the driver
    never holds more than ``FIRST_BINS`` bins and ``REFINED`` for each bin that was asked about, whatever the input.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.wanted: set[tuple[int, int]] = set()
        # Powers of two, so that the bins of a level lie inside those of the level before.
        self.widths = [1 << max(0, (-(-total // FIRST_BINS) - 1).bit_length())]
        while self.widths[-1] > 1:
            self.widths.append(max(1, self.widths[-1] // REFINED))
        self.levels: list[dict[int, tuple[int, int, int]]] = [{} for _ in self.widths]
        self.order: list[tuple[int, int, int, int, int]] = []
        self._read(0, self.ends)

    def _bin(self, level: int):
        return F.floor((F.col("end") - 1) / F.lit(self.widths[level])).cast("long")

    def _read(self, level: int, rows: DataFrame) -> None:
        found = rows.groupBy(self._bin(level).alias("bin")).agg(F.min("end"), F.max("end"), F.countDistinct("end"))
        self.levels[level] |= {r[0]: (r[1], r[2], r[3]) for r in found.collect()}

    def refine(self) -> None:
        for level in sorted({d for d, _ in self.wanted}):
            asked = [(b,) for d, b in self.wanted if d == level]
            parents = F.broadcast(self.ends.sparkSession.createDataFrame(asked, "parent long"))
            self._read(level + 1, self.ends.withColumn("parent", self._bin(level)).join(parents, "parent"))
        self.wanted.clear()
        self.order = []

    def _sorted(self) -> list[tuple[int, int, int, int, int]]:
        """The finest known bins as (least end, greatest end, ends, level, bin), in order."""
        if not self.order:
            refined = [
                {(least - 1) // width for least, _, _ in finer.values()}
                for width, finer in zip(self.widths, self.levels[1:], strict=False)
            ] + [set()]
            self.order = sorted(
                (*ends, level, b) for level, bins in enumerate(self.levels) for b, ends in bins.items() if b not in refined[level]
            )
            self.starts = [x[0] for x in self.order]
        return self.order

    def floor(self, x: int) -> int:
        """The greatest end at or below x (0 if none); a lower bound of it where the bin has to be refined."""
        order = self._sorted()
        i = bisect_right(self.starts, x) - 1
        if i < 0:
            return 0
        least, most, n, level, b = order[i]
        if most <= x:
            return most
        if n > 2:
            self.wanted.add((level, b))
        return least

    def ceil(self, x: int) -> int:
        """The least end at or above x (the total if none); an upper bound where the bin has to be refined."""
        order = self._sorted()
        i = bisect_right(self.starts, x) - 1
        if i >= 0:
            least, most, n, level, b = order[i]
            if least == x or most == x:
                return x
            if most > x:
                if n > 2:
                    self.wanted.add((level, b))
                return most
        return order[i + 1][0] if i + 1 < len(order) else self.total

    def feasible(self, start: int, shards: int, capacity: int) -> bool:
        """Greedy filling from ``start``: does the rest go into so many shards of this capacity?"""
        for _ in range(shards):
            if start >= self.total:
                return True
            after = self.floor(start + capacity)
            if after <= start:
                return False
            start = after
        return start >= self.total


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` contiguous runs of whole groups can keep, and the end of each shard.

    Among the cuts that keep the capacity, each is taken next to an even share of what is left, so that a group above the
    mean doesn't leave empty shards behind it.
    """
    known = GroupEnds(ends, total)
    while True:
        low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if known.feasible(0, shards, middle) else (middle + 1, high)
        cuts, at = [], 0
        for left in range(shards, 0, -1):
            far = known.floor(at + low)
            even = at + -(-(total - at) // left)
            near = sorted({known.floor(even), known.ceil(even), far}, key=lambda c: (abs(c - even), c))
            good = (c for c in near if at < c <= at + low and known.feasible(c, left - 1, low))
            at = next(good, far) if at < total else at
            cuts.append(at)
        if not known.wanted:
            return low, cuts
        known.refine()


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each row with its shard and slot, near equal in bytes; rows of equal text stay in one shard (law ``bytes``).

    Columns: doc_id, size (UTF-8 bytes of the text, none for null, plus 16), text_crc32, law, shard, slot (gapless from
    0), grown_shard (null under this law). Groups are ordered by a SHA-256 of their text and rows inside by doc_id, so
    reruns agree. Null text counts as empty; rows that repeat get slots of their own; other columns are not read. An empty
    table gives no rows; with fewer groups than shards, some shards stay empty. A group above the mean size keeps to one shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_text"),
    )
    rows = stored(rows, "sizes")  # dealing by ranges reads its input twice
    placed = stored(running(rows, ["_text", "doc_id"], {"_bytes": F.col("size"), "_row": F.lit(1)}, name="ordered"), "placed")
    ends = stored(
        placed.groupBy("_text").agg(F.max("_bytes").alias("end"), F.sum("size").alias("bytes")).select("end", "bytes"), "ends"
    )
    total, largest = ends.agg(F.max("end"), F.max("bytes")).first()
    cuts = minimax_cuts(ends, total, largest, shards)[1] if total else [0] * shards
    at = F.array(*(F.lit(c).cast("long") for c in cuts[:-1]))
    number = F.size(F.filter(at, lambda c: c < F.col("_bytes")))
    numbered = placed.withColumn("shard", number.cast("int"))
    first = numbered.groupBy("shard").agg(F.min("_row").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
