"""Pages of a large sorted result from a rank index: sorted ranges with their counts, of which a page reads those it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.operators.ordering import order_columns
from syllabary.session import written

@dataclass(frozen=True)
class RankIndex:
    """Rows dealt by ranges of the order (one folder each, named by the column ``mark``), and per range its number, count and last keys.

    ``ranges`` has one row per range, so what the driver reads of it is bounded by the number of ranges.
    """

    rows: DataFrame
    ranges: DataFrame
    mark: str
    keys: Sequence[str]
    descending: bool
    counts: Sequence[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def _order(self, df: DataFrame) -> list[Column]:
        sort, *tie = self.keys
        return order_columns(df, sort, "desc" if self.descending else "asc", tie[0] if tie else None)

    def touched(self, skip: int, n: int) -> tuple[list[int], int]:
        """The ranges that hold the rows from ``skip`` to ``skip + n``, and how many rows the first of them skips."""
        wanted, inner, begin = [], 0, 0
        for number, rows in self.counts:
            if begin < skip + n and skip < begin + rows:
                if not wanted:
                    inner = skip - begin
                wanted.append(number)
            begin += rows
        return wanted, max(inner, 0)

    def _first(self, wanted: list[int], skip: int, n: int, rows: DataFrame) -> DataFrame:
        some = rows.where(F.col(self.mark).isin(wanted)) if wanted else rows.where(F.lit(False))
        ordered = some.orderBy(*self._order(rows))
        return (ordered.offset(skip) if skip else ordered).limit(n).drop(self.mark)

    def page(self, page: int, page_size: int) -> DataFrame:
        """Page number ``page`` (from 1), in order. Only ranges that the page touches are read."""
        if page < 1 or page_size < 1:
            raise ValueError("pages and their sizes start at 1")
        wanted, inner = self.touched((page - 1) * page_size, page_size)
        return self._first(wanted, inner, page_size, self.rows)

    def _beyond(self, token: Sequence[object], columns: Sequence[Column]) -> Column:
        """Whether a row comes after the token's in the order: NULL is the smallest value, the tie-break ascends."""

        def later(column: Column, value: object, descending: bool) -> Column:
            if value is None:
                return F.lit(False) if descending else column.isNotNull()
            return column.isNull() | (column < F.lit(value)) if descending else column > F.lit(value)

        after = F.coalesce(later(columns[0], token[0], self.descending), F.lit(False))
        if len(columns) > 1:
            after = after | (columns[0].eqNullSafe(F.lit(token[0])) & F.coalesce(later(columns[1], token[1], False), F.lit(False)))
        return after

    def after(self, token: Sequence[object], n: int) -> DataFrame:
        """The ``n`` rows after the one with the keys ``token``, whether or not that row is still there.

        Ranges that end at or before the token are left out, and so are those beyond the ones that surely hold ``n``.
        """
        if len(token) != len(self.keys):
            raise ValueError(f"a token has the values of {list(self.keys)}")
        last = [F.col("last")[k] for k in self.keys]
        live = {r["range"] for r in self.ranges.where(self._beyond(token, last)).select("range").collect()}
        wanted, sure = [], 0
        for i, (number, rows) in enumerate((c for c in self.counts if c[0] in live)):
            if sure >= n:
                break
            wanted.append(number)
            sure += rows if i else 0  # the first range may hold as little as one row after the token
        return self._first(wanted, 0, n, self.rows.where(self._beyond(token, [F.col(k) for k in self.keys])))


def rank_index(
    df: DataFrame, sort: str | None = None, order: str = "asc", tie: str | None = "id", ranges: int | None = None
) -> RankIndex:
    """Sorts ``df`` once, by ranges of (sort, tie), so that any page of it can be read by its place or after a row.

    The order is that of `ordering.page`. Ranges are of (sort, tie), so a sort value that many rows have is spread. Rows equal in
    both come in any order among pages by place, and are passed together by `RankIndex.after`. Unknown sort columns are ignored,
    as there; Spark merges small ranges unless their number ``ranges`` is given. Without
    any key there is no order, which is an error. An empty table has no ranges and empty pages. Other columns may have any name.
    """
    by = order_columns(df, sort, order, tie)
    if not by:
        raise ValueError("a rank index needs a sort column or a tie-break")
    keys = [k for k in dict.fromkeys((sort, tie)) if k and k in df.columns]
    descending = order == "desc" and keys[0] == sort
    mark = "_range"
    while mark in (c.lower() for c in df.columns):
        mark = f"_{mark}"
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    rows = written(dealt.withColumn(mark, F.spark_partition_id()), mark)
    # The last keys by the same order: the greatest ones, but the least sort value, NULL after it, where that descends.
    placed = rows.select(F.col(mark).alias("range"), F.struct(*keys).alias("key"))
    sums = [F.count(F.lit(1)).alias("n")]
    if descending:
        value = F.col("key")[keys[0]]
        low = placed.groupBy("range").agg(*sums, F.max(value.isNull()).alias("open"), F.min(value).alias("low"))
        low = low.select(F.col("range").alias("r"), "n", F.when(~F.col("open"), F.col("low")).alias("low"))
        met = placed.join(low, (F.col("range") == F.col("r")) & value.eqNullSafe(F.col("low")))
        ends = met.groupBy("range").agg(F.max("n").alias("n"), F.max("key").alias("last"))
    else:
        ends = placed.groupBy("range").agg(*sums, F.max("key").alias("last"))
    ends = written(ends)
    counts = [(r["range"], r["n"]) for r in ends.select("range", "n").orderBy("range").collect()]
    return RankIndex(rows, ends, mark, keys, descending, counts)
