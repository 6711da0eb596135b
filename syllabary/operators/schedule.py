"""Dated occurrences: weekly slots and date windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = ("start_min", "end_min", "location_id")


def weekday_or_zero(day: Column) -> Column:
    """0 = Monday … 6 = Sunday; 0 without a date."""
    return F.coalesce(F.weekday(day), F.lit(0))


def slot_representatives(events: DataFrame, key: str = "id", slot: Sequence[str] = SLOT) -> DataFrame:
    """The smallest key per (weekday, slot columns). A missing location is a group of its own."""
    return events.groupBy(F.weekday("event_date").alias("weekday"), *slot).agg(F.min(key).alias(key))


def weekly_slots(events: DataFrame, key: str = "id", slot: Sequence[str] = SLOT) -> DataFrame:
    """Collapse dated occurrences to one whole event row per weekly slot, with its weekday.

    The row comes along in the aggregate, so the events are shuffled once and not joined again.
    """
    rest = [c for c in events.columns if c not in {key, *slot}]
    picked = events.groupBy(F.weekday("event_date").alias("weekday"), *slot).agg(
        F.min(F.struct(F.col(key), *[F.col(c) for c in rest])).alias("_row")
    )
    return picked.select(*[
        F.col(c) if c in slot else F.col("_row")[c].alias(c) for c in events.columns
    ], F.coalesce(F.col("weekday"), F.lit(0)).alias("weekday"))


def series_key(links: DataFrame, group: str, member: str) -> DataFrame:
    """A fixed-size fingerprint of each group's member set, equal for equal sets.

    Count, XOR and sum of 64-bit digests replace the sorted list of members, so a group of any size is
    combined before the exchange and never collected.
    """
    digest = F.xxhash64(F.col(member).cast("string"))
    second = F.xxhash64(F.concat(F.col(member).cast("string"), F.lit("#")))
    return (
        links.select(group, member)
        .distinct()
        .groupBy(group)
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("x"), F.sum(second.cast("decimal(20,0)")).alias("s")
            ).alias("series")
        )
    )


def recurring_series(events: DataFrame, links: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Fold events of one (set of courses, weekday, times, location) into weekly series.

    ``events`` needs event_date and the slot columns; ``links`` (course_id, event_id) gives the courses.
    A group is one row with its first event, number of weeks and the skipped weeks. The dates of a group are a set bounded
    by the calendar, not by the number of events.
    """
    if links is not None:
        series = series_key(links, "event_id", "course_id")
        events = events.join(series, F.col(key) == F.col("event_id"), "left").drop("event_id")
    else:
        events = events.withColumn("series", F.lit(None).cast("struct<n:bigint,x:bigint,s:decimal(30,0)>"))
    rest = [c for c in events.columns if c != "series"]
    groups = ["series", F.weekday("event_date").alias("_weekday"), *SLOT]
    folded = events.where(F.col("event_date").isNotNull()).groupBy(*groups).agg(
        F.min_by(F.struct(*rest), F.struct("event_date", key)).alias("_row"),
        F.collect_set("event_date").alias("_dates"),
        F.min("event_date").alias("_first"),
        F.max("event_date").alias("_last"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    weeks = F.floor(F.datediff("_last", "_first") / 7).cast("int") + 1
    expected = F.sequence(F.col("_first"), F.col("_last"), F.expr("interval 7 days"))
    recurring = F.col("occurrences") > 1
    # The weekday is part of the group, so the dates of a group are always whole weeks apart; only events
    # without a date stay single rows.
    series_rows = folded.select(
        *[F.col("_row")[c].alias(c) for c in rest],
        "occurrences",
        F.when(recurring, weeks).alias("weeks"),
        F.when(recurring, F.array_sort(F.array_except(expected, F.col("_dates")))).alias("skipped"),
    )
    undated = events.where(F.col("event_date").isNull()).select(
        *rest,
        F.lit(1).cast("long").alias("occurrences"),
        F.lit(None).cast("int").alias("weeks"),
        F.lit(None).cast("array<date>").alias("skipped"),
    )
    return series_rows.unionByName(undated)


def are_weekly(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Per key: are all sorted gaps between dates whole weeks? Equivalent to one date phase modulo 7."""
    phase = F.pmod(F.unix_date(day), F.lit(7))
    return df.groupBy(*keys).agg(
        (F.min(phase) == F.max(phase)).alias("weekly"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
