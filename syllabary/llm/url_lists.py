"""URL filters: dated list entries become validity intervals, and each capture meets those that held when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: End of an interval that nothing has ended yet.
OPEN = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dots; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.rtrim(F.lower(authority), F.lit("."))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an absolute URL without query and fragment; '/' if it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def patterns_of(url: Column, labels: int, segments: int) -> Column:
    """What may be on a list for a URL: each suffix of its host by labels ('b.com'), and the host with leading path
    segments ('a.b.com/x/'), as (pattern, depth) from the widest to the narrowest; null without a host.

    Suffixes have up to ``labels`` labels and prefixes up to ``segments`` segments, as many as any entry has."""
    host = host_of(url)
    parts_of_host = F.split(host, r"\.")
    size = F.size(parts_of_host)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(size, F.lit(max(labels, 1)))),
        lambda k: F.struct(F.array_join(F.slice(parts_of_host, size - k + 1, k), ".").alias("pattern"), k.alias("depth")),
    )
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    m = F.least(F.size(parts), F.lit(segments))
    prefixes = F.transform(
        F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")).alias("pattern"), (k + size).alias("depth")
        ),
    )
    return F.when(host.isNotNull(), F.concat(suffixes, prefixes))


def extent(entries: DataFrame) -> tuple[int, int]:
    """The most labels and the most path segments that a pattern of ``entries`` has; 0 without entries."""
    host = F.substring_index("pattern", "/", 1)
    slashes = F.regexp_count("pattern", F.lit("/"))
    labels, segments = entries.agg(F.max(F.size(F.split(host, r"\."))), F.max(slashes - 1)).first()
    return max(labels or 0, 0), max(segments or 0, 0)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, held_from, held_until): each entry holds from its day until the next day of its pattern.

    ``entries`` has pattern, action and day. Of entries of one pattern on one day, the greatest action wins ('block'
    over 'allow'); an entry that says what the one before said goes on holding. Entries without pattern or day are no entries.
    """
    daily = entries.where("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    by_day = Window.partitionBy("pattern").orderBy("day")
    changes = daily.withColumn("_before", F.lag("action").over(by_day)).where(~F.col("action").eqNullSafe(F.col("_before")))
    until = F.coalesce(F.lead("day").over(by_day), F.lit(OPEN).cast("date"))
    return changes.select("pattern", "action", F.col("day").alias("held_from"), until.alias("held_until"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: capture_id, fetched_on, verdict, pattern, held_from, n_holding.

    ``captures`` has capture_id, url, fetched_on; ``entries`` pattern, action ('block', 'allow' or 'lift'), day. Of the
    entries that held on the day of the fetch for any pattern of the URL, the narrowest decides; 'lift' ends what its
    pattern said and decides nothing. verdict is its action, or 'none'. n_holding counts the entries that held.

    Patterns of a URL go as deep as the deepest entry, so an entry may name a page at any depth.
    Intervals are joined by pattern and month, so that a host with a long history doesn't meet each of its captures
    once per entry; an open interval ends with the last month that has a capture. Captures without url, host or day get 'none'.
    Repeated captures give a row each; an empty list gives 'none' everywhere. Other columns are not read.
    """
    rows = captures.select("capture_id", "url", F.col("fetched_on").cast("date").alias("fetched_on"))
    low, high = rows.agg(F.trunc(F.min("fetched_on"), "month"), F.trunc(F.max("fetched_on"), "month")).first()
    start = F.greatest(F.trunc("held_from", "month"), F.lit(low).cast("date"))
    last = F.least(F.trunc(F.date_sub("held_until", 1), "month"), F.lit(high).cast("date"))
    held = intervals(entries).where("action <> 'lift'").withColumn("_start", start).withColumn("_last", last)
    by_month = held.where("_start <= _last").select(
        F.col("pattern").alias("_pattern"), "action", "held_from", "held_until",
        F.explode(F.sequence("_start", "_last", F.expr("interval 1 month"))).alias("_month"),
    )
    asked = rows.withColumn("_key", F.monotonically_increasing_id()).select(
        "_key", "capture_id", "fetched_on", F.explode_outer(patterns_of(F.col("url"), *extent(entries))).alias("_p")
    )
    asked = asked.select(
        "_key", "capture_id", "fetched_on", F.col("_p.pattern").alias("_own"), F.col("_p.depth").alias("_depth"), F.trunc("fetched_on", "month").alias("_at")
    )
    meets = (F.col("_own") == F.col("_pattern")) & (F.col("_at") == F.col("_month"))
    holds = (F.col("held_from") <= F.col("fetched_on")) & (F.col("fetched_on") < F.col("held_until"))
    met = asked.join(by_month, meets & holds, "left")
    narrowest = F.max(F.when(F.col("action").isNotNull(), F.struct("_depth", "action", "_pattern", "held_from"))).alias("_n")
    judged = met.groupBy("_key", "capture_id", "fetched_on").agg(narrowest, F.count("action").alias("n_holding"))
    return judged.select(
        "capture_id", "fetched_on", F.coalesce("_n.action", F.lit("none")).alias("verdict"),
        F.col("_n._pattern").alias("pattern"), F.col("_n.held_from").alias("held_from"), "n_holding",
    )
