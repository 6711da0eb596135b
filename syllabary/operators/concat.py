"""Ordered concatenation of a group's distinct texts, in segments that no task has to hold together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabary.session import checkpointed


def joined_in_parts(
    df: DataFrame, keys: Sequence[str], value: str, separator: str = " | ", limit: int = 1_000_000, name: str = "joined", ranges: int | None = None
) -> DataFrame:
    """(keys, part, name): the distinct values of each group, sorted and joined; NULL values do not count, NULL keys are a group.

    Values are dealt by ranges of (keys, value), so one group may lie in many tasks; one row per group and range then says where each
    range of a group begins. A new part begins with the first value that has ``limit`` characters or more (with separators) ahead
    of it in its part's run of ``limit``, so a part is shorter than ``limit`` and its longest value together. Where a part
    ends depends on the values only. Parts ascend from 1; a value longer than ``limit`` skips numbers. Groups below ``limit`` have one part.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    picked = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    distinct = df.where(F.col(value).isNotNull()).select(*picked, F.col(value).cast("string").alias("_v")).distinct()
    # Written, as ranges are drawn from a sample and the totals below must see the same ones.
    dealt = checkpointed(distinct.repartitionByRange(ranges, *names, "_v").withColumn("_range", F.spark_partition_id()))
    size = (F.length("_v") + len(separator)).cast("long")
    before = Window.partitionBy(*names, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*names, "_range").agg(F.sum(size).alias("_size"))
    starts = totals.select(
        *[F.col(n).alias(f"{n}s") for n in names], F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    same = F.col("_range") == F.col("_r")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}s"))
    placed = dealt.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).join(starts, same)
    part = (F.floor((F.col("_start") + F.col("_before")) / limit) + 1).cast("long")
    joined = placed.groupBy(*names, part.alias("_part")).agg(F.array_join(F.array_sort(F.collect_list("_v")), separator).alias("_joined"))
    return joined.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("part"), F.col("_joined").alias(name))
