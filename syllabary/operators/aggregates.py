"""Aggregations.

All of them are plain aggregate functions, so Spark combines them before the exchange and a hot key
costs no more there than any other. None collects the rows of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value: Column, seq: Column, keep: Column | None = None) -> Column:
    """The value that comes first in ``seq`` among the rows where ``keep`` holds."""
    return F.min_by(value, seq if keep is None else F.when(keep, seq))


def first_text(value: Column, seq: Column) -> Column:
    """First non-empty text, '' where there is none."""
    return F.coalesce(first_by(value, seq, F.coalesce(value != "", F.lit(False))), F.lit(""))


def first_number(value: Column, seq: Column, default) -> Column:
    """First number that is neither NULL nor 0."""
    return F.coalesce(first_by(value, seq, F.coalesce(value != 0, F.lit(False))), F.lit(default))


def first_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The first row per key in the order of ``seq``."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in seq])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str, seq: Sequence[str]) -> DataFrame:
    """Most frequent value per key; of equally frequent ones the first seen. NULLs do not count."""
    order = F.struct(*[F.col(c) for c in seq])
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    )
    best = counts.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("_n"), F.col("_first"))).alias(value))
    return best


def counter(df: DataFrame, *values: str, name: str = "n") -> DataFrame:
    return df.groupBy(*values).agg(F.count(F.lit(1)).alias(name))


def top_counter(df: DataFrame, value: str, k: int, name: str = "n") -> DataFrame:
    """The k most common values, ties in value order."""
    return counter(df, value, name=name).orderBy(F.col(name).desc(), F.col(value).asc_nulls_first()).limit(k)


def having_several(df: DataFrame, keys: Sequence[str], *values: str, name: str = "n") -> DataFrame:
    """Groups in which at least one of the columns takes more than one distinct (non-NULL) value.

    A minimum that differs from the maximum says the same as a distinct count above 1 and needs no
    expansion of the rows; ``name`` gives the exact distinct count where one column is asked for.
    """
    if len(values) == 1:
        return df.groupBy(*keys).agg(F.countDistinct(values[0]).alias(name)).where(F.col(name) > 1)
    flags = [(F.min(v) != F.max(v)).alias(f"{v}_differs") for v in values]
    either = F.lit(False)
    for v in values:
        either = either | F.coalesce(F.col(f"{v}_differs"), F.lit(False))
    return df.groupBy(*keys).agg(*flags).where(either)


def duplicate_groups(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Key groups with more than one row; NULL parts are equal to each other."""
    return counter(df, *keys, name=name).where(F.col(name) > 1)


def joined_values(value: str, separator: str = " | ") -> Column:
    """Distinct texts of a group, sorted and joined. For report columns over short value sets."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as (table, n): one job, one narrow row per table and partition."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stats_record(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The same counts as one record with a column per table."""
    columns = [F.sum(F.when(F.col("table") == name, F.col("n"))).alias(name) for name in tables]
    return table_counts(tables).agg(*columns)
