"""Sorting, paging, distinct values, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_columns(df: DataFrame, sort: str | None, order: str = "asc", tie: str | None = "id") -> list[Column]:
    """One sort column (unknown names are ignored) and the key as tie-break; NULL is the smallest value."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be asc or desc, not {order!r}")
    columns = []
    if sort and sort in df.columns:
        columns.append(F.col(sort).asc_nulls_first() if order == "asc" else F.col(sort).desc_nulls_last())
    if tie and tie in df.columns and tie != sort:
        columns.append(F.col(tie).asc_nulls_first())
    return columns


def sort_one(df: DataFrame, sort: str | None, order: str = "asc", tie: str | None = "id") -> DataFrame:
    columns = order_columns(df, sort, order, tie)
    return df.orderBy(*columns) if columns else df


def page(
    df: DataFrame, page: int | None = None, page_size: int | None = None, sort: str | None = None,
    order: str = "asc", tie: str | None = "id",
) -> DataFrame:
    """One page of the sorted rows; only ``page_size`` switches paging on."""
    ordered = sort_one(df, sort, order, tie)
    if page_size is None:
        return ordered
    skip = ((page or 1) - 1) * page_size
    return ordered.offset(skip).limit(page_size) if skip else ordered.limit(page_size)


def page_meta(df: DataFrame, page: int | None = None, page_size: int | None = None) -> DataFrame:
    """Count, page, limit and number of pages of the filtered rows, as one row."""
    count = df.agg(F.count(F.lit(1)).alias("count"))
    if page_size is None:
        return count.select("count", F.lit(1).alias("page"), F.col("count").alias("limit"), F.lit(1).alias("total_pages"))
    return count.select(
        "count",
        F.lit(page or 1).alias("page"),
        F.lit(page_size).cast("long").alias("limit"),
        F.ceil(F.col("count") / F.lit(page_size)).cast("int").alias("total_pages"),
    )


def distinct_values(
    df: DataFrame, field: str, order: str = "asc", page_number: int | None = None, page_size: int | None = None
) -> DataFrame:
    """Distinct values of one column in order; NULL is one of them."""
    if field not in df.columns:
        raise ValueError(f"no field {field!r}")
    values = df.select(field).distinct()
    return page(values, page_number, page_size, sort=field, order=order, tie=None)


def sample_rows(df: DataFrame, n: int, by: str = "id") -> DataFrame:
    """The first n offending rows in key order, for a report."""
    return df.orderBy(by).limit(n)


def largest(df: DataFrame, measure: str, k: int, *ties: str) -> DataFrame:
    """Top-k report rows by a measure, ties by the named columns."""
    return df.orderBy(F.col(measure).desc(), *[F.col(t).asc_nulls_first() for t in ties]).limit(k)
