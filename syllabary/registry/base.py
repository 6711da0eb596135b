"""The table of registered queries: a key, a callable (spark, sf_dir) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.registry.star import star_store, table
from syllabary.session import configure
from syllabary.store import Store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that both sides show them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def add(key: str, run: Query, sql: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"query {key!r} is registered twice")

    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(run(configure(spark), sf_dir))

    QUERIES[key] = configured
    if sql is not None:
        ORACLE[key] = sql


def on_star(key: str, run: Callable[[Store], DataFrame], sql: str | None = None) -> None:
    """A query over the driver's tables read as a catalogue."""
    add(key, lambda spark, sf_dir: run(star_store(spark, sf_dir)), sql)


def on_table(key: str, name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over one of the driver's tables."""
    add(key, lambda spark, sf_dir: run(table(spark, sf_dir, name)), sql)
