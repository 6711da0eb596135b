"""A set of entity and link tables under one relation catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.catalog import CATALOG, ENTITY_DDL, LINKS, Catalog


# Columns that only serve the file layout and are no field of an entity.
LAYOUT_COLUMNS = ("event_month",)


@dataclass(frozen=True)
class Store:
    tables: Mapping[str, DataFrame]
    catalog: Catalog = field(default=CATALOG)

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise ValueError(f"unknown table {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def columns(self, entity: str) -> list[str]:
        return [c for c in self[entity].columns if c not in LAYOUT_COLUMNS]

    def with_tables(self, **tables: DataFrame) -> "Store":
        return Store({**self.tables, **tables}, self.catalog)


def entity_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(ENTITY_DDL[name])


def link_schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in LINKS[name]])


def empty_store(spark: SparkSession) -> Store:
    tables = {n: spark.createDataFrame([], entity_schema(n)) for n in ENTITY_DDL}
    tables |= {n: spark.createDataFrame([], link_schema(n)) for n in LINKS}
    return Store(tables)


def write_store(store: Store, root: str, mode: str = "overwrite") -> None:
    """One Parquet folder per table; those that the store lacks are written empty, so that `read_store` finds all of them.

    Events are laid out by month, the unit of the date windows.
    """
    spark = next(iter(store.tables.values())).sparkSession
    missing = {n: df for n, df in empty_store(spark).tables.items() if n not in store}
    for name, df in (missing | dict(store.tables)).items():
        writer = df
        if name == "event":
            writer = df.withColumn("event_month", F.trunc("event_date", "MM"))
            writer.write.mode(mode).partitionBy("event_month").parquet(f"{root}/{name}")
        else:
            writer.write.mode(mode).parquet(f"{root}/{name}")


def read_store(spark: SparkSession, root: str) -> Store:
    tables = {n: spark.read.schema(entity_schema(n)).parquet(f"{root}/{n}") for n in ENTITY_DDL if n != "sync_run"}
    tables |= {n: spark.read.schema(link_schema(n)).parquet(f"{root}/{n}") for n in LINKS}
    return Store(tables)
