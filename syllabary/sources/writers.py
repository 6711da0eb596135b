"""Result files: envelopes, CSV, calendars, snapshots, reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.operators.ordering import page_meta


def _is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, so that every column fits a CSV cell."""
    columns: list[Column] = [
        (F.to_json(f.name, {"ignoreNullFields": "false"}) if _is_nested(f.dataType) else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """CSV in two parts: ``<path>/header`` with one line, and ``<path>/rows`` in part files without header.

    Quotes inside a cell are doubled. Read in this order, the files are one CSV file; an empty result has no header either.
    """
    flat = flat_columns(df)
    rows = f"{path}/rows"
    flat.write.mode("overwrite").csv(rows, header=False, sep=separator, nullValue="", emptyValue="", quote='"', escape='"')
    some = not df.sparkSession.read.text(rows).isEmpty()
    names = [(name,) for name in ([separator.join(_cell(c, separator) for c in flat.columns)] if some else [])]
    df.sparkSession.createDataFrame(names, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def _cell(name: str, separator: str) -> str:
    quoted = name.replace('"', '""')
    return f'"{quoted}"' if any(c in name for c in (separator, '"', "\n", "\r")) else name


def envelope(rows: DataFrame, counted: DataFrame, page: int | None = None, page_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two parts of a list response: the meta record and the items, one JSON text per row."""
    return page_meta(counted, page, page_size), rows.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item")
    )


def write_envelope(rows: DataFrame, counted: DataFrame, path: str, page: int | None = None, page_size: int | None = None) -> None:
    meta, items = envelope(rows, counted, page, page_size)
    meta.write.mode("overwrite").json(f"{path}/meta")
    items.write.mode("overwrite").text(f"{path}/items")


def write_snapshot(links: DataFrame, root: str, stamp: str | None = None, faculties: DataFrame | None = None) -> str:
    """A dated copy that is never overwritten, and the latest one: ``modules`` and ``meta`` as JSON lines.

    ``meta`` is the envelope of the crawl: created_at, count and the faculties it found (prefix, name).
    """
    now = dt.datetime.now(dt.timezone.utc)
    dated, latest = f"{root}/modules_{stamp or now.strftime('%Y%m%dT%H%M%SZ')}", f"{root}/modules_latest"
    spark = links.sparkSession
    links.write.mode("errorifexists").json(f"{dated}/modules")
    written = spark.read.schema(links.schema).json(f"{dated}/modules")
    found = faculties.select("prefix", "name") if faculties is not None else spark.createDataFrame([], "prefix int, name string")
    # Faculties are a handful by nature: they are the top nodes of one catalogue.
    listed = found.agg(F.array_sort(F.collect_list(F.struct("prefix", "name"))).alias("faculties"))
    counted = written.agg(F.count(F.lit(1)).alias("count")).join(listed)
    meta = counted.select(F.lit(now.strftime("%Y-%m-%dT%H:%M:%S")).alias("created_at"), "count", "faculties")
    meta.write.mode("errorifexists").json(f"{dated}/meta")
    written.write.mode("overwrite").json(f"{latest}/modules")
    spark.read.schema(meta.schema).json(f"{dated}/meta").write.mode("overwrite").json(f"{latest}/meta")
    return dated


def write_calendar(calendar: DataFrame, path: str) -> None:
    """(position, id, ics) rows as text in calendar order; the part files read in order are the calendar."""
    ordered = calendar.orderBy("position", "id")
    ordered.select(F.concat("ics", F.lit("\r")).alias("value")).write.mode("overwrite").text(path)


def degree_counts(found: DataFrame) -> DataFrame:
    """Results per programme, blanks for NULL, by kind, faculty and name."""
    keys = ("kind", "faculty", "name", "degree", "subject", "school_type", "version", "confidence")
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_modules"))
    blanks = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]
    return counts.select(*blanks, "n_modules").orderBy("kind", "faculty", "name")


def write_degree_csv(found: DataFrame, path: str) -> None:
    write_csv(degree_counts(found), path, separator=";")


def write_modules_json(found: DataFrame, path: str, key: str = "idx") -> None:
    """Extraction results as JSON lines, one line per item with the list of its results.

    The list is that of one module's distinct paths.
    """
    result = F.struct(*[c for c in found.columns if c != key])
    per_item = found.groupBy(key).agg(F.array_sort(F.collect_list(result)).alias("results"))
    per_item.write.mode("overwrite").json(path)


def append_rejects(rejects: DataFrame, path: str) -> None:
    """Warnings and failures (kind, message, context) with the time they were written."""
    stamped = rejects.select(F.unix_micros(F.current_timestamp()).cast("double") / 1e6, "kind", "message", "context")
    stamped.toDF("ts", "kind", "message", "context").write.mode("append").json(path)


def failed_modules(links: DataFrame, loaded: DataFrame) -> DataFrame:
    """Links that left no record, as reject rows."""
    done = loaded.select(F.col("url").alias("_u")).distinct()
    missing = links.join(done, F.col("url") == F.col("_u"), "left_anti")
    context = F.create_map(F.lit("name"), F.col("name"), F.lit("url"), F.col("url"))
    return missing.select(F.lit("module_failed").alias("kind"), F.col("name").alias("message"), context.alias("context"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
