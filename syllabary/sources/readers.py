"""Files as tables: snapshots, JSON lines, the page store, path items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.functions import paths as path_functions
from syllabary.functions import urls
from syllabary.plans.load import MODULE_DDL

FACULTY_DDL = "prefix int, name string"
SNAPSHOT_META_DDL = f"created_at string, count long, faculties array<struct<{FACULTY_DDL}>>"
SNAPSHOT_DDL = f"{SNAPSHOT_META_DDL}, modules array<struct<name string, url string, path string>>"
WARNING_DDL = "ts double, kind string, message string, context map<string,string>"
SIDECAR_DDL = "url string, status int, fetched_at double, headers map<string,string>"
LINK_DDL = "name string, url string, path string"
PATH_ITEMS_DDL = "items array<struct<path: array<array<string>>>>"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, path) of a snapshot that `write_snapshot` wrote: JSON lines, which split over tasks."""
    return read_module_links(spark, f"{path}/modules")


def read_snapshot_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row (created_at, count, faculties) of a snapshot that `write_snapshot` wrote."""
    return spark.read.schema(SNAPSHOT_META_DDL).json(f"{path}/meta")


def import_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, path) of one pretty-printed snapshot file, wrapped or a bare list. One task parses a file: for import only."""
    whole = spark.read.option("multiLine", True).schema(f"{SNAPSHOT_DDL}, {LINK_DDL}").json(path)
    wrapped = whole.where("modules is not null").select(F.inline("modules"))
    bare = whole.where("modules is null and name is not null").select("name", "url", "path")
    return wrapped.unionByName(bare).withColumn("path", path_functions.parse_paths(F.col("path")))


def import_snapshot_faculties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(SNAPSHOT_DDL).json(path).select(F.inline("faculties"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_module_links(spark: SparkSession, path: str) -> DataFrame:
    links = read_jsonl(spark, path, LINK_DDL)
    return links.withColumn("path", path_functions.parse_paths(F.col("path")))


def read_module_records(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MODULE_DDL)


def read_warnings(spark: SparkSession, path: str, kinds: Sequence[str] | None = None) -> DataFrame:
    warnings = read_jsonl(spark, path, WARNING_DDL)
    return warnings.where(F.col("kind").isin(list(kinds))) if kinds else warnings


def read_page_store(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, url, html): each ``<digest>.html`` joined with its ``<digest>.json`` sidecar.

    Pages without a file or with an unreadable sidecar are left out.
    """
    digest = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)
    html = (
        spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", True)
        .text(root, wholetext=True).select(digest.alias("page_id"), F.col("value").alias("html"))
    )
    sidecars = (
        spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True).schema(SIDECAR_DDL).json(root)
        .select(digest.alias("page_id"), "url").where("url is not null")
    )
    return html.join(sidecars, "page_id").select("page_id", "url", "html")


def read_path_items(spark: SparkSession, path: str) -> DataFrame:
    """(idx, path): one row per path of each item of an ``{"items": [{"path": [[…]]}]}`` file."""
    items = spark.read.option("multiLine", True).schema(PATH_ITEMS_DDL).json(path)
    rows = items.select(F.posexplode("items").alias("idx", "item"))
    return rows.select("idx", F.explode("item.path").alias("path"))


def filter_snapshot(
    snapshot: DataFrame, name: str | None = None, number: str | None = None, path: str | None = None,
    semester: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Modules by name pattern, number text, path text and semester text; the first ``limit`` by name."""
    df = snapshot
    if name:
        df = df.where(F.col("name").rlike(f"(?iu){name}"))
    if number:
        df = df.where(F.col("name").contains(number))
    for wanted in (path, semester):
        if wanted:
            df = df.where(path_functions.contains_text(F.col("path"), wanted))
    return df.orderBy("name", "url").limit(limit) if limit else df


def resume(links: DataFrame, processed: DataFrame) -> DataFrame:
    """Links whose address was not processed yet."""
    done = processed.select(F.col("url").alias("_done")).distinct()
    return links.join(done, F.col("url") == F.col("_done"), "left_anti")


def pages_of_kind(pages: DataFrame, kind: str) -> DataFrame:
    return pages.where(urls.page_kind(F.col("url")) == kind)
