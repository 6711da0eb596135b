"""Incremental load with Structured Streaming.

Every micro-batch writes its staged rows under the id of its query and its number; nothing stored before is touched, a
batch that is run again after a failure replaces its own rows, and a query with a new checkpoint, whose numbers start
anew, has a folder of its own. A batch counts once its last file, the marker, is there, so readers never see half of
one. Reading resolves the rows of all batches: places in the arrival order do not depend on the batch, so the result
equals one load of everything. `publish` writes the resolved tables for readers that want them ready.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from syllabary.plans import load as L
from syllabary.store import Store, write_store

LINK_DDL = "name string, url string, path string"
DONE = "done"
STAGES = ("modules", "courses", "events", "exams", "achievements", "rejects")


def read_records(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of nested module records from JSON lines files."""
    reader = spark.readStream.schema(L.MODULE_DDL)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def read_links(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of discovered (name, url, path) links."""
    return spark.readStream.schema(LINK_DDL).json(folder)


def united_links(links: DataFrame) -> DataFrame:
    """Each (name, url) once with all its paths, in batch, or as a stream in update or complete mode.

    The state of the stream is one row per link with its distinct paths, which is the size of the catalogue and not of
    the crawl: links met again add nothing.
    """
    return links.groupBy("name", "url").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def warning_counts(warnings: DataFrame) -> DataFrame:
    """Running count per kind (complete or update mode)."""
    return warnings.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def write_batch(root: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the batch's staged tables under ``<root>/<stage>/run=<query>/batch=<n>``, then its marker.

    The query's id is the one that Spark keeps in the checkpoint folder, so it lasts as long as the batch numbers do.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        batch = batch.persist()
        try:
            for name, df in L.stage(batch).items():
                df.write.mode("overwrite").parquet(f"{root}/{name}/run={run}/batch={number}")
            spark.range(1).write.mode("overwrite").parquet(f"{root}/{DONE}/run={run}/batch={number}")
        finally:
            batch.unpersist()

    return sink


def start_load(records: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(write_batch(root, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_loaded(spark: SparkSession, root: str) -> tuple[Store, DataFrame]:
    """The store and rejects of all batches so far."""
    done = spark.read.parquet(f"{root}/{DONE}").select("run", "batch").distinct()
    staged = {n: spark.read.parquet(f"{root}/{n}").join(done, ["run", "batch"], "left_semi").drop("run", "batch") for n in STAGES}
    return L.resolve(staged), staged["rejects"]


def publish(spark: SparkSession, root: str, target: str) -> None:
    """Write the resolved tables of all batches so far."""
    store, _ = read_loaded(spark, root)
    write_store(store, target)
