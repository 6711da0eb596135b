"""What the operators of this package share: cutting lineage, and running sums without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (spark.checkpoint.dir).

    Only a local master, where driver and executors are one process, may go without: it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local-cluster") and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="syllabary-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost a re-read, and Spark knows its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], within: Sequence[str] = (), name: str = "running"
) -> DataFrame:
    """``df`` with inclusive running sums over ``order``, in each group of the columns ``within``.

    Rows are dealt by ranges of (within, order), so a group that holds most rows is spread over many tasks; sums inside
    a range come from a window, and the sums of the ranges before it from a table of one row per range and group.
    The order should be unique; ties are put in any order, one for all sums.
    """
    keys = list(within)
    measured = df.select("*", *(expr.cast("long").alias(f"_m_{k}") for k, expr in sums.items()))
    ranged = stored(measured.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), name)
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *keys).agg(*(F.sum(f"_m_{k}").alias(f"_t_{k}") for k in sums))
    before = totals.select(
        F.col("_range").alias("_r"),
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums),
    )
    local = ranged.select("*", *(F.sum(f"_m_{k}").over(here).alias(f"_l_{k}") for k in sums))
    match = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(before, match).select(
        *(F.col(c) for c in df.columns), *((F.col(f"_l_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums)
    )
