"""Session settings the library relies on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only, so they can be applied to a session somebody else built.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join partitions even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Inferring filters from constraints takes minutes on the nested records of the load (each alias of an
    # expression doubles the constraints). The joins here state their IS NOT NULL filters themselves.
    "spark.sql.constraintPropagation.enabled": "false",
    # Pages are large rows: bound an Arrow batch by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; deployment settings (memory, cores) stay as they are."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "syllabary") -> SparkSession:
    """A session for tests and single-machine runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder the cluster names and read again: its work is done once, and executors may be lost."""
    return written(df)


def written(df: DataFrame, *folders: str) -> DataFrame:
    """As `checkpointed`, with a folder for each value of the columns ``folders``, which filters on them then leave out."""
    path = fresh_folder(df.sparkSession)
    write = df.write.option("compression", "zstd")
    (write.partitionBy(*folders) if folders else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def fresh_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only where that is unset and the session is one process (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="syllabary-checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
