"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Skewed join partitions are split even when that costs one
# more shuffle: without the split a single hot line would hold up the whole stage.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller already has."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark. On a cluster use the given session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stayline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the one the cluster names in ``spark.checkpoint.dir``.

    Where none is named the warehouse serves, which the driver and all executors of a cluster share as well, unless it
    lies in a folder of the driver's machine: then there is nothing to share, and a setting is asked for. Everything a job stores lies in one sub-folder named after the application; delete that folder
    once the results are written.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {folder} is none")
    return f"{folder.rstrip('/')}/stayline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and continue from the files.

    For tables that several passes read (training, ranking). Unlike a cache the files outlive lost
    executors, and later passes read only the columns they need. ``options`` are the Parquet writer's.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
