"""Scans. Nothing here brings rows to the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.sources.contracts import PANEL, PANEL_KEY, SCORES, require


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a declared schema no footer is read to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def warehouse_options(
    url: str,
    query: str,
    *,
    partition_column: str,
    lower: str | int,
    upper: str | int,
    partitions: int = 64,
    fetch_size: int = 10_000,
    login: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """JDBC options for a parallel read; the bounds split the read, they filter nothing.

    ``login`` comes from the caller's secret store; there is no default account.
    """
    options = {
        "url": url,
        "dbtable": f"({query}) source_rows",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }
    options.update(login or {})
    return options


def read_warehouse(spark: SparkSession, url: str, query: str, **kwargs) -> DataFrame:
    """A warehouse query read by the executors in slices of ``partition_column``."""
    return spark.read.format("jdbc").options(**warehouse_options(url, query, **kwargs)).load()


def read_sql(spark: SparkSession, text: str, cutoff: date, **tables: DataFrame) -> DataFrame:
    """Run SQL text with ``:cutoff`` bound as a date; ``tables`` are named in it as ``{name}``."""
    return spark.sql(text, args={"cutoff": cutoff}, **tables)


def _panel_schema(features: Sequence[str]) -> T.StructType:
    known = {field.name: field for field in PANEL.fields}
    return T.StructType(
        [known[k] for k in PANEL_KEY]
        + [known.get(f, T.StructField(f, T.DoubleType(), True)) for f in features]
    )


def read_daily_panel(
    spark: SparkSession,
    root: str,
    start: date,
    end: date,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Telemetry kept as one folder per day (``root/2024-06-15/``), for the days start..end.

    One scan of all folders that exist; days without a folder are skipped, and a range without any
    folder gives an empty table of the same schema. Other read errors are not hidden.
    """
    features = list(SCORES if features is None else features)
    schema = _panel_schema(features)
    days = [str(start + timedelta(n)) for n in range((end - start).days + 1)]
    columns = ["cpe_date", *PANEL_KEY, *features]
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]+$", 1)
    try:
        if not days:
            raise AnalysisException("no days", errorClass="PATH_NOT_FOUND")
        files = spark.read.schema(schema).parquet(f"{root}/{{{','.join(days)}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = T.StructType([PANEL["cpe_date"], *schema.fields])
        return spark.createDataFrame([], empty).select(columns)
    return files.select(F.to_date(day, "yyyy-MM-dd").alias("cpe_date"), *PANEL_KEY, *features)


def read_partitioned_panel(
    spark: SparkSession, root: str, features: Sequence[str] | None = None
) -> DataFrame:
    """Telemetry partitioned by ``cpe_date``. Date filters, also by subquery, prune its folders."""
    features = list(SCORES if features is None else features)
    panel = spark.read.parquet(root)
    require(panel, ["cpe_date", *PANEL_KEY, *features])
    return panel.select(F.col("cpe_date").cast("date").alias("cpe_date"), *PANEL_KEY, *features)
