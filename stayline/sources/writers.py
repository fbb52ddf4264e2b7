"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the Parquet table at ``path``.

    With ``partition_by`` only the partitions present in ``df`` are replaced. Rows are not gathered
    per partition value first, so a value that holds most rows is still written by many tasks.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    else:
        writer = writer.option("partitionOverwriteMode", "static")
    writer.parquet(path)
