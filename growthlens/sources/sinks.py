"""Writers: dated snapshot tables and report CSVs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, by=("snapshot_date",), files_per_key: int = 8) -> None:
    """Partitioned, idempotent: a rerun replaces the partitions it writes and no others.

    Rows of one partition are spread over ``files_per_key`` writers, so that one large site or
    week does not end in a single task.
    """
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(files_per_key))
    (
        df.repartition(*by, salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_report_csv(df: DataFrame, path: str) -> None:
    """CSV with header; values with commas, quotes or line breaks are quoted."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
