"""Writing: atomic replace, aligned append, partitioned datasets, reports, versioned copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTITIONS = ("plant", "unit", "year", "month")


def replace(df: DataFrame, path: str) -> None:
    """S3: overwrite a Parquet folder; the commit protocol publishes all files or none."""
    df.write.mode("overwrite").parquet(path)


def aligned(df: DataFrame, target: StructType) -> DataFrame:
    """Columns of ``target`` in its order: missing ones null, extra ones dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def append(df: DataFrame, path: str) -> None:
    """Append rows aligned to what the folder already holds."""
    target = df.sparkSession.read.parquet(path).schema
    aligned(df, target).write.mode("append").parquet(path)


def in_folders(folders: Sequence[Sequence], partitions: Sequence[str] = PARTITIONS) -> Column:
    """Rows of the named partition folders: literals over partition columns alone, so that a scan prunes by it."""
    name = lambda values: "/".join("" if v is None else str(v) for v in values)
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in partitions]).isin([name(f) for f in folders])


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("time")).withColumn("month", F.month("time"))


def clustered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a folder together, tasks sized by data, sorted for pruning within files."""
    return df.hint("rebalance", *[F.col(k) for k in keys]).sortWithinPartitions(*dict.fromkeys([*keys, "tag", "time"]))


def write_dataset(
    df: DataFrame,
    path: str,
    *,
    by_tag: bool = False,
    max_rows_per_file: int = 5_000_000,
    compression: str = "zstd",
    mode: str = "overwrite",
) -> None:
    """Hive layout plant / unit [/ tag] / year / month.

    The rebalance hint lets Spark size the writers by data: small folders share a task,
    a hot folder is split over many. ``tag`` and ``time`` are sort columns, which makes
    row-group statistics prune tag filters without one folder per tag.
    """
    keys = ["plant", "unit", *(["tag"] if by_tag else []), "year", "month"]
    (
        clustered(with_calendar(df), keys)
        .write.mode(mode)
        .option("maxRecordsPerFile", max_rows_per_file)
        .option("compression", compression)
        .partitionBy(*keys)
        .parquet(path)
    )


def merge_files(spark: SparkSession, paths: Sequence[str], path: str) -> None:
    """Many batch files into one master ordered by time and tag (range partitioned)."""
    from plantspark.sources.readers import scan

    scan(spark, *paths).orderBy("time", "tag").write.mode("overwrite").parquet(path)


def overwrite_touched(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Rewrite only the partition folders present in ``df``, each in files sized by data."""
    clustered(df, partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def export_report(df: DataFrame, folder: str) -> None:
    """The same report table as CSV and as JSON lines."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/json")


def versioned_copy(spark: SparkSession, path: str, version: str) -> str:
    """Keep the data as it is under a new versioned path before a rewrite."""
    target = f"{path.rstrip('/')}.backup-{version}"
    spark.read.parquet(path).write.mode("error").parquet(target)
    return target
