"""Reading: Parquet in any of the known layouts, wide exports, CSV time lists, JSON limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.functions import tags, times
from plantspark.schema import NATURAL_KEY, TIME_ALIASES, normalise

CANONICAL = (*NATURAL_KEY, "value")


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """One or many Parquet files or folders as canonical readings."""
    return normalise(spark.read.parquet(*paths)).select(*CANONICAL)


def scan_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames by column name; a missing column is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def view(spark: SparkSession, name: str, *globs: str) -> DataFrame:
    """A named view over globs of Parquet, one branch per glob."""
    scan_all([scan(spark, g) for g in globs]).createOrReplaceTempView(name)
    return spark.table(name)


def materialise(df: DataFrame, name: str) -> None:
    """The same as a stored table."""
    df.write.mode("overwrite").saveAsTable(name)


def is_wide(columns: Sequence[str]) -> bool:
    """Wide exports have no tag column."""
    return "tag" not in columns


def tidy(wide: DataFrame) -> DataFrame:
    """A wide export (time column, value columns ``<plant> <unit> <tag>``) as readings."""
    source = next(c for c in TIME_ALIASES if c in wide.columns)
    headers = [c for c in wide.columns if c != source]
    numeric = wide.select(F.col(source).alias("time"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in headers])
    long = numeric.unpivot(["time"], [f"`{h}`" for h in headers], "header", "value")
    parts = tags.header_parts(F.col("header"))
    return (
        long.select("header", "time", "value", parts.alias("_p"))
        .select("header", F.col("_p.plant").alias("plant"), F.col("_p.unit").alias("unit"), tags.slug(F.col("_p.tag")).alias("tag"), "time", "value")
        .where(F.col("time").isNotNull() & F.col("value").isNotNull())
    )


def resolve_times(df: DataFrame, raw: str = "time") -> DataFrame:
    """Text times or spreadsheet day numbers, whichever rule the whole input fits."""
    text = F.try_to_timestamp(F.col(raw).cast("string"))
    serial = times.from_day_number(F.col(raw).try_cast("double"))
    prefer = df.select(times.prefer_day_numbers(F.count(serial), F.count(text))).scalar()
    return df.withColumn("time", F.when(prefer, serial).otherwise(text))


def marked_times(spark: SparkSession, path: str, column: str = "timestamp") -> DataFrame:
    """Externally flagged times from CSV; unreadable rows are dropped."""
    schema = T.StructType([T.StructField(column, T.StringType())])
    return parse_marks(spark.read.schema(schema).csv(path, header=True), column)


def parse_marks(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.select(F.try_to_timestamp(column).alias("time")).where(F.col("time").isNotNull()).distinct()


LIMITS_FILE = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField(
            "tag_configurations",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "thresholds",
                            T.StructType([T.StructField(c, T.DoubleType()) for c in ("upper_limit", "lower_limit", "outlier_sigma")]),
                        ),
                        T.StructField("sensitivity", T.StringType()),
                    ]
                ),
            ),
        ),
    ]
)


def limits_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-unit limit files (one JSON document per file) as a limits table."""
    return flatten_limits(spark.read.schema(LIMITS_FILE).json(path, multiLine=True))


def flatten_limits(df: DataFrame) -> DataFrame:
    rows = df.select("unit", F.explode("tag_configurations").alias("tag", "cfg"))
    limits = rows.select(
        "unit",
        "tag",
        F.col("cfg.thresholds.lower_limit").alias("lower_limit"),
        F.col("cfg.thresholds.upper_limit").alias("upper_limit"),
        F.coalesce("cfg.thresholds.outlier_sigma", F.lit(2.5)).alias("outlier_sigma"),
        F.col("cfg.sensitivity").alias("sensitivity"),
    )
    return limits.where(F.col("lower_limit").isNotNull() & F.col("upper_limit").isNotNull())


def inventory(df: DataFrame, source: Column) -> DataFrame:
    """Per file (or other source label) records, time range, tags, columns."""
    return df.groupBy(source.alias("source")).agg(
        F.count("*").alias("records"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count_distinct("tag").alias("tags"),
        F.lit(len(df.columns)).alias("columns"),
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """S12 over files: the same with path and size taken from the file metadata."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    return normalise(df).groupBy("_file", "_size").agg(
        F.count("*").alias("records"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count_distinct("tag").alias("tags")
    )
