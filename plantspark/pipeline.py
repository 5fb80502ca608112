"""One call from a wide export or stored readings to detections on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.operators import detectors
from plantspark.schema import NATURAL_KEY, TIME_ALIASES, normalise
from plantspark.session import ship
from plantspark.sources import readers, writers


def normalised(raw: DataFrame) -> DataFrame:
    """Readings from any layout: a wide export is laid out long, text and day-number times are resolved."""
    if not readers.is_wide(raw.columns):
        return normalise(raw).select(*readers.CANONICAL)
    source = next(c for c in TIME_ALIASES if c in raw.columns)
    if raw.schema[source].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date"):
        raw = readers.resolve_times(raw.withColumnRenamed(source, "time"))
    return readers.tidy(raw).select(*readers.CANONICAL)


def run(
    spark: SparkSession, raw: DataFrame, target: str, method: str = "sigma_runs", *, inputs: detectors.Inputs | None = None, tags: Sequence[str] | None = None
) -> DataFrame:
    """Normalise, store, detect, store: ``target`` gets ``readings`` (partitioned) and ``detections``.

    The detector reads the stored readings, so the export is parsed once. Returns the
    stored detections.
    """
    ship(spark)
    rows = normalised(raw).dropDuplicates(list(NATURAL_KEY))
    writers.write_dataset(rows, f"{target}/readings")
    stored = spark.read.parquet(f"{target}/readings").select(*readers.CANONICAL)
    writers.replace(detectors.detect(stored, method, inputs, tags), f"{target}/detections")
    return spark.read.parquet(f"{target}/detections")


def drop_alerts(spark: SparkSession, raw: DataFrame, target: str, **options) -> DataFrame:
    """The short form: normalise, flag drops below the rolling mean, store every row with its flag."""
    ship(spark)
    flagged = detectors.drop_alerts(normalised(raw).dropDuplicates(list(NATURAL_KEY)), **options)
    writers.replace(flagged.withColumn("alert", F.coalesce("alert", F.lit(False))), target)
    return spark.read.parquet(target)
