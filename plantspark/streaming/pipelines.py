"""Streaming counterparts of the batch operators.

Sources are file streams; progress lives in the stream's checkpoint under the shared
folder of the session, so a restarted query goes on where it stopped. Every sink is a
file sink or an idempotent ``foreachBatch``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.operators import dedup, detectors, health
from plantspark.schema import SERIES, UNIT, hours_between
from plantspark.session import checkpoint_root
from plantspark.sources import writers

#: New files in one batch.
FILES_PER_BATCH = 32

STORED = T.StructType(
    [
        T.StructField("plant", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("tag", T.StringType()),
        T.StructField("time", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("seq", T.LongType()),
    ]
)


def read_stream(spark: SparkSession, path: str, schema: T.StructType = STORED, *, files_per_batch: int | None = FILES_PER_BATCH, pattern: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; each new file is read once. ``files_per_batch`` None: all that is there is one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def run_available(stream: DataFrame, target: str, name: str, mode: str = "append") -> str:
    """Process everything available into a Parquet folder, then stop; returns the folder."""
    checkpoint = f"{checkpoint_root(stream.sparkSession)}/streams/{name}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return target


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh target folder and stream name under the shared checkpoint folder."""
    unique = f"{name}-{uuid.uuid4().hex[:12]}"
    return f"{checkpoint_root(spark)}/tables/{unique}", unique


def each_batch(stream: DataFrame, name: str, work: Callable[[DataFrame, int], None]) -> None:
    """I4: hand only new data to ``work``, batch by batch; the checkpoint is the state."""
    checkpoint = f"{checkpoint_root(stream.sparkSession)}/streams/{name}"
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# -- stateful transformations ----------------------------------------------------------

def distinct_readings(stream: DataFrame, lateness: str = "1 hour", keys: tuple[str, ...] = (*SERIES, "time")) -> DataFrame:
    """Late or repeated copies of a reading are dropped within the watermark."""
    return stream.withWatermark("time", lateness).dropDuplicatesWithinWatermark(list(keys))


def resampled(stream: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Mean per time bucket, emitted once when the bucket is closed."""
    grouped = stream.withWatermark("time", lateness).groupBy(*SERIES, F.window("time", width).alias("w"))
    return grouped.agg(F.avg("value").alias("value"), F.count("*").alias("records")).select(*SERIES, F.col("w.start").alias("bucket"), "value", "records")


def sliding(stream: DataFrame, width: str = "1 hour", step: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """I8: count, mean and std over sliding windows."""
    grouped = stream.withWatermark("time", lateness).groupBy(*SERIES, F.window("time", width, step).alias("w"))
    out = grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.select(*SERIES, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "std")


def sessions(stream: DataFrame, gap: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Stretches of readings without a gap, emitted when closed."""
    grouped = stream.withWatermark("time", lateness).groupBy(*SERIES, F.session_window("time", gap).alias("s"))
    return grouped.agg(F.count("*").alias("records")).select(*SERIES, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "records")


RUN_OUTPUT = "plant string, unit string, tag string, time timestamp, rows long, flagged long, run long, longest_run long"
RUN_STATE = "rows long, mean double, m2 double, flagged long, run long, longest_run long"


def run_counter(stream: DataFrame, z: float = 2.5, min_points: int = 20) -> DataFrame:
    """Consecutive readings with |z| >= ``z``, counted across batches.

    State per series: moments of all readings so far and the run lengths; a reading is
    judged by the moments that include it. The ninety-day window of the batch detector
    is not kept in state, so counts agree with it only while no reading has left that
    window. A task holds the new readings of one series as numbers: bound the batch by
    ``files_per_batch`` of ``read_stream``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, mean, m2, flagged, run, longest = state.get if state.exists else (0, 0.0, 0.0, 0, 0, 0)
        parts = [(b["time"].to_numpy(), b["seq"].to_numpy(), b["value"].to_numpy(float)) for b in batches]
        times, seqs, values = (np.concatenate(column) for column in zip(*parts, strict=True))
        values = values[np.lexsort((seqs, times))]
        values = values[~np.isnan(values)]
        if len(values):
            # Running moments around the mean so far (the first value at the start).
            centre = mean if rows else values[0]
            count = rows + np.arange(1, len(values) + 1)
            away = values - centre
            means = centre + np.cumsum(away) / count
            squares = np.maximum(m2 + np.cumsum(away * away) - count * (means - centre) ** 2, 0.0)
            std = np.sqrt(squares / np.maximum(count - 1, 1))
            hit = (count >= min_points) & (std > 0) & (np.abs(values - means) >= z * std)
            # A run's length at each hit: hits since the last miss, the earlier run included while there is none.
            hits = np.cumsum(hit)
            since = np.maximum.accumulate(np.where(hit, -1, hits))
            lengths = np.where(hit, hits - np.maximum(since, 0) + np.where(since < 0, run, 0), 0)
            rows, mean, m2 = int(count[-1]), float(means[-1]), float(squares[-1])
            flagged, run, longest = int(flagged + hits[-1]), int(lengths[-1]), int(max(longest, lengths.max()))
        state.update((rows, mean, m2, flagged, run, longest))
        row = {"plant": key[0], "unit": key[1], "tag": key[2], "time": pd.Timestamp(times.max()), "rows": rows, "flagged": flagged, "run": run, "longest_run": longest}
        yield pd.DataFrame([row])

    return stream.groupBy(*SERIES).applyInPandasWithState(step, RUN_OUTPUT, RUN_STATE, "append", "NoTimeout")


# -- merging and monitoring ------------------------------------------------------------

def folders_of(batch: DataFrame) -> list:
    """Partition folders a batch touches: units times months, bounded by ``files_per_batch``."""
    return writers.with_calendar(batch).select(*writers.PARTITIONS).distinct().collect()


def merge_into_dataset(new: DataFrame, dataset: str, staging: str, folders: list | None = None) -> None:
    """Merge readings into the partitioned dataset, new copies win.

    Only the month folders the new readings touch are read (a literal partition filter)
    and rewritten. The result is staged first, since a plan must not overwrite its own
    input; running the same batch again gives the same data.
    """
    spark = new.sparkSession
    new = writers.with_calendar(new)
    folders = folders_of(new) if folders is None else folders
    try:
        stored = spark.read.parquet(dataset).where(writers.in_folders(folders)).select(*new.columns)
    except AnalysisException as missing:  # first batch: nothing is stored yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = new.limit(0)
    dedup.merge_new_wins(stored, new, (*SERIES, "time")).write.mode("overwrite").parquet(staging)
    writers.overwrite_touched(spark.read.parquet(staging), dataset)


def ingest_new_files(spark: SparkSession, incoming: str, dataset: str, name: str, files_per_batch: int | None = FILES_PER_BATCH) -> None:
    """I4: new files of ``incoming`` merged into the dataset, then stop."""

    def work(batch: DataFrame, batch_id: int) -> None:
        merge_into_dataset(batch, dataset, f"{checkpoint_root(spark)}/staging/{name}")

    each_batch(read_stream(spark, incoming, files_per_batch=files_per_batch), name, work)


def refresh_and_analyse(spark: SparkSession, incoming: str, dataset: str, results: str, name: str, max_age_hours: float = 1.0, files_per_batch: int | None = FILES_PER_BATCH, look_back_days: float = 90) -> None:
    """One cycle: merge what arrived, then run the default detector on the units it refreshed.

    The detector reads those units' folders of the last ``look_back_days`` only. Each batch
    leaves its findings, with the units' staleness, in its own folder of ``results``, so a
    repeated batch replaces them.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        folders = folders_of(batch)
        now = batch.select(F.max("time")).scalar()
        merge_into_dataset(batch, dataset, f"{checkpoint_root(spark)}/staging/{name}", folders)
        units = writers.in_folders({(f.plant, f.unit) for f in folders}, UNIT)
        since = now - F.make_dt_interval(F.lit(int(look_back_days)))
        month = lambda y, m: y * 12 + m
        recent = month(F.col("year"), F.col("month")) >= month(F.year(since), F.month(since))
        stored = spark.read.parquet(dataset).where(units & recent & (F.col("time") >= since))
        table = detectors.sigma_runs(stored, gate=False)
        stale = health.stale_units(stored, max_age_hours, now).select(*UNIT, "age_hours", "is_stale")
        table.join(stale, list(UNIT)).write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    each_batch(read_stream(spark, incoming, files_per_batch=files_per_batch), name, work)


def monitor_fleet(spark: SparkSession, incoming: str, results: str, name: str, warn_hours: float = 0.5, limit_hours: float = 1.0, files_per_batch: int | None = FILES_PER_BATCH) -> None:
    """Newest reading per unit of a plant so far, judged after every batch.

    A batch leaves one merged row per unit, made of its own readings and the row the batch
    before it left; no earlier batch is read again.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy(*UNIT).agg(F.max("time").alias("last_time"), F.count("*").alias("records"))
        if batch_id:
            seen = seen.unionByName(spark.read.parquet(f"{results}/seen/{batch_id - 1}"))
            seen = seen.groupBy(*UNIT).agg(F.max("last_time").alias("last_time"), F.sum("records").alias("records"))
        seen.write.mode("overwrite").parquet(f"{results}/seen/{batch_id}")
        ages = spark.read.parquet(f"{results}/seen/{batch_id}")
        ages = ages.withColumn("age_hours", hours_between(ages.select(F.max("last_time")).scalar(), F.col("last_time")))
        health.judged_fleet(ages, warn_hours, limit_hours).write.mode("overwrite").parquet(f"{results}/status/batch={batch_id}")

    each_batch(read_stream(spark, incoming, files_per_batch=files_per_batch), name, work)
