"""Streaming plans over the events file, run to completion (I6 to I10), and stored layouts (S)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from plantspark.plans.inputs import READINGS, readings, shipments, SHIPMENTS, table
from plantspark.plans.registry import query
from plantspark.schema import SERIES
from plantspark.sources import readers, writers
from plantspark.streaming import pipelines


def reading_stream(spark, sf):
    raw = pipelines.read_stream(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet")
    number = F.col("user_id") % 4
    return raw.select(
        F.concat(F.lit("P-"), (number % 2).cast("string")).alias("plant"), F.concat(F.lit("U-"), number.cast("string")).alias("unit"),
        F.col("event_type").alias("tag"), F.col("ts").cast("timestamp").alias("time"), "value", F.col("event_id").alias("seq"),
    )


#: Readings in one arrival of a series counted in one task, and in one file.
BATCH_ROWS, FILE_ROWS = 4_000_000, 250_000


def arrivals(spark, sf, parts=3, late=True):
    """A folder of the readings that grows by ``parts`` arrivals by time, given after each one.

    ``late``: equal spans of time, a tenth of each comes one arrival later. Else the arrivals have about equal
    rows, and there are as many as ``BATCH_ROWS`` needs. An arrival has as many files as its rows need.
    """
    folder, _ = pipelines.scratch(spark, "arrivals")
    staged, _ = pipelines.scratch(spark, "staged")
    r = readings(spark, sf).select(*SERIES, "time", "value", "seq")
    at = F.unix_micros("time")
    if late:
        ends = r.agg(F.min(at).alias("a"), (F.max(at) + 1).alias("b")).first()
        part = F.floor((at - ends.a) * parts / (ends.b - ends.a))
        part = F.least(part + F.when(F.col("seq") % 10 == 0, 1).otherwise(0), F.lit(parts - 1))
    else:
        parts = max(parts, ceil(r.count() / BATCH_ROWS))
        ends = r.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
        part = F.size(F.filter(F.lit(ends).cast("array<long>"), lambda end: end < at))
    r.withColumn("part", part.cast("int")).hint("rebalance", F.col("part")).write.partitionBy("part").parquet(staged)
    for k in range(parts):
        rows = spark.read.parquet(staged).where(F.col("part") == k).drop("part")
        rows.write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(folder)
        yield folder


def finished(spark, stream, name):
    return arrived(spark, [None], lambda _: stream, name)


def arrived(spark, folders, plan, name):
    """What ``plan``, a stream of a folder, has written when it has gone on after every arrival."""
    target, unique = pipelines.scratch(spark, name)
    for folder in folders:
        pipelines.run_available(plan(folder), target, unique)
    return spark.read.parquet(target)


CLOSED = f"{READINGS}, mark AS (SELECT date_trunc('millisecond', max(time)) - INTERVAL 1 HOUR AS w FROM readings)"


@query("I6_stream_dedup", "plant unit tag time:t value:d", "SELECT DISTINCT plant, unit, tag, time, value FROM readings", READINGS)
def stream_dedup(spark, sf):
    """Three arrivals; late and repeated readings come within the lateness, a third of the span."""

    def twice(folder):
        stream = pipelines.read_stream(spark, folder)
        return pipelines.distinct_readings(stream.union(stream), "11 days")

    return arrived(spark, arrivals(spark, sf), twice, "dedup")


@query("I7_stream_resample", "plant unit tag bucket:t value:d records:l", """
    SELECT plant, unit, tag, time_bucket(INTERVAL 10 MINUTE, time) AS bucket, avg(value) AS value, count(*) AS records FROM readings GROUP BY plant, unit, tag, time_bucket(INTERVAL 10 MINUTE, time)
    HAVING time_bucket(INTERVAL 10 MINUTE, time) + INTERVAL 10 MINUTE <= (SELECT w FROM mark)""", CLOSED)
def stream_resample(spark, sf):
    return finished(spark, pipelines.resampled(reading_stream(spark, sf)), "resample")


@query("I8_stream_sliding", "plant unit tag window_start:t n:l mean:d std:d", """
    SELECT plant, unit, tag, s AS window_start, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM
      (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, time), time_bucket(INTERVAL 30 MINUTE, time) - INTERVAL 30 MINUTE]) AS s FROM readings) WHERE s + INTERVAL 60 MINUTE <= (SELECT w FROM mark) GROUP BY plant, unit, tag, s""", CLOSED)
def stream_sliding(spark, sf):
    return finished(spark, pipelines.sliding(reading_stream(spark, sf), "1 hour", "30 minutes"), "sliding")


@query("I9_stream_sessions", "plant unit tag session_start:t session_end:t records:l", """
    SELECT * FROM (SELECT plant, unit, tag, min(time) AS session_start, max(time) + INTERVAL 1 HOUR AS session_end, count(*) AS records FROM
      (SELECT *, sum(CASE WHEN p IS NULL OR time - p > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY plant, unit, tag ORDER BY time) AS s FROM
        (SELECT *, lag(time) OVER (PARTITION BY plant, unit, tag ORDER BY time) AS p FROM readings)) GROUP BY plant, unit, tag, s) WHERE session_end <= (SELECT w FROM mark)""", CLOSED)
def stream_sessions(spark, sf):
    return finished(spark, pipelines.sessions(reading_stream(spark, sf)), "sessions")


@query("I10_stream_run_counter", "plant unit tag time:t rows:l flagged:l run:l longest_run:l", """
    SELECT plant, unit, tag, max(time) AS time, count(*) AS rows, count(*) FILTER (f) AS flagged, coalesce(max(n) FILTER (isle = top), 0) AS run, coalesce(max(n), 0) AS longest_run FROM
      (SELECT *, max(isle) OVER (PARTITION BY plant, unit, tag) AS top, CASE WHEN f THEN count(*) FILTER (f) OVER (PARTITION BY plant, unit, tag, isle) END AS n FROM
        (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY plant, unit, tag ORDER BY time, seq) AS isle FROM
          (SELECT *, coalesce(count(*) OVER w >= 20 AND abs(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) >= 2, false) AS f FROM readings
           WINDOW w AS (PARTITION BY plant, unit, tag ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) GROUP BY plant, unit, tag""", READINGS)
def stream_run_counter(spark, sf):
    """Three batches or more in time order; the counts after the last one are those of the whole series."""
    folders = arrivals(spark, sf, late=False)
    counts = arrived(spark, folders, lambda folder: pipelines.run_counter(pipelines.read_stream(spark, folder), z=2.0), "runs")
    newest = counts.groupBy(*SERIES).agg(F.max_by(F.struct("time", "rows", "flagged", "run", "longest_run"), "rows").alias("n"))
    return newest.select(*SERIES, "n.*")


# -- stored layouts --------------------------------------------------------------------

@query("S7_partitioned_dataset", "plant unit tag time:t value:d year:l month:l", """
    SELECT plant, unit, tag, time, value, year(time) AS year, month(time) AS month FROM readings WHERE unit = 'U-1' AND time < TIMESTAMP '2024-01-15'""", READINGS)
def partitioned_dataset(spark, sf):
    """Write the hive layout, read one unit back through partition pruning."""
    target, _ = pipelines.scratch(spark, "dataset")
    writers.write_dataset(readings(spark, sf).drop("seq"), target)
    return spark.read.parquet(target).where((F.col("unit") == "U-1") & (F.col("time") < F.lit("2024-01-15").cast("timestamp")))


@query("S3_replaced_file", "plant records:l", "SELECT plant, count(*) AS records FROM shipments GROUP BY plant", SHIPMENTS)
def replaced_file(spark, sf):
    target, _ = pipelines.scratch(spark, "replace")
    writers.replace(readings(spark, sf), target)
    writers.replace(shipments(spark, sf), target)
    return readers.scan(spark, target).groupBy("plant").agg(F.count("*").alias("records"))


@query("S8_dataset_from_files", "plant unit tags:l records:l", """
    SELECT plant, unit, count(DISTINCT tag) AS tags, count(*) AS records FROM readings GROUP BY plant, unit""", READINGS)
def dataset_from_files(spark, sf):
    """Several unit files in, one partitioned dataset out."""
    base, _ = pipelines.scratch(spark, "files")
    r = readings(spark, sf).select(*SERIES, "time", "value")
    for name in ("U-0", "U-1", "U-2", "U-3"):
        writers.replace(r.where(F.col("unit") == name), f"{base}/{name}")
    writers.write_dataset(readers.scan(spark, *[f"{base}/U-{i}" for i in range(4)]), f"{base}/dataset", by_tag=True)
    return spark.read.parquet(f"{base}/dataset").groupBy("plant", "unit").agg(F.count_distinct("tag").alias("tags"), F.count("*").alias("records"))


@query("S11_exported_report", "plant unit tag records:l", "SELECT plant, unit, tag, count(*) AS records FROM readings GROUP BY plant, unit, tag", READINGS)
def exported_report(spark, sf):
    target, _ = pipelines.scratch(spark, "report")
    writers.export_report(readings(spark, sf).groupBy(*SERIES).agg(F.count("*").alias("records")), target)
    return spark.read.schema("plant string, unit string, tag string, records long").csv(f"{target}/csv", header=True)


@query("S14_versioned_copy", "unit records:l", "SELECT unit, count(*) AS records FROM readings GROUP BY unit", READINGS)
def versioned_copy(spark, sf):
    target, _ = pipelines.scratch(spark, "copy")
    writers.replace(readings(spark, sf), target)
    copy = writers.versioned_copy(spark, target, "v1")
    return spark.read.parquet(copy).groupBy("unit").agg(F.count("*").alias("records"))


@query("I4_new_files_only", "plant unit tag time:t value:d seq:l", """
    SELECT plant, unit, tag, time, value, seq FROM readings WHERE seq % 2 = 0 UNION ALL SELECT plant, unit, tag, time, CASE WHEN seq % 3 = 0 THEN value + 1 ELSE value END, seq FROM readings WHERE seq % 2 = 1""", READINGS)
def new_files_only(spark, sf):
    """Two arrivals, the second correcting part of the first, merged by the file stream."""
    base, name = pipelines.scratch(spark, "ingest")
    r = readings(spark, sf)
    first, second = r, r.where("seq % 2 = 1").withColumn("value", F.when(F.col("seq") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    for arrival in (first, second):
        arrival.write.mode("append").parquet(f"{base}/incoming")
        pipelines.ingest_new_files(spark, f"{base}/incoming", f"{base}/dataset", name)
    return spark.read.parquet(f"{base}/dataset")


CYCLE = f"""{READINGS}, src AS (SELECT 0 AS batch, * FROM readings WHERE time < TIMESTAMP '2024-01-16' UNION ALL SELECT 1, * FROM readings WHERE unit <> 'U-3'),
    rolled AS (SELECT *, count(value) OVER w AS rn, abs(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z, max(time) OVER (PARTITION BY batch) AS now FROM src
      WINDOW w AS (PARTITION BY batch, plant, unit, tag ORDER BY time RANGE BETWEEN INTERVAL '89 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)),
    flags AS (SELECT *, coalesce(rn >= 20 AND z >= 2.5, false) AS f, coalesce(rn >= 20 AND z >= 2.5, false) AND time >= now - INTERVAL 24 HOUR AS r FROM rolled),
    isles AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY batch, plant, unit, tag ORDER BY time) AS isle FROM flags),
    runs AS (SELECT batch, plant, unit, tag, max(n) AS longest_run FROM (SELECT batch, plant, unit, tag, isle, count(*) AS n FROM isles WHERE r GROUP BY ALL) GROUP BY ALL)"""


@query("I11_refresh_cycle", "plant unit tag batch:l rows:l count:l longest_run:l is_stale:b", """
    SELECT t.plant, t.unit, t.tag, t.batch, rows, count, coalesce(longest_run, 0) AS longest_run, last < now - INTERVAL 1 HOUR AS is_stale FROM
      (SELECT batch, plant, unit, tag, count(*) AS rows, count(*) FILTER (f) AS count FROM flags GROUP BY ALL) t LEFT JOIN runs USING (batch, plant, unit, tag)
      JOIN (SELECT batch, plant, unit, max(time) AS last, any_value(now) AS now FROM flags GROUP BY ALL) u USING (batch, plant, unit)""", CYCLE)
def refresh_cycle(spark, sf):
    base, name = pipelines.scratch(spark, "cycle")
    r = readings(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp")
    for arrival in (r.where(F.col("time") < half), r.where((F.col("time") >= half) & (F.col("unit") != "U-3"))):
        arrival.write.mode("append").parquet(f"{base}/incoming")
        pipelines.refresh_and_analyse(spark, f"{base}/incoming", f"{base}/dataset", f"{base}/results", name)
    return spark.read.parquet(f"{base}/results")


PARTS = f"""{READINGS}, ends AS (SELECT epoch_us(min(time)) AS a, epoch_us(max(time)) + 1 AS b FROM readings),
    parts AS (SELECT r.*, least(floor((epoch_us(time) - a) * 3.0 / (b - a)) + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END, 2) AS part FROM readings r, ends)"""


@query("I12_fleet_monitor", "plant unit batch:l records:l status", """
    SELECT plant, unit, batch, count(*) AS records, CASE WHEN a > 1 THEN 'CRITICAL' WHEN a > 0.5 THEN 'WARNING' ELSE 'FRESH' END AS status FROM
      (SELECT plant, unit, batch, date_diff('microsecond', max(time) OVER (PARTITION BY batch, plant, unit), max(time) OVER (PARTITION BY batch)) / 3.6e9 AS a FROM parts JOIN generate_series(0, 2) g(batch) ON part <= batch) GROUP BY plant, unit, batch, a""", PARTS)
def fleet_monitor(spark, sf):
    """Three batches with late readings; each status covers all readings so far."""
    base, name = pipelines.scratch(spark, "monitor")
    for folder in arrivals(spark, sf):
        pipelines.monitor_fleet(spark, folder, f"{base}/results", name)
    return spark.read.parquet(f"{base}/results/status")
