"""Sources, catalogs, summaries, set operations and merges (S, A, U, I1 to I5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark import pipeline
from plantspark.operators import aggregates as agg
from plantspark.operators import dedup, health
from plantspark.plans.inputs import INSTRUMENTS, READINGS, SHIPMENTS, instruments, readings, shipments, table
from plantspark.plans.registry import query
from plantspark.schema import SERIES, UNIT, normalise
from plantspark.sources import readers, writers
from plantspark.streaming import pipelines

SPLIT = "2024-01-20 00:00:00"


# -- sources ---------------------------------------------------------------------------

@query("S1_scan_union", "plant unit tag time:t value:d", """
    SELECT plant, unit, tag, time, value FROM readings UNION ALL SELECT plant, unit, tag, time, value FROM shipments""",
    f"{READINGS}, {SHIPMENTS}")
def scan_union(spark, sf):
    frames = [normalise(f).select(*readers.CANONICAL) for f in (readings(spark, sf), shipments(spark, sf))]
    return readers.scan_all(frames)


@query("S2_view_over_union", "plant records:l", """
    SELECT plant, count(*) AS records FROM (SELECT plant FROM readings UNION ALL SELECT plant FROM shipments) GROUP BY plant""",
    f"{READINGS}, {SHIPMENTS}")
def view_over_union(spark, sf):
    """A view over two globs, one of several files."""
    base, name = pipelines.scratch(spark, "globs")
    writers.replace(readings(spark, sf).repartition(3), f"{base}/readings")
    writers.replace(shipments(spark, sf), f"{base}/shipments")
    view = f"plantspark_{name.replace('-', '_')}"
    readers.view(spark, view, f"{base}/readings/*.parquet", f"{base}/ship*")
    counts = spark.sql(f"SELECT plant, count(*) AS records FROM {view} GROUP BY plant")
    spark.catalog.dropTempView(view)
    return counts


@query("S4_append_aligned", "plant unit tag time:t value:d quality", """
    SELECT plant, unit, tag, time, value, 'stored' AS quality FROM readings
    UNION ALL SELECT plant, unit, tag, time, value, NULL FROM shipments""", f"{READINGS}, {SHIPMENTS}")
def append_aligned(spark, sf):
    """Rows without the stored column and with one too many, appended to a stored folder."""
    path, _ = pipelines.scratch(spark, "append")
    writers.replace(readings(spark, sf).drop("seq").withColumn("quality", F.lit("stored")), path)
    writers.append(shipments(spark, sf), path)
    return spark.read.parquet(path)


WIDE = """wide AS (SELECT ts AS TIME, max(CASE WHEN event_type = 'click' THEN value END) AS click,
        max(CASE WHEN event_type = 'error' THEN value END) AS error,
        max(CASE WHEN event_type = 'purchase' THEN value END) AS "purchase.x" FROM events GROUP BY ts),
    long AS (SELECT header, split_part(header, ' ', 1) AS plant, split_part(header, ' ', 2) AS unit, replace(split_part(header, ' ', 3), '.', '_') AS tag, TIME AS time, value
      FROM (SELECT TIME, 'PLANT1 K-31-01 ' || h AS header, v AS value FROM wide UNPIVOT (v FOR h IN (click, error, "purchase.x"))))"""


def wide_export(spark, sf):
    def cell(event, name):
        return F.max(F.when(F.col("event_type") == event, F.col("value"))).alias(f"PLANT1 K-31-01 {name}")

    return table(spark, sf, "events").groupBy(F.col("ts").cast("timestamp").alias("TIME")).agg(
        cell("click", "click"), cell("error", "error"), cell("purchase", "purchase.x")
    )


@query("S5_wide_to_tidy", "header plant unit tag time:t value:d", "SELECT * FROM long", WIDE)
def wide_to_tidy(spark, sf):
    return readers.tidy(wide_export(spark, sf))


@query("T2_run_export", "plant unit tag time:t value:d alert:b", """
    SELECT plant, unit, tag, time, value, coalesce(value < 0.9 * CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END, false) AS alert
    FROM long WINDOW w AS (PARTITION BY plant, unit, tag ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", WIDE)
def run_export(spark, sf):
    """A wide export with text times, through to flagged rows on disk."""
    target, _ = pipelines.scratch(spark, "export")
    raw = wide_export(spark, sf).withColumn("TIME", F.date_format("TIME", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return pipeline.drop_alerts(spark, raw, target)


@query("S6_normalise_layout", "plant unit tag time:t value:d", """
    SELECT NULL AS plant, NULL AS unit, event_type AS tag, ts AS time,
           CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def normalise_layout(spark, sf):
    text = F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.col("value").cast("string"))
    raw = table(spark, sf, "events").select(
        F.col("ts").cast("string").alias("timestamp"), text.alias("value"), F.col("event_type").alias("tag")
    )
    return normalise(raw)


@query("S9_external_marks", "time:t", """
    SELECT DISTINCT ts AS time FROM events WHERE event_type <> 'view' AND value > 150""")
def external_marks(spark, sf):
    """A CSV list of times, some of its rows unreadable."""
    path, _ = pipelines.scratch(spark, "marks")
    text = F.when(F.col("event_type") == "view", F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    table(spark, sf, "events").where("value > 150").select(text.alias("timestamp")).write.csv(path, header=True)
    return readers.marked_times(spark, path)


@query("S10_limits_document", "unit tag lower_limit:d upper_limit:d outlier_sigma:d sensitivity", """
    SELECT unit, tag, min(value) AS lower_limit, max(value) AS upper_limit, 2.5 AS outlier_sigma,
           'HIGH_SENSITIVITY' AS sensitivity FROM readings GROUP BY unit, tag""", READINGS)
def limits_document(spark, sf):
    """One JSON limits file per unit, made from the readings and read back."""
    path, _ = pipelines.scratch(spark, "limits")
    per_tag = readings(spark, sf).groupBy("unit", "tag").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    entry = F.struct(
        F.struct(F.col("hi").alias("upper_limit"), F.col("lo").alias("lower_limit")).alias("thresholds"),
        F.lit("HIGH_SENSITIVITY").alias("sensitivity"),
    )
    document = per_tag.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("tag", entry))).alias("tag_configurations"))
    text = document.select("unit", F.to_json(F.struct("unit", "tag_configurations")).alias("value"))
    text.withColumnRenamed("unit", "file").write.partitionBy("file").text(path)
    return readers.limits_from_json(spark, path)


@query("S12_inventory", "source records:l first_time:t last_time:t tags:l", """
    SELECT plant AS source, count(*) AS records, min(time) AS first_time, max(time) AS last_time,
           count(DISTINCT tag) AS tags FROM readings GROUP BY plant""", READINGS)
def inventory(spark, sf):
    """Files of each plant, one for every share of its rows; path and size come from the files' metadata."""
    path, _ = pipelines.scratch(spark, "inventory")
    r = readings(spark, sf).withColumn("file", F.col("plant"))
    r.repartition("plant", F.pmod(F.xxhash64("unit", "tag", "time"), F.lit(16))).write.partitionBy("file").parquet(path)
    source = lambda file: F.regexp_extract(file, "file=([^/]+)/", 1).alias("source")
    files = readers.file_inventory(spark, path).where("_size > 0").groupBy(source("_file"))
    counts = files.agg(F.sum("records").alias("records"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    tags = spark.read.parquet(path).select(source("_metadata.file_path"), "tag").groupBy("source").agg(F.count_distinct("tag").alias("tags"))
    return counts.join(tags, "source")


@query("S13_master_merge", "time:t tag unit value:d", """
    SELECT time, tag, unit, value FROM readings WHERE plant = 'P-0'
    UNION ALL SELECT time, tag, unit, value FROM readings WHERE plant = 'P-1'""", READINGS)
def master_merge(spark, sf):
    """Two batch files merged into one master, read back."""
    base, _ = pipelines.scratch(spark, "master")
    r = readings(spark, sf)
    for plant in ("P-0", "P-1"):
        writers.replace(r.where(F.col("plant") == plant), f"{base}/{plant}")
    writers.merge_files(spark, [f"{base}/P-0", f"{base}/P-1"], f"{base}/master")
    return readers.scan(spark, f"{base}/master")


# -- aggregates ------------------------------------------------------------------------

@query("A1_tag_catalog", "plant unit tag first_time:t last_time:t records:l", """
    SELECT plant, unit, tag, min(time) AS first_time, max(time) AS last_time, count(*) AS records
    FROM shipments GROUP BY plant, unit, tag""", SHIPMENTS)
def tag_catalog(spark, sf):
    return agg.tag_catalog(shipments(spark, sf))


@query("A2_unit_catalog", "plant unit first_time:t last_time:t records:l tags:l", """
    SELECT plant, unit, min(time) AS first_time, max(time) AS last_time, count(*) AS records, count(DISTINCT tag) AS tags
    FROM shipments GROUP BY plant, unit""", SHIPMENTS)
def unit_catalog(spark, sf):
    return agg.unit_catalog(shipments(spark, sf))


@query("A3_tag_summary", "tag n:l mean:d std:d min:d max:d first_time:t last_time:t", """
    SELECT tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
           min(time) AS first_time, max(time) AS last_time FROM readings GROUP BY tag""", READINGS)
def tag_summary(spark, sf):
    return agg.tag_summary(readings(spark, sf))


@query("A4_database_status", "records:l first_time:t last_time:t tags:l plants:l units:l", """
    SELECT count(*) AS records, min(time) AS first_time, max(time) AS last_time, count(DISTINCT tag) AS tags,
           count(DISTINCT plant) AS plants, count(DISTINCT unit) AS units FROM shipments""", SHIPMENTS)
def database_status(spark, sf):
    return agg.database_status(shipments(spark, sf))


@query("A5_recent_activity", "tag last_time:t records:l", """
    SELECT tag, max(time) AS last_time, count(*) AS records FROM instruments
    WHERE time >= (SELECT max(time) FROM instruments) - INTERVAL 24 HOUR
    GROUP BY tag ORDER BY last_time DESC, tag LIMIT 10""", INSTRUMENTS)
def recent_activity(spark, sf):
    return agg.recent_activity(instruments(spark, sf))


@query("A6_latest_times", "plant unit tag last_time:t",
    "SELECT plant, unit, tag, max(time) AS last_time FROM shipments GROUP BY plant, unit, tag", SHIPMENTS)
def latest_times(spark, sf):
    return agg.latest_times(shipments(spark, sf))


@query("A7_unit_analytics", "plant unit records:l hours_covered:d mean:d std:d min:d max:d latest_value:d value_range:d threshold:d above_count:l above_percent:d latest_above:t", """
    SELECT b.*, coalesce(above, 0) AS above_count, coalesce(above, 0) * 100.0 / records AS above_percent, latest_above FROM
      (SELECT plant, unit, count(*) AS records, date_diff('microsecond', min(time), max(time)) / 3.6e9 AS hours_covered,
              avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
              arg_max(value, (time, tag)) AS latest_value, max(value) - min(value) AS value_range,
              avg(value) + 3 * stddev_samp(value) AS threshold FROM readings GROUP BY plant, unit) b
    LEFT JOIN (SELECT r.plant, r.unit, count(*) AS above, max(time) AS latest_above FROM readings r JOIN
              (SELECT plant, unit, avg(value) + 3 * stddev_samp(value) AS t FROM readings GROUP BY plant, unit) l
               ON r.plant = l.plant AND r.unit = l.unit WHERE value > t GROUP BY r.plant, r.unit) a
      ON a.plant = b.plant AND a.unit = b.unit""", READINGS)
def unit_analytics(spark, sf):
    return agg.unit_analytics(readings(spark, sf))


@query("A8_most_active_tags", "tag records:l",
    "SELECT tag, count(*) AS records FROM instruments GROUP BY tag ORDER BY records DESC, tag LIMIT 10", INSTRUMENTS)
def most_active(spark, sf):
    return agg.most_active(instruments(spark, sf))


@query("A9_unit_profile", "plant unit tags:l tag_min:l tag_max:l tag_mean:d tag_median:d records:l value_min:d value_max:d value_mean:d value_median:d value_std:d null_percent:d duplicates:l", """
    SELECT v.*, tags, tag_min, tag_max, tag_mean, tag_median, v.records - keys AS duplicates FROM
      (SELECT plant, unit, count(*) AS records, min(value) AS value_min, max(value) AS value_max, avg(value) AS value_mean,
              median(value) AS value_median, stddev_samp(value) AS value_std,
              count(*) FILTER (value IS NULL) * 100.0 / count(*) AS null_percent,
              count(DISTINCT (tag, time)) AS keys FROM shipments GROUP BY plant, unit) v
    JOIN (SELECT plant, unit, count(*) AS tags, min(n) AS tag_min, max(n) AS tag_max, avg(n) AS tag_mean, median(n) AS tag_median
          FROM (SELECT plant, unit, tag, count(*) AS n FROM shipments GROUP BY plant, unit, tag) GROUP BY plant, unit) t
      ON v.plant = t.plant AND v.unit = t.unit""", SHIPMENTS)
def unit_profile(spark, sf):
    return agg.unit_profile(shipments(spark, sf))


@query("A10_compare_units", "unit records:l tags:l first_time:t last_time:t mean:d std:d", """
    SELECT unit, count(*) AS records, count(DISTINCT tag) AS tags, min(time) AS first_time, max(time) AS last_time,
           avg(value) AS mean, stddev_samp(value) AS std FROM readings GROUP BY unit""", READINGS)
def compare_units(spark, sf):
    return agg.compare_units(readings(spark, sf))


@query("A11_daily_counts", "day:D records:l", """
    SELECT CAST(time AS DATE) AS day, count(*) AS records FROM readings
    WHERE time >= (SELECT max(time) FROM readings) - INTERVAL 10 DAY GROUP BY day""", READINGS)
def daily_counts(spark, sf):
    return agg.daily_counts(readings(spark, sf))


@query("A12_comprehensive", "plant unit tag n:l mean:d median:d std:d var:d min:d max:d range:d q1:d q3:d iqr:d skew:d kurtosis:d span_days:d", """
    SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
           var_samp(value) AS var, min(value) AS min, max(value) AS max, max(value) - min(value) AS range,
           quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
           quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, skewness(value) AS skew, kurtosis(value) AS kurtosis,
           date_diff('microsecond', min(time), max(time)) / 8.64e10 AS span_days
    FROM readings GROUP BY plant, unit, tag""", READINGS)
def comprehensive(spark, sf):
    return agg.comprehensive(readings(spark, sf))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("A13_pivot_by_tag", "plant unit time:t click:d error:d purchase:d signup:d view:d", """
    SELECT plant, unit, date_trunc('hour', time) AS time, avg(value) FILTER (tag = 'click') AS click,
           avg(value) FILTER (tag = 'error') AS error, avg(value) FILTER (tag = 'purchase') AS purchase,
           avg(value) FILTER (tag = 'signup') AS signup, avg(value) FILTER (tag = 'view') AS view
    FROM readings GROUP BY plant, unit, date_trunc('hour', time)""", READINGS)
def pivot_by_tag(spark, sf):
    hourly = readings(spark, sf).withColumn("time", F.date_trunc("hour", "time"))
    return agg.pivot_by_tag(hourly, EVENT_TYPES)


@query("A14_resample", "plant unit tag bucket:t value:d", """
    SELECT plant, unit, tag, time_bucket(INTERVAL 10 MINUTE, time) AS bucket, avg(value) AS value
    FROM readings GROUP BY plant, unit, tag, bucket""", READINGS)
def resample(spark, sf):
    return agg.resample(readings(spark, sf), 10)


@query("A14_resample_filled", "plant unit tag bucket:t value:d", """
    SELECT plant, unit, tag, bucket, last_value(value IGNORE NULLS) OVER (PARTITION BY plant, unit, tag ORDER BY bucket
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM (SELECT g.plant, g.unit, g.tag, g.bucket, m.value FROM
            (SELECT plant, unit, tag, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket
             FROM means GROUP BY plant, unit, tag) g
          LEFT JOIN means m USING (plant, unit, tag, bucket))""",
    f"""{READINGS}, means AS (SELECT plant, unit, tag, date_trunc('hour', time) AS bucket, avg(value) AS value
        FROM readings GROUP BY plant, unit, tag, date_trunc('hour', time))""")
def resample_filled(spark, sf):
    return agg.resample_filled(readings(spark, sf), 60)


@query("A15_value_frequencies", "plant unit tag value:d count:l percent:d", """
    SELECT plant, unit, tag, value, count, count * 100.0 / n AS percent FROM
      (SELECT *, count(*) OVER (PARTITION BY plant, unit, tag) AS d, sum(count) OVER (PARTITION BY plant, unit, tag) AS n FROM
        (SELECT plant, unit, tag, floor(value / 100) * 100 AS value, count(*) AS count FROM readings GROUP BY ALL)) WHERE d <= 10""", READINGS)
def value_frequencies(spark, sf):
    return agg.value_frequencies(readings(spark, sf).withColumn("value", (F.floor(F.col("value") / 100) * 100).cast("double")))


@query("A16_update_metadata", "plant unit tag last_update:t record_count:l",
    "SELECT plant, unit, tag, max(time) AS last_update, count(*) AS record_count FROM readings GROUP BY plant, unit, tag", READINGS)
def update_metadata(spark, sf):
    r = readings(spark, sf)
    stored, new = (agg.update_metadata(r.where(F.col("time").cast("string") < SPLIT)), agg.update_metadata(r.where(F.col("time").cast("string") >= SPLIT)))
    return agg.merge_metadata(stored, new)


@query("A17_scan_summary", "total_units:l fresh_units:l stale_units:l empty_units:l", """
    SELECT count(*) AS total_units, count(*) FILTER (age <= 24) AS fresh_units, count(*) FILTER (age > 24) AS stale_units,
           count(*) FILTER (age IS NULL) AS empty_units FROM
      (SELECT u.unit, date_diff('microsecond', t, (SELECT max(time) FROM shipments)) / 3.6e9 AS age FROM
         (SELECT 'S-' || s_suppkey AS unit FROM supplier UNION ALL SELECT 'X-' || n_nationkey FROM nation) u
       LEFT JOIN (SELECT unit, max(time) AS t FROM shipments GROUP BY unit) s ON u.unit = s.unit)""", SHIPMENTS)
def scan_summary(spark, sf):
    units = table(spark, sf, "supplier").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("unit"))
    spare = table(spark, sf, "nation").select(F.concat(F.lit("X-"), F.col("n_nationkey").cast("string")).alias("unit"))
    return agg.scan_summary(shipments(spark, sf), units.unionAll(spare), max_age_hours=24)


@query("A18_interval_stats", "plant unit tag mean_interval_hours:d largest_gap_hours:d", """
    SELECT plant, unit, tag, avg(gap) AS mean_interval_hours, max(gap) AS largest_gap_hours FROM
      (SELECT plant, unit, tag, date_diff('microsecond', lag(time) OVER (PARTITION BY plant, unit, tag ORDER BY time), time) / 3.6e9 AS gap
       FROM readings) GROUP BY plant, unit, tag""", READINGS)
def interval_stats(spark, sf):
    return agg.interval_stats(readings(spark, sf))


# -- set operations and merges ---------------------------------------------------------

@query("U1_union_ordered", "plant unit tag time:t value:d",
    "SELECT plant, unit, tag, time, value FROM readings UNION ALL SELECT plant, unit, tag, time, value FROM shipments",
    f"{READINGS}, {SHIPMENTS}")
def union_ordered(spark, sf):
    return readers.scan_all([readings(spark, sf), shipments(spark, sf)]).orderBy("time", *SERIES, "seq")


FIRST_COPY = """SELECT plant, unit, tag, time, arg_min(value, seq) AS value, min(seq) AS seq FROM shipments GROUP BY plant, unit, tag, time"""


@query("U2_dedup_any", "plant unit tag time:t value:d seq:l", FIRST_COPY, SHIPMENTS)
def dedup_any(spark, sf):
    return dedup.any_copy(shipments(spark, sf))


@query("U3_dedup_keep_first", "plant unit tag time:t value:d seq:l", FIRST_COPY, SHIPMENTS)
def dedup_first(spark, sf):
    return dedup.keep_first(shipments(spark, sf))


HALVES = f"{SHIPMENTS}, old AS (SELECT * FROM shipments WHERE seq % 3 <> 0), fresh AS (SELECT * FROM shipments WHERE seq % 3 = 0 OR seq % 5 = 0)"


def halves(spark, sf):
    s = shipments(spark, sf)
    return s.where(F.col("seq") % 3 != 0), s.where((F.col("seq") % 3 == 0) | (F.col("seq") % 5 == 0))


@query("U4_merge_new_wins", "plant unit tag time:t value:d seq:l", """
    SELECT plant, unit, tag, time, arg_max(value, (side, seq)) AS value, arg_max(seq, (side, seq)) AS seq
    FROM (SELECT *, 0 AS side FROM old UNION ALL SELECT *, 1 AS side FROM fresh) GROUP BY plant, unit, tag, time""", HALVES)
def merge_new_wins(spark, sf):
    return dedup.merge_new_wins(*halves(spark, sf))


@query("U5_insert_or_ignore", "plant unit tag time:t value:d seq:l", """
    SELECT * FROM old UNION ALL
    SELECT plant, unit, tag, time, arg_min(value, seq) AS value, min(seq) AS seq FROM fresh f
    WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.plant = f.plant AND o.unit = f.unit AND o.tag = f.tag AND o.time = f.time)
    GROUP BY plant, unit, tag, time""", HALVES)
def insert_or_ignore(spark, sf):
    return dedup.insert_or_ignore(*halves(spark, sf))


@query("U6_duplicate_count", "unit records:l duplicates:l",
    "SELECT unit, count(*) AS records, count(*) - count(DISTINCT (time, tag)) AS duplicates FROM shipments GROUP BY unit", SHIPMENTS)
def duplicate_count(spark, sf):
    return dedup.duplicate_count(shipments(spark, sf), by=("unit",))


OLD_NEW = f"""{READINGS}, old AS (SELECT * FROM readings WHERE time < TIMESTAMP '{SPLIT}' - INTERVAL 1 DAY * (seq % 3) AND tag <> 'view'),
    latest AS (SELECT plant, unit, tag, max(time) AS latest FROM old GROUP BY plant, unit, tag),
    after AS (SELECT r.* FROM readings r LEFT JOIN latest l USING (plant, unit, tag)
              WHERE r.time > coalesce(l.latest, (SELECT min(latest) FROM latest)))"""


def old_and_all(spark, sf):
    r = readings(spark, sf)
    limit = F.lit(SPLIT).cast("timestamp") - F.make_dt_interval((F.col("seq") % 3).cast("int"))
    return r.where((F.col("time") < limit) & (F.col("tag") != "view")), r


@query("J11_rows_after_latest", "plant unit tag time:t value:d seq:l", "SELECT * FROM after", OLD_NEW)
def rows_after_latest(spark, sf):
    return dedup.new_rows(*old_and_all(spark, sf))


@query("I1_incremental_merge", "plant unit tag time:t value:d seq:l", """
    SELECT plant, unit, tag, time, arg_max(value, (side, seq)) AS value, arg_max(seq, (side, seq)) AS seq
    FROM (SELECT *, 0 AS side FROM old UNION ALL SELECT *, 1 AS side FROM after) GROUP BY plant, unit, tag, time""", OLD_NEW)
def incremental_merge(spark, sf):
    return dedup.merge_incremental(*old_and_all(spark, sf))


@query("I2_single_series_merge", "unit time:t value:d seq:l", """
    SELECT unit, time, arg_max(value, (side, seq)) AS value, arg_max(seq, (side, seq)) AS seq
    FROM (SELECT *, 0 AS side FROM old UNION ALL SELECT *, 1 AS side FROM fresh) GROUP BY unit, time""", HALVES)
def single_series_merge(spark, sf):
    old, new = (f.select("unit", "time", "value", "seq") for f in halves(spark, sf))
    return dedup.merge_new_wins(old, new, ("unit", "time"))


@query("I3_tag_state", "plant unit tag last_time:t behind_hours:d", """
    SELECT plant, unit, tag, last_time, date_diff('microsecond', last_time, max(last_time) OVER (PARTITION BY plant, unit)) / 3.6e9 AS behind_hours
    FROM (SELECT plant, unit, tag, max(time) AS last_time FROM readings GROUP BY plant, unit, tag)""", READINGS)
def tag_state(spark, sf):
    return health.tag_state(readings(spark, sf))


@query("I5_backfill_windows", "unit window_no:l window_start:t window_end:t", """
    SELECT unit, i AS window_no, e - INTERVAL 1 DAY * least(30 * (i + 1), 365) AS window_start, e - INTERVAL 1 DAY * (30 * i) AS window_end
    FROM (SELECT unit, max(time) AS e FROM shipments GROUP BY unit), generate_series(0, 12) s(i)""", SHIPMENTS)
def backfill_windows(spark, sf):
    return health.backfill_windows(shipments(spark, sf).groupBy("unit").agg(F.max("time").alias("end")), 365, 30)


@query("J10_units_with_news", "unit last_time:t", f"""
    SELECT u.unit, t AS last_time FROM (SELECT unit, max(time) AS t FROM readings GROUP BY unit) u
    LEFT JOIN (SELECT unit, max(time) AS seen FROM readings WHERE time < TIMESTAMP '{SPLIT}' AND unit <> 'U-3' GROUP BY unit
               UNION ALL SELECT 'U-0', TIMESTAMP '2025-01-01') s ON s.unit = u.unit
    GROUP BY u.unit, t HAVING t > coalesce(max(seen), TIMESTAMP '1900-01-01')""", READINGS)
def units_with_news(spark, sf):
    r = readings(spark, sf)
    seen = r.where((F.col("time") < F.lit(SPLIT).cast("timestamp")) & (F.col("unit") != "U-3")).groupBy("unit").agg(F.max("time").alias("seen"))
    ahead = r.where("unit = 'U-0'").groupBy("unit").agg(F.lit("2025-01-01").cast("timestamp").alias("seen"))
    state = seen.unionAll(ahead).groupBy("unit").agg(F.max("seen").alias("seen"))
    return health.units_with_news(r, state)
