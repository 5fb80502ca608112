"""Freshness, gaps and data quality (H, I9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.operators import aggregates as agg
from plantspark.operators import detectors, health
from plantspark.plans.inputs import INSTRUMENTS, READINGS, SHIPMENTS, instruments, readings, shipments, table
from plantspark.plans.registry import query
from plantspark.schema import SERIES

FRESH = f"""{SHIPMENTS}, ages AS (SELECT plant, unit, tag, min(time) AS first_time, max(time) AS last_time, count(*) AS records,
      date_diff('microsecond', max(time), (SELECT max(time) FROM shipments)) / 3.6e9 AS age_hours FROM shipments GROUP BY plant, unit, tag),
    levels AS (SELECT *, age_hours / 24 AS age_days, date_diff('microsecond', first_time, last_time) / 8.64e10 AS span_days, age_hours > 24 AS is_stale,
      CASE WHEN age_hours <= 24 THEN 'FRESH' WHEN age_hours <= 48 THEN 'MILDLY_STALE' WHEN age_hours <= 168 THEN 'STALE' ELSE 'SEVERELY_STALE' END AS level FROM ages)"""
FRESH_COLS = "plant unit tag first_time:t last_time:t records:l age_hours:d age_days:d span_days:d is_stale:b level"


@query("H1_tag_freshness", FRESH_COLS, "SELECT * FROM levels", FRESH)
def tag_freshness(spark, sf):
    return health.tag_freshness(shipments(spark, sf))


@query("H1_freshness_summary", "total_tags:l fresh_tags:l stale_tags:l fresh_percent:d fresh:l mildly_stale:l stale:l severely_stale:l", """
    SELECT count(*) AS total_tags, count(*) FILTER (NOT is_stale) AS fresh_tags, count(*) FILTER (is_stale) AS stale_tags, count(*) FILTER (NOT is_stale) * 100.0 / count(*) AS fresh_percent,
           count(*) FILTER (level = 'FRESH') AS fresh, count(*) FILTER (level = 'MILDLY_STALE') AS mildly_stale, count(*) FILTER (level = 'STALE') AS stale,
           count(*) FILTER (level = 'SEVERELY_STALE') AS severely_stale FROM levels""", FRESH)
def freshness_summary(spark, sf):
    return health.freshness_summary(shipments(spark, sf))


@query("H2_stale_tags", FRESH_COLS, "SELECT * FROM levels WHERE is_stale ORDER BY age_hours DESC, plant, unit, tag", FRESH)
def stale_tags(spark, sf):
    return health.stale_tags(shipments(spark, sf))


@query("H3_freshness_with_metadata", "plant unit tag last_time:t last_update:t record_count:l age_hours:d is_stale:b", """
    SELECT a.plant, a.unit, a.tag, a.last_time, m.last_update, m.record_count, age_hours, age_hours > 1 AS is_stale FROM ages a
    LEFT JOIN (SELECT plant, unit, tag, max(time) AS last_update, count(*) AS record_count FROM shipments WHERE tag <> 'NO' GROUP BY ALL) m USING (plant, unit, tag)""", FRESH)
def freshness_with_metadata(spark, sf):
    s = shipments(spark, sf)
    return health.freshness_with_metadata(s, agg.update_metadata(s.where("tag <> 'NO'")))


WANTED = f"""{FRESH}, wanted AS (SELECT plant, unit, tag FROM ages UNION ALL SELECT plant, unit, tag || '-new' FROM ages WHERE tag = 'AF'),
    decided AS (SELECT w.plant, w.unit, w.tag, last_time, age_hours, age_hours IS NULL OR age_hours > 48 AS "fetch" FROM wanted w LEFT JOIN ages a USING (plant, unit, tag))"""


def wanted_tags(spark, sf):
    have = shipments(spark, sf).select(*SERIES).distinct()
    return have.unionAll(have.where("tag = 'AF'").withColumn("tag", F.concat("tag", F.lit("-new"))))


@query("H4_fetch_decisions", "plant unit tag last_time:t age_hours:d fetch:b", "SELECT * FROM decided", WANTED)
def fetch_decisions(spark, sf):
    return health.fetch_decisions(wanted_tags(spark, sf), shipments(spark, sf), 48)


@query("H5_scan_plan", "plant unit tags:l to_fetch:l cached:l cached_rate:d", """
    SELECT plant, unit, count(*) AS tags, count(*) FILTER (WHERE "fetch") AS to_fetch, count(*) FILTER (WHERE NOT "fetch") AS cached, count(*) FILTER (WHERE NOT "fetch") * 1.0 / count(*) AS cached_rate
    FROM decided GROUP BY plant, unit""", WANTED)
def scan_plan(spark, sf):
    return health.scan_plan(wanted_tags(spark, sf), shipments(spark, sf), 48)


@query("H6_unit_fresh_by_tags", "plant unit tags:l fresh_tags:l is_fresh:b", """
    SELECT plant, unit, count(*) AS tags, count(*) FILTER (age_hours < 480) AS fresh_tags, count(*) FILTER (age_hours < 480) * 1.0 / count(*) >= 0.5 AS is_fresh
    FROM decided GROUP BY plant, unit""", WANTED)
def unit_fresh_by_tags(spark, sf):
    return health.unit_fresh_by_tags(wanted_tags(spark, sf), shipments(spark, sf), 480)


@query("H7_tag_activity", "plant unit total_tags:l active_tags:l",
    "SELECT plant, unit, count(*) AS total_tags, count(*) FILTER (age_hours < 240) AS active_tags FROM ages GROUP BY plant, unit", FRESH)
def tag_activity(spark, sf):
    return health.tag_activity(shipments(spark, sf), 10)


FLEET = f"""{READINGS}, fleet AS (SELECT unit, count(*) AS records, max(time) AS last_time, date_diff('microsecond', max(time), (SELECT max(time) FROM readings)) / 3.6e9 AS age_hours FROM readings GROUP BY unit),
    judged AS (SELECT *, CASE WHEN age_hours > 1 THEN 'CRITICAL' WHEN age_hours > 0.1 THEN 'WARNING' ELSE 'FRESH' END AS status,
      CASE WHEN age_hours > 1 THEN printf('Data age %.1fh exceeds 1.0h limit', age_hours) WHEN age_hours > 0.1 THEN printf('Data age %.1fh approaching limit', age_hours) END AS alert FROM fleet)"""


@query("H8_fleet_status", "unit records:l last_time:t age_hours:d status alert", "SELECT * FROM judged", FLEET)
def fleet_status(spark, sf):
    return health.fleet_status(readings(spark, sf), 0.1, 1.0)


@query("H8_fleet_summary", "total_units:l fresh_units:l warning_units:l critical_units:l overall_status freshness_rate:d", """
    SELECT count(*) AS total_units, count(*) FILTER (status = 'FRESH') AS fresh_units, count(*) FILTER (status = 'WARNING') AS warning_units, count(*) FILTER (status = 'CRITICAL') AS critical_units,
           CASE WHEN bool_or(status = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'FRESH' END AS overall_status,
           count(*) FILTER (status = 'FRESH') * 1.0 / count(*) AS freshness_rate FROM judged""", FLEET)
def fleet_summary(spark, sf):
    return health.fleet_summary(fleet_status(spark, sf))


@query("H9_stale_units", "plant unit records:l age_hours:d is_stale:b", """
    SELECT plant, unit, count(*) AS records, date_diff('microsecond', max(time), (SELECT max(time) FROM shipments)) / 3.6e9 AS age_hours,
           date_diff('microsecond', max(time), (SELECT max(time) FROM shipments)) / 3.6e9 > 24 AS is_stale FROM shipments GROUP BY plant, unit ORDER BY age_hours DESC, plant, unit""", SHIPMENTS)
def stale_units(spark, sf):
    return health.stale_units(shipments(spark, sf), 24)


MAYBE_UNITS = "known AS (SELECT DISTINCT 'U-' || (c_custkey % 6) AS unit FROM customer)"


def maybe_units(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("U-"), (F.col("c_custkey") % 6).cast("string")).alias("unit")).distinct()


@query("H10_freshness_report", "unit records:l tags:l last_time:t age_hours:d", """
    SELECT k.unit, records, tags, last_time, date_diff('microsecond', last_time, (SELECT max(time) FROM readings)) / 3.6e9 AS age_hours FROM known k LEFT JOIN
      (SELECT unit, count(*) AS records, count(DISTINCT tag) AS tags, max(time) AS last_time FROM readings GROUP BY unit) r ON r.unit = k.unit""", f"{READINGS}, {MAYBE_UNITS}")
def freshness_report(spark, sf):
    return health.freshness_report(maybe_units(spark, sf), readings(spark, sf))


@query("H11_unit_health", "unit has_data:b records:l tags:l first_time:t last_time:t epoch_dates:b age_hours:d status", """
    SELECT unit, records IS NOT NULL AS has_data, coalesce(records, 0) AS records, coalesce(tags, 0) AS tags, first_time, last_time, coalesce(year(first_time) = 1970, false) AS epoch_dates,
           age_hours, CASE WHEN age_hours IS NULL THEN 'NO_DATA' WHEN age_hours < 2 THEN 'FRESH' WHEN age_hours < 24 THEN 'STALE' ELSE 'VERY_STALE' END AS status FROM
      (SELECT k.unit, r.* EXCLUDE (unit), date_diff('microsecond', last_time, (SELECT max(time) FROM readings)) / 3.6e9 AS age_hours FROM known k LEFT JOIN
        (SELECT unit, count(*) AS records, count(DISTINCT tag) AS tags, min(time) AS first_time, max(time) AS last_time FROM readings WHERE unit <> 'U-2' OR time < TIMESTAMP '2024-01-20' GROUP BY unit) r ON r.unit = k.unit)""",
    f"{READINGS}, {MAYBE_UNITS}")
def unit_health(spark, sf):
    r = readings(spark, sf)
    partial = r.where((F.col("unit") != "U-2") | (F.col("time") < F.lit("2024-01-20").cast("timestamp")))
    end = r.select(F.max("time")).scalar()
    return health.unit_health(maybe_units(spark, sf), partial, as_of=end)


GAPS = f"""{READINGS}, gaps AS (SELECT plant, unit, tag, p AS gap_start, time AS gap_end, h AS gap_hours, CAST(floor(h) AS BIGINT) AS expected_points, pv AS value_before, value AS value_after,
      (pv - value) / nullif(pv, 0) * 100 AS drop_percent, CASE WHEN h > 24 THEN 'SHUTDOWN' WHEN h > 4 THEN 'DATA_INTERRUPTION' ELSE 'MINOR' END AS diagnosis FROM
      (SELECT *, date_diff('microsecond', p, time) / 3.6e9 AS h FROM (SELECT *, lag(time) OVER w AS p, lag(value) OVER w AS pv FROM readings WINDOW w AS (PARTITION BY plant, unit, tag ORDER BY time)))
    WHERE h > 1)"""


@query("H12_gaps", "plant unit tag gap_start:t gap_end:t gap_hours:d expected_points:l value_before:d value_after:d drop_percent:d diagnosis", "SELECT * FROM gaps", GAPS)
def gaps(spark, sf):
    """H12 with H15 (value drop) and X26 (diagnosis)."""
    return health.gaps(readings(spark, sf))


@query("H13_unit_gaps", "plant unit total_tags:l tags_with_gaps:l total_gaps:l gap_hours:d", """
    SELECT plant, unit, count(*) AS total_tags, count(g) AS tags_with_gaps, coalesce(sum(g), 0) AS total_gaps, coalesce(sum(h), 0) AS gap_hours FROM (SELECT DISTINCT plant, unit, tag FROM readings)
    LEFT JOIN (SELECT plant, unit, tag, count(*) AS g, sum(gap_hours) AS h FROM gaps GROUP BY plant, unit, tag) USING (plant, unit, tag) GROUP BY plant, unit""", GAPS)
def unit_gaps(spark, sf):
    return health.unit_gaps(readings(spark, sf))


@query("H14_fetch_preview", "month gaps:l hours:d points:l",
    "SELECT strftime(gap_start, '%Y-%m') AS month, count(*) AS gaps, sum(gap_hours) AS hours, sum(expected_points) AS points FROM gaps GROUP BY month", GAPS)
def fetch_preview(spark, sf):
    return health.fetch_preview(health.gaps(readings(spark, sf)))


@query("H15_gap_value_drop", "plant unit tag gap_start:t drop_percent:d diagnosis", "SELECT plant, unit, tag, gap_start, drop_percent, diagnosis FROM gaps", GAPS)
def gap_value_drop(spark, sf):
    return health.gaps(readings(spark, sf))


@query("H16_validate_window", "plant unit tag records:l null_count:l largest_gap_hours:d warnings", """
    SELECT plant, unit, tag, records, null_count, g AS largest_gap_hours, coalesce(concat_ws(',', CASE WHEN a > TIMESTAMP '2024-01-01 06:00:00' THEN 'starts_late' END, CASE WHEN b < TIMESTAMP '2024-01-30 23:00:00' THEN 'ends_early' END,
             CASE WHEN null_count > 0 THEN 'null_values' END, CASE WHEN lo = hi THEN 'constant' END, CASE WHEN g > 2 THEN 'large_gap' END), '') AS warnings FROM
      (SELECT plant, unit, tag, count(*) AS records, count(*) FILTER (value IS NULL) AS null_count, min(time) AS a, max(time) AS b, min(value) AS lo, max(value) AS hi, max(date_diff('microsecond', p, time) / 3.6e9) AS g FROM
        (SELECT plant, unit, tag, time, CASE WHEN value > 250 THEN NULL ELSE value END AS value, lag(time) OVER (PARTITION BY plant, unit, tag ORDER BY time) AS p FROM readings) GROUP BY plant, unit, tag)""", READINGS)
def validate_window(spark, sf):
    r = readings(spark, sf).withColumn("value", F.when(~(F.col("value") > 250), F.col("value")))
    out = health.validate_window(r, "2024-01-01 06:00:00", "2024-01-30 23:00:00")
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("H17_file_validation", "unit records:l tag_nulls:l value_nulls:l non_numeric:l", """
    SELECT unit, count(*) AS records, count(*) FILTER (tag IS NULL) AS tag_nulls, count(*) FILTER (v IS NULL) AS value_nulls, count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS non_numeric FROM
      (SELECT unit, nullif(tag, 'view') AS tag, CASE WHEN seq % 7 = 0 THEN 'bad' WHEN seq % 11 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS v FROM readings) GROUP BY unit""", READINGS)
def file_validation(spark, sf):
    text = F.when(F.col("seq") % 7 == 0, "bad").when(F.col("seq") % 11 != 0, F.col("value").cast("string"))
    raw = readings(spark, sf).select("unit", F.nullif("tag", F.lit("view")).alias("tag"), text.alias("value"))
    return health.file_validation(raw, ["unit"])


@query("H18_repair", "plant unit tag time:t value:d repaired:d", """
    SELECT plant, unit, tag, time, value, coalesce(last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS repaired
    FROM (SELECT plant, unit, tag, time, CASE WHEN seq % 4 <> 0 THEN value END AS value FROM readings) WINDOW w AS (PARTITION BY plant, unit, tag ORDER BY time)""", READINGS)
def repair(spark, sf):
    return health.repair(readings(spark, sf).withColumn("value", F.when(F.col("seq") % 4 != 0, F.col("value"))))


HEALTH = f"""{READINGS}, bad AS (SELECT plant, unit, tag, time, seq, CASE WHEN tag = 'view' AND seq % 3 > 0 THEN NULL WHEN tag = 'signup' THEN floor(value / 400) ELSE value END AS value FROM readings
      WHERE NOT (tag = 'error' AND unit = 'U-1' AND time > TIMESTAMP '2024-01-28')),
    st AS (SELECT plant, unit, tag, count(*) AS records, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max, max(time) AS t FROM bad GROUP BY plant, unit, tag),
    rates AS (SELECT plant, unit, tag, count(*) FILTER (value > 110) * 1.0 / count(*) AS rate FROM bad GROUP BY plant, unit, tag),
    flat AS (SELECT plant, unit, tag, count(DISTINCT value) AS d FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit, tag ORDER BY time DESC, seq DESC) AS rn FROM bad WHERE value IS NOT NULL) WHERE rn <= 50 GROUP BY plant, unit, tag),
    spk AS (SELECT plant, unit, tag, count(*) AS k FROM bad JOIN st USING (plant, unit, tag) WHERE abs(value - mean) > 3 * sd GROUP BY plant, unit, tag),
    facts AS (SELECT plant, unit, tag, n, (records - n) * 100.0 / records AS missing_percent, date_diff('microsecond', t, (SELECT max(time) FROM bad)) / 3.6e9 AS age_hours, mean, sd, min, max, n >= 10 AND d <= 2 AS is_flatline,
      n >= 10 AND sd > 0 AND coalesce(k, 0) * 1.0 / n > 0.05 AS has_spikes, CASE WHEN abs(mean) > 0.01 THEN sd > abs(mean) * 0.3 ELSE false END AS high_variance, coalesce(rate, 0) * 100 AS anomaly_percent
      FROM st LEFT JOIN flat USING (plant, unit, tag) LEFT JOIN spk USING (plant, unit, tag) LEFT JOIN rates USING (plant, unit, tag)),
    states AS (SELECT * EXCLUDE (i), CASE WHEN n = 0 THEN 'NO_DATA' WHEN len(i) = 0 THEN 'HEALTHY' WHEN len(i) = 1 AND anomaly_percent < 10 THEN 'WARNING' ELSE 'CRITICAL' END AS status, array_to_string(i, ',') AS issues FROM
      (SELECT *, list_filter([CASE WHEN age_hours > 24 THEN 'data_age' END, CASE WHEN missing_percent > 50 THEN 'missing_data' END, CASE WHEN is_flatline THEN 'flatline' END, CASE WHEN has_spikes THEN 'spikes' END,
         CASE WHEN anomaly_percent > 10 THEN 'high_anomaly_rate' WHEN anomaly_percent > 5 THEN 'elevated_anomaly_rate' END], lambda x: x IS NOT NULL) AS i FROM facts))"""


def unhealthy(spark, sf):
    v = F.col("value")
    spoiled = F.when((F.col("tag") == "view") & (F.col("seq") % 3 > 0), F.lit(None)).when(F.col("tag") == "signup", F.floor(v / 400).cast("double")).otherwise(v)
    late = (F.col("tag") == "error") & (F.col("unit") == "U-1") & (F.col("time") > F.lit("2024-01-28").cast("timestamp"))
    return readings(spark, sf).where(~late).withColumn("value", spoiled)


def tag_states(spark, sf):
    df = unhealthy(spark, sf)
    rates = df.groupBy(*SERIES).agg((F.count_if(F.col("value") > 110) / F.count("*")).alias("rate"))
    return health.tag_health(df, rates)


@query("H19_tag_health", "plant unit tag n:l missing_percent:d age_hours:d mean:d min:d max:d is_flatline:b has_spikes:b high_variance:b anomaly_percent:d issues status", "SELECT * FROM states", HEALTH)
def tag_health(spark, sf):
    return tag_states(spark, sf).withColumn("issues", F.array_join("issues", ","))


@query("H20_unit_health_summary", "plant unit total_tags:l healthy_tags:l warning_tags:l critical_tags:l health_percent:d", """
    SELECT plant, unit, count(*) AS total_tags, count(*) FILTER (status = 'HEALTHY') AS healthy_tags, count(*) FILTER (status = 'WARNING') AS warning_tags, count(*) FILTER (status = 'CRITICAL') AS critical_tags,
           count(*) FILTER (status = 'HEALTHY') * 100.0 / count(*) AS health_percent FROM states GROUP BY plant, unit""", HEALTH)
def unit_health_summary(spark, sf):
    return health.unit_health_summary(tag_states(spark, sf))


@query("H21_investigate_tags", "plant unit tag n:l cv:d negatives:l verdict", """
    SELECT plant, unit, tag, n, sd / nullif(abs(m), 0) AS cv, neg AS negatives, CASE WHEN lo = hi THEN 'STUCK_SENSOR' WHEN m <> 0 AND sd / abs(m) * 100 < 0.01 THEN 'NEARLY_STUCK'
           WHEN contains(tag, 'PIA') AND neg > n * 0.1 THEN 'NEGATIVE_PRESSURE' ELSE 'UNKNOWN_ISSUE' END AS verdict FROM
      (SELECT plant, unit, tag, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, count(*) FILTER (value < 0) AS neg FROM
        (SELECT plant, unit, tag, CASE WHEN tag LIKE '%TI-%' THEN 7 ELSE value - 20 END AS value FROM instruments) GROUP BY plant, unit, tag)""", INSTRUMENTS)
def investigate_tags(spark, sf):
    v = F.when(F.col("tag").contains("TI-"), 7.0).otherwise(F.col("value") - 20)
    return health.investigate_tags(instruments(spark, sf).withColumn("value", v))


@query("H22_data_reality", "plant unit tag n:l cv_percent:d stability outliers:l outlier_percent:d verdict", """
    SELECT plant, unit, tag, n, cv AS cv_percent, CASE WHEN cv < 5 THEN 'VERY_STABLE' WHEN cv < 10 THEN 'STABLE' ELSE 'VARIABLE' END AS stability, o AS outliers, o * 100.0 / n AS outlier_percent,
           CASE WHEN o * 100.0 / n < 5 AND cv < 10 THEN 'FALSE_POSITIVE' ELSE 'MAY_BE_GENUINE' END AS verdict FROM
      (SELECT plant, unit, tag, n, CASE WHEN m > 0 THEN sd / m * 100 ELSE 0 END AS cv, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS o FROM readings JOIN
        (SELECT plant, unit, tag, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM readings GROUP BY plant, unit, tag)
       USING (plant, unit, tag) GROUP BY plant, unit, tag, n, m, sd)""", READINGS)
def data_reality(spark, sf):
    return health.data_reality(readings(spark, sf))


@query("H23_missing_tags", "plant unit missing:l found:l", """
    SELECT plant, unit, count(*) FILTER (last_time IS NULL) AS missing, count(last_time) AS found FROM decided GROUP BY plant, unit""", WANTED)
def missing_tags(spark, sf):
    c = health.coverage(wanted_tags(spark, sf), shipments(spark, sf))
    return c.groupBy("plant", "unit").agg(F.count_if(~F.col("found")).alias("missing"), F.count_if("found").alias("found"))


@query("H24_instrumentation", "plant unit records:l last_time:t age_hours:d level severity is_anomaly:b active_tags:l recent_records:l", """
    SELECT u.plant, u.unit, records, e AS last_time, a AS age_hours, CASE WHEN a <= 1 THEN 'FRESH' WHEN a <= 6 THEN 'MILDLY_STALE' WHEN a <= 24 THEN 'STALE' WHEN a <= 168 THEN 'VERY_STALE' ELSE 'EXTREMELY_STALE' END AS level,
           CASE WHEN a <= 1 THEN 'none' WHEN a <= 6 THEN 'low' WHEN a <= 24 THEN 'medium' WHEN a <= 168 THEN 'high' ELSE 'critical' END AS severity, a > 6 AS is_anomaly,
           count(DISTINCT s.tag) AS active_tags, count(*) AS recent_records FROM
      (SELECT plant, unit, count(*) AS records, max(time) AS e, date_diff('microsecond', max(time), (SELECT max(time) FROM shipments)) / 3.6e9 AS a FROM shipments GROUP BY plant, unit) u
    JOIN shipments s ON s.plant = u.plant AND s.unit = u.unit AND s.time >= e - INTERVAL 48 HOUR GROUP BY ALL""", SHIPMENTS)
def instrumentation(spark, sf):
    return health.instrumentation(shipments(spark, sf), 48)


@query("I9_gap_sessions", "plant unit tag session_start:t last_time:t records:l", """
    SELECT plant, unit, tag, min(time) AS session_start, max(time) AS last_time, count(*) AS records FROM
      (SELECT *, sum(CASE WHEN p IS NULL OR time - p > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY plant, unit, tag ORDER BY time) AS s FROM
        (SELECT *, lag(time) OVER (PARTITION BY plant, unit, tag ORDER BY time) AS p FROM readings)) GROUP BY plant, unit, tag, s""", READINGS)
def gap_sessions(spark, sf):
    return health.sessions(readings(spark, sf))


@query("T25_minimal_change", "plant unit tag total_points:l quiet_points:l quiet_percent:d mean_change:d max_change:d", """
    SELECT plant, unit, tag, count(*) AS total_points, count(*) FILTER (c < 5) AS quiet_points, count(*) FILTER (c < 5) * 100.0 / greatest(1, count(*) - 1) AS quiet_percent, avg(c) AS mean_change, max(c) AS max_change FROM
      (SELECT *, abs((value - p) / nullif(p, 0)) * 100 AS c FROM (SELECT *, lag(value) OVER (PARTITION BY plant, unit, tag ORDER BY time) AS p FROM readings)) GROUP BY plant, unit, tag""", READINGS)
def minimal_change(spark, sf):
    return detectors.minimal_change_stats(readings(spark, sf), 5)
