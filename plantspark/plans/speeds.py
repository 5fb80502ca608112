"""Running state, speed discovery and compensation (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.operators import speed
from plantspark.plans.inputs import INSTRUMENTS, READINGS, instruments, readings
from plantspark.plans.registry import query

CONFIG_ROWS = [
    ("P-0", "U-0", "click", None, None, 60.0, "rpm_normalized", 100.0, [0.0, 500.0]),
    ("P-1", "U-1", None, "click", "view", 75.0, "dual_rpm_averaged", 40.0, [60.0, 500.0]),
    ("P-0", "U-2", "click", None, None, 6000.0, "percentage_normalized", 100.0, [0.0, 500.0]),
    ("P-1", "U-3", None, None, None, 100.0, "dual_rpm_averaged", None, None),
    ("P-1", "U-9", "click", None, None, None, None, None, None),
]


def config(spark):
    return spark.createDataFrame(CONFIG_ROWS, speed.CONFIG)


CONFIG = """cfg(plant, unit, t1, t2, base, method, steady, lo, hi) AS (VALUES ('P-0', 'U-0', 'click', NULL, 60.0, 'rpm_normalized', 100.0, 0.0, 500.0),
    ('P-1', 'U-1', 'click', 'view', 75.0, 'dual_rpm_averaged', 40.0, 60.0, 500.0), ('P-0', 'U-2', 'click', NULL, 6000.0, 'percentage_normalized', 100.0, 0.0, 500.0),
    ('P-1', 'U-3', NULL, NULL, 100.0, 'dual_rpm_averaged', 100.0, NULL, NULL), ('P-1', 'U-9', 'click', NULL, NULL, 'rpm_normalized', 100.0, NULL, NULL))"""

FACTORS = f"""{READINGS}, {CONFIG}, sp AS (SELECT c.plant, c.unit, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd, avg(value) FILTER (tag = t1) AS m1, avg(value) FILTER (tag = t2) AS m2,
      stddev_samp(value) FILTER (tag = t1) AS s1, stddev_samp(value) FILTER (tag = t2) AS s2 FROM cfg c JOIN readings r ON c.plant = r.plant AND c.unit = r.unit AND r.tag IN (t1, t2) GROUP BY c.plant, c.unit),
    f1 AS (SELECT c.*, coalesce(n, 0) AS n, m AS speed, sd, CASE WHEN n IS NULL THEN 1.0 WHEN method = 'dual_rpm_averaged' THEN base / ((m1 + m2) / 2) ELSE base / m END AS raw_factor,
      CASE WHEN n IS NULL THEN 0.0 WHEN method = 'dual_rpm_averaged' THEN (CASE WHEN s1 > steady THEN steady / s1 ELSE 1 END * CASE WHEN m1 BETWEEN lo AND hi THEN 1 ELSE 0.7 END
         + CASE WHEN s2 > steady THEN steady / s2 ELSE 1 END * CASE WHEN m2 BETWEEN lo AND hi THEN 1 ELSE 0.7 END) / 2 * greatest(0.5, 1 - abs(m1 - m2) / greatest(m1, m2))
      ELSE CASE WHEN sd > steady THEN steady / sd ELSE 1.0 END END AS trust FROM cfg c LEFT JOIN sp USING (plant, unit)),
    factors AS (SELECT plant, unit, t1, t2, base, method AS wanted, n AS speed_points, speed, sd AS speed_std, raw_factor, CASE WHEN raw_factor NOT BETWEEN 0.1 AND 10 THEN trust / 2 ELSE trust END AS confidence,
      n > 0 AND raw_factor BETWEEN 0.1 AND 10 AND trust >= 0.3 AS applied FROM f1),
    compensated AS (SELECT r.plant, r.unit, r.tag, r.time, r.seq, coalesce(applied AND r.tag IS DISTINCT FROM t1 AND r.tag IS DISTINCT FROM t2, false) AS scaled,
      CASE WHEN coalesce(applied AND r.tag IS DISTINCT FROM t1 AND r.tag IS DISTINCT FROM t2, false) THEN value * raw_factor ELSE value END AS value, raw_factor FROM readings r LEFT JOIN factors f USING (plant, unit))"""


def factors(spark, sf):
    return speed.compensation_factors(readings(spark, sf), config(spark), min_confidence=0.3)


@query("P1_running_rows", "plant unit tag time:t value:d", """
    SELECT plant, unit, tag, time, value FROM ticks i WHERE EXISTS (SELECT 1 FROM ticks s WHERE s.plant = i.plant AND s.unit = i.unit AND s.time = i.time AND s.value > 10
      AND (s.tag LIKE '%SI%' OR s.tag LIKE '%FI%' OR s.tag LIKE '%FLOW%' OR s.tag LIKE '%RPM%' OR s.tag LIKE '%SPEED%'))
    OR unit = 'U-3'""",
    f"{INSTRUMENTS}, ticks AS (SELECT plant, unit, CASE WHEN unit = 'U-3' THEN 'T' || (seq % 5) ELSE tag END AS tag, date_trunc('hour', time) AS time, value FROM instruments)")
def running_rows(spark, sf):
    plain = F.when(F.col("unit") == "U-3", F.concat(F.lit("T"), (F.col("seq") % 5).cast("string"))).otherwise(F.col("tag"))
    hourly = instruments(spark, sf).select("plant", "unit", plain.alias("tag"), F.date_trunc("hour", "time").alias("time"), "value")
    return speed.running_rows(hourly, 10)


RECENT = f"""{INSTRUMENTS}, slow AS (SELECT plant, unit, tag, time, seq, CASE unit WHEN 'U-1' THEN value / 20 WHEN 'U-2' THEN value * 20 WHEN 'U-3' THEN value + 30 ELSE value END AS value FROM instruments
      WHERE (tag LIKE '%SI%' OR tag LIKE '%SE%') AND time >= (SELECT max(time) FROM instruments) - INTERVAL 48 HOUR),
    nums AS (SELECT plant, unit, tag, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (value <= 10) * 100.0 / count(*) AS z FROM slow GROUP BY plant, unit, tag),
    tails AS (SELECT plant, unit, tag, avg(value) FILTER (rn <= 5) AS r5, avg(value) FILTER (rn <= 10) AS r10 FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit, tag ORDER BY time DESC, seq DESC) AS rn FROM slow) GROUP BY ALL),
    simple AS (SELECT plant, unit, tag, n, mean, z AS zero_percent, r5 AS recent_speed, CASE WHEN z > 80 THEN 'SHUTDOWN' WHEN r5 <= 10 THEN 'SHUTDOWN_RECENT' WHEN mean < 50 THEN 'LOW_SPEED' ELSE 'RUNNING' END AS status FROM nums JOIN tails USING (plant, unit, tag)),
    rich AS (SELECT plant, unit, tag, n, mean, z AS zero_percent, r10 AS recent_speed, CASE WHEN z > 90 THEN 'SHUTDOWN' WHEN z > 50 THEN 'INTERMITTENT' WHEN mean < 100 THEN 'LOW_SPEED' WHEN sd > mean * 0.5 THEN 'UNSTABLE'
      WHEN r10 < mean * 0.5 THEN 'SHUTDOWN_RECENT' WHEN r10 > mean * 1.2 AND mean < 1000 THEN 'STARTUP' ELSE 'RUNNING' END AS status FROM nums JOIN tails USING (plant, unit, tag))"""
SENSOR = "plant unit tag n:l mean:d zero_percent:d recent_speed:d status"


def slow_speed(spark, sf):
    u, v = F.col("unit"), F.col("value")
    return instruments(spark, sf).withColumn("value", F.when(u == "U-1", v / 20).when(u == "U-2", v * 20).when(u == "U-3", v + 30).otherwise(v))


@query("P2_sensor_status", SENSOR, "SELECT * FROM simple", RECENT)
def sensor_status(spark, sf):
    return speed.sensor_status(slow_speed(spark, sf), 48)


@query("P3_unit_status", "plant unit status sensors:l mean_speed:d proceed:b", """
    SELECT plant, unit, status, 1 AS sensors, mean AS mean_speed, status <> 'SHUTDOWN' AS proceed FROM (SELECT * REPLACE (CASE WHEN status = 'SHUTDOWN_RECENT' THEN 'SHUTDOWN' ELSE status END AS status) FROM simple)""", RECENT)
def unit_status(spark, sf):
    return speed.unit_status(slow_speed(spark, sf), 48)


@query("P4_sensor_status_detailed", SENSOR, "SELECT * FROM rich", RECENT)
def sensor_status_detailed(spark, sf):
    return speed.sensor_status_detailed(slow_speed(spark, sf), 48)


@query("P5_fleet_status", "plant unit status sensors:l mean_speed:d proceed:b", """
    SELECT plant, unit, status, 1 AS sensors, mean AS mean_speed, status IN ('RUNNING', 'STARTUP') AS proceed FROM (SELECT * REPLACE (CASE WHEN status = 'SHUTDOWN_RECENT' THEN 'SHUTDOWN' ELSE status END AS status) FROM rich)""", RECENT)
def fleet_status(spark, sf):
    return speed.unit_status(slow_speed(spark, sf), 48, detailed=True)


NAMED = f"""{READINGS}, named AS (SELECT plant, unit, CASE tag WHEN 'click' THEN 'main_speed' WHEN 'view' THEN 'feed_flow' WHEN 'error' THEN 'drive_hz' WHEN 'purchase' THEN 'FIC-12' ELSE 'PERFORMANCE' END AS tag, time, seq,
      CASE WHEN tag = 'click' AND unit = 'U-2' THEN value - 100 ELSE value END AS value FROM readings),
    st AS (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM named GROUP BY plant, unit, tag),
    pure AS (SELECT *, CASE WHEN n < 10 THEN 'insufficient_data' WHEN std / mean < 0.05 THEN 'low_variability' WHEN std / mean > 2 THEN 'high_variability' WHEN min < 0 THEN 'invalid_range' WHEN max = 0 THEN 'zero_speed' ELSE 'excellent' END AS suitability
      FROM st WHERE tag IN ('main_speed', 'drive_hz'))"""


def named(spark, sf):
    out = F.lit("PERFORMANCE")
    for tag, name in {"click": "main_speed", "view": "feed_flow", "error": "drive_hz", "purchase": "FIC-12"}.items():
        out = F.when(F.col("tag") == tag, name).otherwise(out)
    value = F.when((F.col("tag") == "click") & (F.col("unit") == "U-2"), F.col("value") - 100).otherwise(F.col("value"))
    return readings(spark, sf).select("plant", "unit", out.alias("tag"), "time", value.alias("value"), "seq")


@query("P6_speed_tags", "plant unit tag n:l mean:d std:d min:d max:d", "SELECT * FROM st WHERE tag IN ('main_speed', 'feed_flow', 'drive_hz')", NAMED)
def speed_tags(spark, sf):
    return speed.speed_tags(named(spark, sf))


@query("P7_pure_speed_tags", "plant unit tag n:l mean:d suitability speed_type units_likely", """
    SELECT plant, unit, tag, n, mean, suitability, CASE tag WHEN 'drive_hz' THEN 'drive_frequency' ELSE 'unknown' END AS speed_type, CASE tag WHEN 'drive_hz' THEN 'Hz' ELSE 'unknown' END AS units_likely FROM pure""", NAMED)
def pure_speed_tags(spark, sf):
    return speed.pure_speed_tags(named(spark, sf))


@query("P7_proposed_config", "plant unit speed_tags:l primary_speed_tag compensation_type confidence baseline_speed:d compensation_factor:d", """
    SELECT plant, unit, n2 AS speed_tags, tag AS primary_speed_tag, CASE WHEN g THEN 'advanced' ELSE 'basic' END AS compensation_type, CASE WHEN g THEN 'high' ELSE 'medium' END AS confidence,
           CASE WHEN g THEN mean ELSE 0 END AS baseline_speed, CASE WHEN g THEN 1 / mean ELSE 1 END AS compensation_factor FROM
      (SELECT *, suitability = 'excellent' AS g, count(*) OVER (PARTITION BY plant, unit) AS n2, row_number() OVER (PARTITION BY plant, unit ORDER BY suitability <> 'excellent', tag) AS rn FROM pure) WHERE rn = 1""", NAMED)
def proposed_config(spark, sf):
    return speed.proposed_config(named(spark, sf))


@query("P8_tag_categories", "plant unit category tags n_tags:l", """
    SELECT plant, unit, category, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n_tags FROM (SELECT DISTINCT plant, unit, tag,
      CASE tag WHEN 'main_speed' THEN 'motor_drive' WHEN 'drive_hz' THEN 'motor_drive' WHEN 'FIC-12' THEN 'flow_control' WHEN 'PERFORMANCE' THEN 'performance' ELSE 'unknown' END AS category FROM named) GROUP BY plant, unit, category""", NAMED)
def tag_categories(spark, sf):
    return speed.tag_categories(named(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query("P8_monitoring_shortlist", "plant unit shortlist", "SELECT DISTINCT plant, unit, 'FIC-12,PERFORMANCE' AS shortlist FROM named", NAMED)
def monitoring_shortlist(spark, sf):
    return speed.monitoring_shortlist(named(spark, sf)).withColumn("shortlist", F.array_join("shortlist", ","))


BINS = f"""{READINGS}, bins AS (SELECT plant, unit, CAST(round_even(value / 10, 0) AS BIGINT) AS b, count(*) AS c FROM readings WHERE tag = 'click' GROUP BY plant, unit, b),
    mode AS (SELECT plant, unit, sum(c) AS points, arg_max(b, (c, -b)) * 10.0 AS centre FROM bins GROUP BY plant, unit)"""


@query("P9_speed_window", "plant unit points:l centre:d speed_low:d speed_high:d", """
    SELECT plant, unit, points, centre, centre - greatest(100, centre * 0.03) AS speed_low, centre + greatest(100, centre * 0.03) AS speed_high FROM mode WHERE points >= 50""", BINS)
def speed_window(spark, sf):
    return speed.speed_window(readings(spark, sf).where("tag = 'click'"))


@query("P10_compensation_factors", "plant unit speed_points:l speed:d speed_std:d raw_factor:d", "SELECT plant, unit, speed_points, speed, speed_std, raw_factor FROM factors", FACTORS)
def compensation_factors(spark, sf):
    return factors(spark, sf)


@query("P11_confidence", "plant unit confidence:d applied:b factor:d method", """
    SELECT plant, unit, confidence, applied, CASE WHEN applied THEN raw_factor ELSE 1 END AS factor, CASE WHEN applied THEN wanted ELSE 'none' END AS method FROM factors""", FACTORS)
def compensation_confidence(spark, sf):
    return factors(spark, sf)


@query("P12_dual_agreement", "plant unit confidence:d", "SELECT plant, unit, confidence FROM factors WHERE t2 IS NOT NULL", FACTORS)
def dual_agreement(spark, sf):
    return factors(spark, sf).where(F.size("speed_tags") == 2)


@query("P13_compensated_rows", "plant unit tag time:t value:d compensated:b compensation_factor:d", """
    SELECT plant, unit, tag, time, value, scaled AS compensated, CASE WHEN scaled THEN raw_factor END AS compensation_factor FROM compensated""", FACTORS)
def compensated_rows(spark, sf):
    return speed.compensate(readings(spark, sf), factors(spark, sf))


@query("P14_compensation_summary", "plant unit method factor:d confidence:d warnings_count:l speed_points:l target_tags:l", """
    SELECT plant, unit, CASE WHEN applied THEN wanted ELSE 'none' END AS method, CASE WHEN applied THEN raw_factor ELSE 1 END AS factor, confidence,
           CASE unit WHEN 'U-0' THEN 0 WHEN 'U-1' THEN 0 WHEN 'U-2' THEN CASE WHEN confidence < 0.3 THEN 3 ELSE 2 END ELSE 1 END AS warnings_count, speed_points,
           coalesce(k, 0) AS target_tags FROM factors LEFT JOIN (SELECT r.plant, r.unit, count(DISTINCT r.tag) AS k FROM readings r JOIN cfg c USING (plant, unit)
             WHERE r.tag IS DISTINCT FROM t1 AND r.tag IS DISTINCT FROM t2 GROUP BY r.plant, r.unit) USING (plant, unit)""", FACTORS)
def compensation_summary(spark, sf):
    return speed.compensation_summary(readings(spark, sf), factors(spark, sf))


@query("P15_segment_compensation", "plant unit tag time:t value:d factor:d", """
    SELECT plant, unit, tag, time, CASE WHEN abs(f - 1) >= 0.01 AND tag IS DISTINCT FROM t1 AND tag IS DISTINCT FROM t2 THEN value * f ELSE value END AS value, f AS factor FROM
      (SELECT r.*, t1, t2, CASE WHEN s > 0 AND base IS NOT NULL THEN greatest(0.1, least(10, base / s)) ELSE 1 END AS f FROM readings r LEFT JOIN cfg c USING (plant, unit)
       LEFT JOIN (SELECT c.plant, c.unit, avg(value) AS s FROM cfg c JOIN readings r ON c.plant = r.plant AND c.unit = r.unit AND c.t1 = r.tag GROUP BY c.plant, c.unit) USING (plant, unit))""", FACTORS)
def segment_compensation(spark, sf):
    return speed.segment_compensate(readings(spark, sf), config(spark))


@query("P16_config_validation", "total_plants:l total_units:l total_speed_tags:l warnings:l", """
    SELECT count(DISTINCT plant) AS total_plants, count(*) AS total_units, count(*) AS total_speed_tags, sum(CASE WHEN suitability = 'excellent' THEN 0 ELSE 3 END) AS warnings
    FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY suitability <> 'excellent', tag) AS rn FROM pure WHERE tag = 'main_speed') WHERE rn = 1""", NAMED)
def config_validation(spark, sf):
    """Configuration proposed from the readings themselves; a unit with a bad speed tag lacks fields."""
    rows = named(spark, sf).where("tag <> 'drive_hz'")
    return speed.config_summary(speed.config_of(speed.proposed_config(rows)))


@query("P17_speed_monitor", "plant unit speed_tags:l method latest_speed:d latest_time:t", """
    SELECT c.plant, c.unit, CASE WHEN t1 IS NULL THEN 0 WHEN t2 IS NULL THEN 1 ELSE 2 END AS speed_tags, method, arg_max(value, (time, tag)) AS latest_speed, max(time) AS latest_time
    FROM cfg c LEFT JOIN readings r ON c.plant = r.plant AND c.unit = r.unit AND r.tag IN (t1, t2) GROUP BY ALL""", FACTORS)
def speed_monitor(spark, sf):
    return speed.speed_monitor(readings(spark, sf), config(spark))
