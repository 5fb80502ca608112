"""Filters, windows, fills, order and joins (F, W, O, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.operators import filters, health, joins, sequence, windows
from plantspark.plans.inputs import INSTRUMENTS, READINGS, SHIPMENTS, instruments, readings, shipments, table
from plantspark.plans.registry import query
from plantspark.schema import SERIES, UNIT

ROW = "plant unit tag time:t value:d"
COLS = "plant, unit, tag, time, value"
NOW = "(SELECT max(time) FROM readings)"
PART = "PARTITION BY plant, unit, tag ORDER BY time"


# -- filters ---------------------------------------------------------------------------

@query("F1_equality", ROW, f"SELECT {COLS} FROM readings WHERE plant = 'P-1' AND unit = 'U-3' AND tag = 'click'", READINGS)
def equality(spark, sf):
    return filters.select_readings(readings(spark, sf), plant="P-1", unit="U-3", tag="click")


@query("F2_time_range", ROW, f"""
    SELECT {COLS} FROM readings WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ORDER BY time""", READINGS)
def time_range(spark, sf):
    return filters.select_readings(readings(spark, sf), start="2024-01-05", end="2024-01-12").orderBy("time")


@query("F3_trailing_hours", ROW, f"SELECT {COLS} FROM readings WHERE time >= TIMESTAMP '2024-01-20' - INTERVAL 36 HOUR", READINGS)
def trailing_hours(spark, sf):
    return filters.trailing(readings(spark, sf), hours_back=36, as_of="2024-01-20")


@query("F4_window_from_own_end", ROW, f"SELECT {COLS} FROM readings WHERE time >= {NOW} - INTERVAL 7 DAY", READINGS)
def own_end(spark, sf):
    return filters.trailing(readings(spark, sf), days_back=7)


@query("F5_plausible_dates", ROW, f"SELECT {COLS} FROM shipments WHERE year(time) >= 1999", SHIPMENTS)
def plausible(spark, sf):
    return filters.plausible_dates(shipments(spark, sf), 1999)


EPOCH = f"{SHIPMENTS}, dated AS (SELECT plant, unit, CASE WHEN tag = 'RF' THEN TIMESTAMP '1970-01-01' ELSE time END AS time FROM shipments)"


@query("F6_epoch_dates", "plant unit has_epoch_dates:b",
    "SELECT plant, unit, year(min(time)) = 1970 AS has_epoch_dates FROM dated GROUP BY plant, unit", EPOCH)
def epoch(spark, sf):
    spoiled = F.when(F.col("tag") == "RF", F.lit(0).cast("timestamp")).otherwise(F.col("time"))
    return filters.epoch_dates(shipments(spark, sf).withColumn("time", spoiled))


@query("F7_retention", ROW, f"SELECT {COLS} FROM shipments WHERE time >= (SELECT max(time) FROM shipments) - INTERVAL 900 DAY", SHIPMENTS)
def retention(spark, sf):
    return filters.retained(shipments(spark, sf), 900)


@query("F8_known_units", "unit records:l", """
    SELECT unit, count(*) AS records FROM (SELECT CASE WHEN seq % 2 = 0 THEN unit ELSE unit || '-0123456789abcdef-0123' END AS unit FROM readings)
    WHERE unit IN ('U-0', 'U-1', 'U-2-0123456789abcdef-0123') AND NOT (length(unit) > 20 AND contains(unit, '-')) GROUP BY unit""", READINGS)
def known_units(spark, sf):
    odd = F.when(F.col("seq") % 2 == 0, F.col("unit")).otherwise(F.concat("unit", F.lit("-0123456789abcdef-0123")))
    kept = filters.known_units(readings(spark, sf).withColumn("unit", odd), ["U-0", "U-1", "U-2-0123456789abcdef-0123"])
    return kept.groupBy("unit").agg(F.count("*").alias("records"))


@query("F9_rename_unit", "unit records:l", """
    SELECT CASE unit WHEN 'U/1' THEN 'U-9' WHEN 'U-1' THEN 'U-9' WHEN 'U_1' THEN 'U-9' ELSE unit END AS unit, count(*) AS records FROM
      (SELECT CASE seq % 3 WHEN 0 THEN unit WHEN 1 THEN replace(unit, '-', '_') ELSE replace(unit, '-', '/') END AS unit FROM readings)
    GROUP BY ALL""", READINGS)
def rename(spark, sf):
    spelled = F.when(F.col("seq") % 3 == 0, F.col("unit")).when(F.col("seq") % 3 == 1, F.translate("unit", "-", "_")).otherwise(F.translate("unit", "-", "/"))
    return filters.rename_unit(readings(spark, sf).withColumn("unit", spelled), "U/1", "U-9").groupBy("unit").agg(F.count("*").alias("records"))


@query("F10_speed_sensor_tags", ROW, f"""
    SELECT {COLS} FROM instruments WHERE (tag LIKE '%SI%' OR tag LIKE '%SPEED%' OR tag LIKE '%RPM%' OR tag LIKE '%SE%')
      AND NOT (tag LIKE '%TEMP%' OR tag LIKE '%PRESS%' OR tag LIKE '%FLOW%' OR tag LIKE '%LEVEL%' OR tag LIKE '%VIB%')""", INSTRUMENTS)
def speed_tags(spark, sf):
    return filters.speed_sensors(instruments(spark, sf))


@query("F11_tag_pattern", ROW, f"SELECT {COLS} FROM instruments WHERE regexp_matches(tag, 'SI-|KI-|SPEED|RPM')", INSTRUMENTS)
def tag_pattern(spark, sf):
    return filters.tag_matches(instruments(spark, sf))


@query("F12_named_for_unit", ROW, f"SELECT {COLS} FROM instruments WHERE contains(lower(tag), 'p-1_u-3_') OR contains(lower(tag), 'p-1.u-3.')", INSTRUMENTS)
def named_for_unit(spark, sf):
    return filters.named_for_unit(instruments(spark, sf), "P-1", "U-3")


SUPPLIERS = "units AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'K-' ELSE 'C-' END || s_suppkey AS unit FROM supplier)"


def supplier_units(spark, sf):
    prefix = F.when(F.col("s_suppkey") % 3 == 0, "K-").otherwise("C-")
    return table(spark, sf, "supplier").select(F.concat(prefix, F.col("s_suppkey").cast("string")).alias("unit")).distinct()


@query("F13_scope", "unit", """
    SELECT unit FROM (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS n FROM units WHERE unit LIKE 'K-%' AND unit NOT IN ('K-3', 'K-9'))
    WHERE n % 4 = 1""", SUPPLIERS)
def scope(spark, sf):
    units = filters.scope_units(supplier_units(spark, sf), "PLANT=PCFS", exclude=("k-3", "K-9"))
    return filters.shard_units(units, 1, 4)


@query("F14_priority_units", "unit unit_rank:l", """
    SELECT unit, CASE unit WHEN 'K-9' THEN 0 WHEN 'C-1' THEN 1 ELSE 2 END AS unit_rank FROM units ORDER BY unit_rank, unit LIMIT 8""", SUPPLIERS)
def priority_units(spark, sf):
    return filters.prioritised_units(supplier_units(spark, sf), 8, first=("K-9", "C-1"))


@query("F15_numeric_rows", ROW, f"SELECT {COLS} FROM readings WHERE tag <> 'error'", READINGS)
def numeric_rows(spark, sf):
    text = F.when(F.col("tag") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return filters.numeric_rows(readings(spark, sf).withColumn("value", text))


# -- windows ---------------------------------------------------------------------------

@query("W1_rolling_mean", ROW + " roll_mean:d", f"""
    SELECT {COLS}, CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END AS roll_mean FROM readings
    WINDOW w AS ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", READINGS)
def rolling_mean(spark, sf):
    return windows.rolling_mean(readings(spark, sf))


@query("W2_rolling_days", ROW + " roll_n:l roll_mean:d roll_std:d", f"""
    SELECT {COLS}, count(value) OVER w AS roll_n, CASE WHEN count(value) OVER w >= 20 THEN avg(value) OVER w END AS roll_mean,
           CASE WHEN count(value) OVER w >= 20 THEN stddev_samp(value) OVER w END AS roll_std FROM readings
    WINDOW w AS ({PART} RANGE BETWEEN INTERVAL '6 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)""", READINGS)
def rolling_days(spark, sf):
    return windows.rolling_days(readings(spark, sf), 7, 20)


@query("W3_quantile_bands", ROW + " band_low:d band_high:d", f"""
    SELECT {COLS}, CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.1) OVER w END AS band_low,
           CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.9) OVER w END AS band_high FROM readings
    WINDOW w AS ({PART} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", READINGS)
def quantile_bands(spark, sf):
    return windows.quantile_bands(readings(spark, sf))


@query("W4_rolling_hits", ROW + " hits:l", f"""
    SELECT {COLS}, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER ({PART} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM readings""", READINGS)
def rolling_hits(spark, sf):
    return windows.rolling_hits(readings(spark, sf), F.col("value") > 80)


@query("W5_lags", ROW + " lag1:d lag2:d lag3:d diff:d", f"""
    SELECT {COLS}, lag(value, 1) OVER w AS lag1, lag(value, 2) OVER w AS lag2, lag(value, 3) OVER w AS lag3,
           value - lag(value, 1) OVER w AS diff FROM readings WINDOW w AS ({PART})""", READINGS)
def lags(spark, sf):
    return windows.lags(readings(spark, sf))


@query("W6_rolling_stats", ROW + " mean5:d std5:d", f"""
    SELECT {COLS}, avg(value) OVER w AS mean5, stddev_samp(value) OVER w AS std5 FROM readings
    WINDOW w AS ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", READINGS)
def rolling_stats(spark, sf):
    return windows.rolling_stats(readings(spark, sf))


@query("W7_previous", ROW + " prev_time:t prev_value:d", f"""
    SELECT {COLS}, lag(time) OVER w AS prev_time, lag(value) OVER w AS prev_value FROM readings WINDOW w AS ({PART})""", READINGS)
def previous(spark, sf):
    from plantspark.operators.aggregates import with_previous

    return with_previous(readings(spark, sf))


@query("W8_last_values", "plant unit tag last_mean:d last_distinct:l", """
    SELECT plant, unit, tag, avg(value) FILTER (rn <= 5) AS last_mean, count(DISTINCT value) FILTER (rn <= 50) AS last_distinct FROM
      (SELECT *, row_number() OVER (PARTITION BY plant, unit, tag ORDER BY time DESC, seq DESC) AS rn FROM shipments) GROUP BY plant, unit, tag""", SHIPMENTS)
def last_values(spark, sf):
    return windows.last_values(shipments(spark, sf))


RUNS = f"""{READINGS}, marked AS (SELECT *, value > 40 AS f FROM readings),
    numbered AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({PART}) AS run_id FROM marked),
    runs AS (SELECT plant, unit, tag, run_id, count(*) AS n FROM numbered WHERE f GROUP BY ALL)"""


@query("W9_longest_run", "plant unit tag longest_run:l", """
    SELECT plant, unit, tag, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT plant, unit, tag FROM readings) LEFT JOIN runs USING (plant, unit, tag)
    GROUP BY plant, unit, tag""", RUNS)
def longest_run(spark, sf):
    return windows.longest_run(readings(spark, sf), F.col("value") > 40)


@query("W10_same_value_runs", "plant unit tag longest_same:l", f"""
    SELECT plant, unit, tag, max(n) AS longest_same FROM (SELECT plant, unit, tag, id, count(*) AS n FROM
      (SELECT plant, unit, tag, sum(CASE WHEN p IS NULL OR abs(value - p) >= 0.001 THEN 1 ELSE 0 END) OVER ({PART}) AS id FROM
        (SELECT plant, unit, tag, time, v AS value, lag(v) OVER ({PART}) AS p FROM (SELECT *, floor(value / 25) AS v FROM readings))) GROUP BY ALL) GROUP BY ALL""", READINGS)
def same_value_runs(spark, sf):
    return windows.same_value_runs(readings(spark, sf).withColumn("value", F.floor(F.col("value") / 25).cast("double")))


@query("W11_minimal_change_runs", "plant unit tag period_start:t period_end:t steps:l period_hours:d mean_change:d", f"""
    SELECT plant, unit, tag, min(time) AS period_start, max(time) AS period_end, count(*) AS steps,
           date_diff('microsecond', min(time), max(time)) / 3.6e9 AS period_hours, avg(c) AS mean_change FROM
      (SELECT *, sum(CASE WHEN coalesce(c < 60, false) THEN 0 ELSE 1 END) OVER ({PART}) AS id FROM
        (SELECT *, abs((value - p) / nullif(p, 0)) * 100 AS c FROM (SELECT *, lag(value) OVER ({PART}) AS p FROM readings)))
    WHERE c < 60 GROUP BY plant, unit, tag, id HAVING count(*) >= 6""", READINGS)
def minimal_change_runs(spark, sf):
    return windows.minimal_change_runs(readings(spark, sf), 60)


@query("W12_clustered_run", "plant unit tag flagged:l adjacent:l",
    "SELECT plant, unit, tag, sum(n) AS flagged, max(n) - 1 AS adjacent FROM runs GROUP BY plant, unit, tag", RUNS)
def clustered_run(spark, sf):
    return windows.clustered_run(readings(spark, sf), F.col("value") > 40)


COOLDOWN = f"""{READINGS}, pos AS (SELECT plant, unit, tag, value, row_number() OVER ({PART}) AS p FROM readings),
    hits AS (SELECT plant, unit, tag, p FROM pos WHERE value > 60),
    hops AS (SELECT h.plant, h.unit, h.tag, h.p, min(n.p) AS nxt FROM hits h LEFT JOIN hits n
             ON h.plant = n.plant AND h.unit = n.unit AND h.tag = n.tag AND n.p >= h.p + 5 AND n.p < h.p + 500 GROUP BY ALL)"""


@query("W13_cooldown_events", "plant unit tag events:l", """
    WITH RECURSIVE chain AS (
      SELECT plant, unit, tag, min(p) AS p FROM hops GROUP BY plant, unit, tag
      UNION ALL SELECT c.plant, c.unit, c.tag, h.nxt FROM chain c JOIN hops h ON c.plant = h.plant AND c.unit = h.unit AND c.tag = h.tag AND c.p = h.p
      WHERE h.nxt IS NOT NULL)
    SELECT s.plant, s.unit, s.tag, count(c.p) AS events FROM (SELECT DISTINCT plant, unit, tag FROM readings) s
    LEFT JOIN chain c ON c.plant = s.plant AND c.unit = s.unit AND c.tag = s.tag GROUP BY s.plant, s.unit, s.tag""", COOLDOWN)
def cooldown_events(spark, sf):
    return windows.cooldown_counts(readings(spark, sf), F.col("value") > 60)


# -- order and fill --------------------------------------------------------------------

@query("O1_ordered", ROW, f"SELECT {COLS} FROM readings ORDER BY tag, time", READINGS)
def ordered(spark, sf):
    return readings(spark, sf).orderBy("tag", "time")


@query("O2_top_tags", "plant unit tag count:l rank:l", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY count DESC, tag) AS rank FROM
      (SELECT plant, unit, tag, count(*) AS count FROM readings WHERE value > 150 GROUP BY plant, unit, tag)) WHERE rank <= 3""", READINGS)
def top_tags(spark, sf):
    counts = readings(spark, sf).where("value > 150").groupBy(*SERIES).agg(F.count("*").alias("count"))
    return windows.top_per_unit(counts, "count", 3)


@query("O3_largest", "unit mean:d", "SELECT unit, avg(value) AS mean FROM shipments GROUP BY unit ORDER BY mean DESC, unit LIMIT 5", SHIPMENTS)
def largest(spark, sf):
    return shipments(spark, sf).groupBy("unit").agg(F.avg("value").alias("mean")).orderBy(F.col("mean").desc(), "unit").limit(5)


HOLES = f"{READINGS}, holes AS (SELECT plant, unit, tag, time, CASE WHEN seq % 3 <> 0 THEN value END AS value FROM readings)"


def holes(spark, sf):
    return readings(spark, sf).withColumn("value", F.when(F.col("seq") % 3 != 0, F.col("value"))).drop("seq")


@query("O4_fill", ROW, f"""
    SELECT plant, unit, tag, time, coalesce(last_value(value IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(value IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value FROM holes""", HOLES)
def fill(spark, sf):
    return windows.fill(holes(spark, sf), default=0.0)


@query("O5_interpolate", "plant unit tag time:t interpolated:d", f"""
    SELECT plant, unit, tag, time, coalesce(value, a.v + (b.v - a.v) * (epoch_us(time) - a.t) / nullif(b.t - a.t, 0), a.v, b.v) AS interpolated FROM
      (SELECT plant, unit, tag, time, value, last_value(p IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
              first_value(p IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM
        (SELECT *, CASE WHEN value IS NOT NULL THEN {{'t': epoch_us(time), 'v': value}} END AS p FROM holes))""", HOLES)
def interpolate(spark, sf):
    return windows.interpolate(holes(spark, sf))


@query("O6_most_variable", "plant unit tag n:l cv:d rank:l", """
    SELECT plant, unit, tag, n, cv, rank FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY cv DESC, tag) AS rank FROM
      (SELECT plant, unit, tag, count(value) AS n, coalesce(stddev_samp(value) / nullif(avg(value), 0), 0) AS cv FROM readings GROUP BY plant, unit, tag
       HAVING count(value) > 100)) WHERE rank <= 8""", READINGS)
def most_variable(spark, sf):
    return windows.most_variable(readings(spark, sf))


@query("O7_unknown_first", "unit records:l age_hours:d", f"""
    SELECT u.unit, records, date_diff('microsecond', t, {NOW}) / 3.6e9 AS age_hours FROM
      (SELECT DISTINCT 'U-' || (c_custkey % 6) AS unit FROM customer) u
    LEFT JOIN (SELECT unit, count(*) AS records, max(time) AS t FROM readings GROUP BY unit) r ON r.unit = u.unit ORDER BY age_hours DESC NULLS FIRST, u.unit""", READINGS)
def unknown_first(spark, sf):
    units = table(spark, sf, "customer").select(F.concat(F.lit("U-"), (F.col("c_custkey") % 6).cast("string")).alias("unit")).distinct()
    return health.freshness_report(units, readings(spark, sf))


# -- joins -----------------------------------------------------------------------------

ZS = f"""{READINGS}, zs AS (SELECT r.*, n, mean, std, (value - mean) / nullif(std, 0) AS z FROM readings r JOIN
    (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM readings GROUP BY plant, unit, tag) s USING (plant, unit, tag))"""


@query("J1_stats_join", ROW + " n:l mean:d std:d z:d", f"SELECT {COLS}, n, mean, std, z FROM zs", ZS)
def stats_join(spark, sf):
    return joins.z_scores(readings(spark, sf))


@query("J2_candidate_times", ROW, f"""
    SELECT {COLS} FROM instruments i WHERE EXISTS (SELECT 1 FROM instruments c WHERE c.value > 100 AND c.plant = i.plant AND c.unit = i.unit
      AND date_trunc('minute', c.time) = date_trunc('minute', i.time))""", INSTRUMENTS)
def candidate_times(spark, sf):
    r = instruments(spark, sf).withColumn("_real", F.col("time")).withColumn("time", F.date_trunc("minute", "time"))
    return joins.at_candidate_times(r, r.where("value > 100")).withColumn("time", F.col("_real"))


@query("J3_common_times", "plant unit tag time:t", """
    SELECT plant, unit, tag, time FROM readings WHERE value > 120 INTERSECT SELECT plant, unit, tag, time FROM readings WHERE seq % 2 = 0""", READINGS)
def common_times(spark, sf):
    r = readings(spark, sf)
    return joins.common_times(r.where("value > 120"), r.where("seq % 2 = 0"))


LIMITS = "limits AS (SELECT unit, tag, min(value) + 1 AS lower_limit, max(value) / 2 AS upper_limit FROM readings WHERE tag IN ('click', 'view') GROUP BY unit, tag)"


def some_limits(spark, sf):
    return readings(spark, sf).where("tag IN ('click', 'view')").groupBy("unit", "tag").agg(
        (F.min("value") + 1).alias("lower_limit"), (F.max("value") / 2).alias("upper_limit")
    )


@query("J4_limits_or_sigma", ROW + " lower:d upper:d configured:b", f"""
    SELECT r.plant, r.unit, r.tag, time, value, coalesce(lower_limit, mean - 2.5 * std) AS lower, coalesce(upper_limit, mean + 2.5 * std) AS upper,
           upper_limit IS NOT NULL AS configured FROM zs r LEFT JOIN limits l ON l.unit = r.unit AND l.tag = r.tag""", f"{ZS}, {LIMITS}")
def limits_or_sigma(spark, sf):
    return joins.limits_or_sigma(readings(spark, sf), some_limits(spark, sf))


SPEED = f"{READINGS}, speed AS (SELECT plant, unit, time, value FROM readings WHERE tag = 'click'), others AS (SELECT * FROM readings WHERE tag <> 'click')"


def speed_and_others(spark, sf):
    r = readings(spark, sf)
    return r.where("tag = 'click'").select(*UNIT, "time", "value"), r.where("tag <> 'click'")


@query("J5_nearest_speed", ROW + " speed_value:d", """
    SELECT plant, unit, tag, time, value, CASE WHEN nt IS NULL OR gb <= gn THEN CASE WHEN gb <= 600000000 THEN bv END
           WHEN gn <= 600000000 THEN nv END AS speed_value FROM
      (SELECT b.*, n.time AS nt, n.value AS nv, coalesce(epoch_us(n.time) - epoch_us(b.time), 1000000000000) AS gn FROM
        (SELECT o.*, s.value AS bv, coalesce(epoch_us(o.time) - epoch_us(s.time), 1000000000000) AS gb
         FROM others o ASOF LEFT JOIN speed s ON o.plant = s.plant AND o.unit = s.unit AND o.time >= s.time) b
       ASOF LEFT JOIN speed n ON b.plant = n.plant AND b.unit = n.unit AND b.time <= n.time)""", SPEED)
def nearest_speed(spark, sf):
    speed, others = speed_and_others(spark, sf)
    return joins.nearest_speed(others, speed)


@query("J6_speed_around", ROW + " speed_n:l speed_mean:d speed_std:d", """
    SELECT o.plant, o.unit, tag, o.time, o.value, count(s.value) AS speed_n, avg(s.value) AS speed_mean, stddev_samp(s.value) AS speed_std
    FROM others o LEFT JOIN speed s ON o.plant = s.plant AND o.unit = s.unit AND s.time BETWEEN o.time - INTERVAL 30 MINUTE AND o.time + INTERVAL 30 MINUTE
    WHERE o.value > 100 GROUP BY ALL""", SPEED)
def speed_around(spark, sf):
    speed, others = speed_and_others(spark, sf)
    return joins.speed_around(others.where("value > 100"), speed)


@query("J7_neighbours", ROW + " near_n:l near_mean:d near_std:d", """
    SELECT a.plant, a.unit, a.tag, a.time, a.value, count(r.value) AS near_n, avg(r.value) AS near_mean, stddev_samp(r.value) AS near_std
    FROM readings a JOIN readings r ON a.plant = r.plant AND a.unit = r.unit AND a.tag = r.tag
      AND r.time BETWEEN a.time - INTERVAL 1 HOUR AND a.time + INTERVAL 1 HOUR WHERE a.value > 100 GROUP BY ALL""", READINGS)
def neighbours(spark, sf):
    r = readings(spark, sf)
    return joins.neighbours(r, r.where("value > 100").drop("seq"))


@query("J8_rows_at", ROW + " asked:d", f"SELECT {COLS}, value AS asked FROM readings WHERE value > 150", READINGS)
def rows_at(spark, sf):
    r = readings(spark, sf)
    return joins.rows_at(r, r.where("value > 150").select(*SERIES, "time", F.col("value").alias("asked")))


@query("J12_compare_counts", "plant unit tag count_before:l count_after:l raised:b", """
    SELECT plant, unit, tag, coalesce(b, 0) AS count_before, coalesce(a, 0) AS count_after, coalesce(a, 0) > coalesce(b, 0) AS raised FROM
      (SELECT plant, unit, tag, count(*) AS b FROM shipments WHERE value > 90000 GROUP BY ALL)
      FULL JOIN (SELECT plant, unit, tag, count(*) AS a FROM shipments WHERE value < 20000 GROUP BY ALL) USING (plant, unit, tag)""", SHIPMENTS)
def compare_counts(spark, sf):
    s = shipments(spark, sf)
    before, after = (s.where(c).groupBy(*SERIES).agg(F.count("*").alias("count")) for c in ("value > 90000", "value < 20000"))
    return joins.compare_counts(before, after)


@query("J13_external_times", "plant unit time:t", """
    SELECT plant, unit, time FROM readings WHERE value > 200 UNION
    SELECT plant, unit, x.time FROM (SELECT DISTINCT o_orderdate + INTERVAL 8950 DAY - INTERVAL 7000 DAY AS time FROM orders) x
    JOIN (SELECT plant, unit, min(time) AS a, max(time) AS b FROM readings GROUP BY plant, unit) ON x.time BETWEEN a AND b""", READINGS)
def external_times(spark, sf):
    r = readings(spark, sf)
    external = table(spark, sf, "orders").select((F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '1950' DAY")).alias("time"))
    return joins.clip_and_union(r, r.where("value > 200"), external)


@query("J9_coverage", "plant unit tag slug found:b", """
    SELECT w.plant, w.unit, w.tag, w.slug, EXISTS (SELECT 1 FROM readings r WHERE r.plant = w.plant AND r.unit = w.unit AND r.tag = w.slug) AS found
    FROM (SELECT plant, unit, tag || ' x' AS tag, tag || '_x' AS slug FROM have UNION ALL SELECT plant, unit, tag, tag FROM have) w""",
    f"{READINGS}, have AS (SELECT DISTINCT plant, unit, tag FROM readings)")
def coverage(spark, sf):
    have = readings(spark, sf).select(*SERIES).distinct()
    wanted = have.withColumn("tag", F.concat("tag", F.lit(" x"))).unionAll(have)
    return health.coverage(wanted, readings(spark, sf))
