"""Baselines, multivariate models, backtests (M, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.operators import aggregates, backtest, baseline, multivariate
from plantspark.plans.detect import CHECKS, LIMITS, checked, limits
from plantspark.plans.detect import breakout_ctes
from plantspark.plans.forests import cut_ctes, forest_ctes
from plantspark.plans.inputs import INSTRUMENTS, READINGS, instruments, readings
from plantspark.plans.matrices import based_cte, distance_ctes, matrix_cte, rates_ctes, robust_ctes, runs_ctes, split_runs_ctes
from plantspark.plans.registry import query
from plantspark.plans.rows import ZS
from plantspark.plans.speeds import BINS
from plantspark.schema import SERIES, UNIT

PART = "PARTITION BY plant, unit, tag ORDER BY time"

BASE = f"""{INSTRUMENTS}, lifted AS (SELECT plant, unit, tag, time, CASE WHEN tag LIKE '%SI-%' THEN value + 2000 WHEN tag LIKE '%FI-%' THEN value + 700 WHEN tag LIKE '%PIA%' THEN value / 4 ELSE value END AS value FROM instruments),
    hist AS (SELECT * FROM lifted WHERE time >= (SELECT max(time) FROM lifted) - INTERVAL 20 DAY),
    b0 AS (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3,
      coalesce(stddev_samp(value) / nullif(avg(value), 0) * 100, 0) AS cv, CASE WHEN tag LIKE '%TI-%' THEN 'TEMPERATURE' WHEN tag LIKE '%PIA%' THEN 'PRESSURE' WHEN tag LIKE '%FI-%' THEN 'FLOW' WHEN tag LIKE '%SI-%' THEN 'SPEED' ELSE 'VIBRATION' END AS tag_type
      FROM hist GROUP BY plant, unit, tag HAVING count(value) >= 100),
    b1 AS (SELECT *, hi - lo AS r, q3 - q1 AS iqr, CASE WHEN cv < 2 THEN 'VERY_STABLE' WHEN cv < 5 THEN 'STABLE' WHEN cv < 10 THEN 'MODERATELY_STABLE' ELSE 'VARIABLE' END AS stability FROM b0),
    b2 AS (SELECT *, CASE stability WHEN 'VERY_STABLE' THEN 4.0 WHEN 'STABLE' THEN 3.5 WHEN 'MODERATELY_STABLE' THEN 3.0 ELSE 2.5 END AS sg, CASE WHEN stability IN ('VERY_STABLE', 'STABLE') THEN 2.0 ELSE 1.5 END AS fe,
      CASE tag_type WHEN 'TEMPERATURE' THEN greatest(-50, lo - r * 0.5) WHEN 'PRESSURE' THEN greatest(0, lo - r * 0.3) WHEN 'FLOW' THEN greatest(0, lo - r * 0.2) WHEN 'SPEED' THEN greatest(0, lo - r * 0.3) ELSE lo - r * 0.5 END AS el,
      CASE tag_type WHEN 'TEMPERATURE' THEN least(500, hi + r * 0.5) WHEN 'PRESSURE' THEN least(200, hi + r * 0.5) WHEN 'FLOW' THEN hi + r * 0.8 ELSE hi + r * 0.5 END AS eh FROM b1),
    b3 AS (SELECT *, mean + sg * std AS sh, mean - sg * std AS sl, q3 + fe * iqr AS ih, q1 - fe * iqr AS il FROM b2),
    b4 AS (SELECT plant, unit, tag, count(*) FILTER (value < greatest(sl, il, el) OR value > least(sh, ih, eh)) * 100.0 / max(n) AS outlier_percent FROM hist JOIN b3 USING (plant, unit, tag) GROUP BY plant, unit, tag),
    tuned AS (SELECT b3.*, outlier_percent, CASE WHEN outlier_percent > 5 THEN least(sh * 1.2, ih * 1.2, eh) ELSE least(sh, ih, eh) END AS upper_limit, CASE WHEN outlier_percent > 5 THEN greatest(sl / 1.2, il / 1.2, el) ELSE greatest(sl, il, el) END AS lower_limit,
      CASE WHEN stability IN ('VERY_STABLE', 'STABLE') AND outlier_percent < 2 THEN 'LOW_SENSITIVITY' WHEN stability = 'MODERATELY_STABLE' AND outlier_percent < 3 THEN 'MEDIUM_SENSITIVITY' ELSE 'HIGH_SENSITIVITY' END AS sensitivity FROM b3 JOIN b4 USING (plant, unit, tag))"""


def lifted(spark, sf):
    v, tag = F.col("value"), F.col("tag")
    return instruments(spark, sf).withColumn("value", F.when(tag.contains("SI-"), v + 2000).when(tag.contains("FI-"), v + 700).when(tag.contains("PIA"), v / 4).otherwise(v))


@query("M1_baseline_tuning", "plant unit tag tag_type stability n:l mean:d std:d median:d q1:d q3:d iqr:d cv:d upper_limit:d lower_limit:d outlier_percent:d sensitivity", "SELECT * FROM tuned", BASE)
def baseline_tuning(spark, sf):
    return baseline.tune(lifted(spark, sf), history_days=20)


@query("M2_temporal_quality", "plant unit tag longest_same:l stuck_rate:d noise_ratio:d data_quality", """
    SELECT plant, unit, tag, longest_same, stuck_rate, noise_ratio, CASE WHEN stuck_rate < 10 AND noise_ratio < 1 THEN 'GOOD' ELSE 'QUESTIONABLE' END AS data_quality FROM tmp""", CHECKS)
def temporal_quality(spark, sf):
    return baseline.temporal_quality(checked(spark, sf))


@query("M3_stability_distribution", "plant unit tags:l very_stable:l stable:l moderately_stable:l variable:l", """
    SELECT plant, unit, count(*) AS tags, count(*) FILTER (stability = 'VERY_STABLE') AS very_stable, count(*) FILTER (stability = 'STABLE') AS stable, count(*) FILTER (stability = 'MODERATELY_STABLE') AS moderately_stable,
           count(*) FILTER (stability = 'VARIABLE') AS variable FROM tuned GROUP BY plant, unit""", BASE)
def stability_distribution(spark, sf):
    return baseline.stability_distribution(baseline.tune(lifted(spark, sf), history_days=20))


GRID = """hm AS (SELECT plant, unit, tag, date_trunc('hour', time) AS b, avg(value) AS value FROM {src} GROUP BY ALL),
    hg AS (SELECT plant, unit, tag, b FROM (SELECT DISTINCT plant, unit, tag FROM hm) JOIN (SELECT plant, unit, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM hm GROUP BY plant, unit) USING (plant, unit)),
    hf AS (SELECT plant, unit, tag, b, last_value(value IGNORE NULLS) OVER (PARTITION BY plant, unit, tag ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM hg LEFT JOIN hm USING (plant, unit, tag, b))"""


@query("M4_feature_matrix", "plant unit time:t lead:d total:d width:l", """
    SELECT plant, unit, b AS time, max(value) FILTER (tag LIKE '%SI-%') AS lead, sum(value) AS total, count(value) AS width FROM hf GROUP BY plant, unit, b HAVING count(value) = 5""", f"{INSTRUMENTS}, {GRID.format(src='instruments')}")
def feature_matrix(spark, sf):
    m = aggregates.expanded(multivariate.feature_matrix(instruments(spark, sf)), 60)
    return m.select(*UNIT, "time", F.col("features")[0].alias("lead"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("features").alias("width"))


MATRIX = f"{INSTRUMENTS}, {GRID.format(src='instruments')}, {matrix_cte()}"
RATES = "plant unit rows:l test_rows:l anomalies:l anomaly_rate:d"
VALUES = [f"f{i}" for i in range(5)]


@query("M5_distance_anomalies", RATES, "SELECT * FROM rate", f"{MATRIX}, {based_cte(0.7)}, base AS (SELECT * FROM bx WHERE is_base), {distance_ctes('bx', 'base', '')}, {rates_ctes('md', 0.99, '')}")
def distance_anomalies(spark, sf):
    return multivariate.anomaly_rates(multivariate.distance_anomalies(multivariate.feature_matrix(instruments(spark, sf))))


@query("M6_robust_distance", RATES, "SELECT * FROM rate", f"{MATRIX}, {based_cte(0.7)}, {robust_ctes('bx', 0.75, 3)}, {rates_ctes('md_r', 0.99, '')}")
def robust_distance(spark, sf):
    return multivariate.anomaly_rates(multivariate.distance_anomalies(multivariate.feature_matrix(instruments(spark, sf)), robust=True))


UNIT_FOREST = {"keys": ("plant", "unit"), "trees": 50}
FOREST_RATE = "SELECT plant, unit, sum(n) AS rows, coalesce(sum(n) FILTER (NOT is_base), 0) AS test_rows, coalesce(sum(n) FILTER (NOT is_base AND is_outlier), 0) AS anomalies, coalesce(sum(n) FILTER (NOT is_base AND is_outlier), 0) * 1.0 / sum(n) FILTER (NOT is_base) AS anomaly_rate FROM {} GROUP BY plant, unit"


@query("M7_matrix_forest_split", RATES, FOREST_RATE.format("judged"), f"{MATRIX}, {runs_ctes()}, {split_runs_ctes(0.7)}, {forest_ctes('sr', VALUES, fit='is_base', among='is_base', share=0.05, **UNIT_FOREST)}")
def matrix_forest_split(spark, sf):
    m = multivariate.feature_matrix(instruments(spark, sf))
    return multivariate.anomaly_rates(multivariate.matrix_forest(m, split=0.7, contamination=0.05, trees=50))


@query("M8_matrix_forest", "plant unit time:t score:d is_anomaly:b", "SELECT plant, unit, time + INTERVAL 1 HOUR * i AS time, score, is_outlier AS is_anomaly FROM (SELECT *, unnest(range(0, n)) AS i FROM judged)",
    f"{MATRIX}, {runs_ctes()}, ur AS (SELECT *, b AS time FROM mr), {forest_ctes('ur', VALUES, **UNIT_FOREST)}")
def matrix_forest(spark, sf):
    return aggregates.expanded(multivariate.matrix_forest(multivariate.feature_matrix(instruments(spark, sf)), trees=50), 60)


@query("M9_projection", "plant unit time:t energy:d width:l explained:d", """
    SELECT plant, unit, time, sum(z * z) AS energy, count(*) AS width, 1.0 AS explained FROM
      (SELECT plant, unit, b AS time, tag, (value - avg(value) OVER c) / stddev_samp(value) OVER c AS z FROM whole WINDOW c AS (PARTITION BY plant, unit, tag)) GROUP BY plant, unit, time""",
    f"{INSTRUMENTS}, {GRID.format(src='instruments')}, whole AS (SELECT * FROM hf QUALIFY count(value) OVER (PARTITION BY plant, unit, b) = 5)")
def projection(spark, sf):
    """All components together keep every row's squared length."""
    m = aggregates.expanded(multivariate.projected(multivariate.feature_matrix(instruments(spark, sf))), 60)
    energy = F.aggregate("projected", F.lit(0.0), lambda a, x: a + x * x)
    return m.select(*UNIT, "time", energy.alias("energy"), F.size("projected").alias("width"), "explained")


@query("M10_trends", "plant unit tag n:l mean:d std:d min:d max:d slope:d volatility:d q25:d q75:d", """
    SELECT plant, unit, tag, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, regr_slope(v, p) AS slope, stddev_pop(v) AS volatility, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM
      (SELECT plant, unit, tag, row_number() OVER (PARTITION BY plant, unit, tag ORDER BY b) AS p, coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY plant, unit, tag ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM hf)
    GROUP BY plant, unit, tag""", f"{READINGS}, {GRID.format(src='readings')}")
def trends(spark, sf):
    return multivariate.trends(readings(spark, sf))


@query("M11_forecasts", "plant unit tag n:l test_rows:l mse:d lag1_weight:d lag2_weight:d lag3_weight:d mean5_weight:d std5_weight:d")
def forecasts(spark, sf):
    return multivariate.forecasts(readings(spark, sf), trees=20)


@query("M11_lag_features", "plant unit tag time:t value:d lag1:d lag2:d lag3:d mean5:d std5:d", f"""
    SELECT * FROM (SELECT plant, unit, tag, time, value, lag(value, 1) OVER s AS lag1, lag(value, 2) OVER s AS lag2, lag(value, 3) OVER s AS lag3, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS mean5, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS std5
      FROM readings WINDOW s AS ({PART}), w AS ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE lag3 IS NOT NULL AND mean5 IS NOT NULL""", READINGS)
def lag_features(spark, sf):
    return multivariate.lag_features(readings(spark, sf))


@query("M12_two_sigma_labels", "plant unit time:t tags:l abnormal:b", """
    SELECT plant, unit, b AS time, count(*) AS tags, bool_or(n > 10 AND abs(value - m) > 2 * s) AS abnormal FROM (SELECT plant, unit, tag, date_trunc('hour', time) AS b, avg(value) AS value FROM readings GROUP BY ALL)
    JOIN (SELECT plant, unit, tag, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM (SELECT plant, unit, tag, date_trunc('hour', time) AS b, avg(value) AS value FROM readings GROUP BY ALL) GROUP BY ALL) USING (plant, unit, tag) GROUP BY plant, unit, b""", READINGS)
def two_sigma_labels(spark, sf):
    return backtest.two_sigma_labels(readings(spark, sf), F.date_trunc("hour", "time"))


@query("M12_long_series", "plant unit tag time:t value:d rank:l", """
    SELECT r.plant, r.unit, r.tag, time, value, rank FROM readings r JOIN (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY c DESC, tag) AS rank FROM (SELECT plant, unit, tag, count(*) AS c FROM readings GROUP BY ALL HAVING count(*) > 100)) k
      ON r.plant = k.plant AND r.unit = k.unit AND r.tag = k.tag""", READINGS)
def long_series(spark, sf):
    return backtest.long_series(readings(spark, sf))


@query("M13_unit_summary", "plant unit rows:l values:l tags:l first_time:t last_time:t", """
    SELECT plant, unit, count(*) AS rows, count(value) AS values, count(DISTINCT tag) AS tags, min(time) AS first_time, max(time) AS last_time FROM readings GROUP BY plant, unit""", READINGS)
def unit_summary(spark, sf):
    return backtest.unit_summary(readings(spark, sf))


U = "(CAST('0x' || substr(md5('{seed}|' || plant || '|' || unit || '|' || tag || '|' || epoch_us(time)), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query("M13_sample_rows", "plant unit tag time:t value:d", f"""
    SELECT plant, unit, tag, time, value FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY {U.format(seed=42)}) AS rn FROM readings) WHERE rn <= 300""", READINGS)
def sample_rows(spark, sf):
    return backtest.sample_rows(readings(spark, sf), 300)


FEATURES = ["click", "error", "pur", "flow", "sig"]
MAPPING = {"click": "click", "flow": ["view", "signup"]}


@query("M14_named_features", "plant unit time:t click:d error:d flow:d pur:d sig:d", """
    SELECT plant, unit, b AS time, max(value) FILTER (tag = 'click') AS click, max(value) FILTER (tag = 'error') AS error, avg(value) FILTER (tag IN ('view', 'signup')) AS flow, max(value) FILTER (tag = 'purchase') AS pur, max(value) FILTER (tag = 'signup') AS sig
    FROM hf GROUP BY plant, unit, b HAVING max(value) FILTER (tag = 'click') IS NOT NULL AND max(value) FILTER (tag = 'error') IS NOT NULL AND max(value) FILTER (tag = 'purchase') IS NOT NULL AND max(value) FILTER (tag = 'signup') IS NOT NULL
      AND count(value) FILTER (tag IN ('view', 'signup')) > 0""", f"{READINGS}, {GRID.format(src='readings')}")
def named_features(spark, sf):
    m = aggregates.expanded(multivariate.named_features(readings(spark, sf), FEATURES, MAPPING), 60)
    return m.select(*UNIT, "time", *[F.col("features")[i].alias(n) for i, n in enumerate(sorted(FEATURES))])


@query("M15_reconstruction", "plant unit time:t error:d threshold:d is_anomaly:b")
def reconstruction(spark, sf):
    return aggregates.expanded(multivariate.reconstruction_anomalies(multivariate.named_features(readings(spark, sf), FEATURES, MAPPING).drop("names")), 60)


# -- backtests -------------------------------------------------------------------------

@query("B1_weekly_periods", "period period_start:t period_end:t records:l", """
    SELECT 'Week_' || (i + 1) || '_back' AS period, e - INTERVAL 1 DAY * (7 * (i + 1)) AS period_start, e - INTERVAL 1 DAY * (7 * i) AS period_end, (SELECT count(*) FROM readings WHERE time BETWEEN e - INTERVAL 1 DAY * (7 * (i + 1)) AND e - INTERVAL 1 DAY * (7 * i)) AS records
    FROM (SELECT max(time) AS e FROM readings), generate_series(0, 3) s(i)""", READINGS)
def weekly_periods(spark, sf):
    r = readings(spark, sf)
    counts = backtest.in_periods(r).groupBy("period").agg(F.count("*").alias("records"))
    return backtest.weekly_periods(r).join(counts, ["period"])


PERIODS = f"""{READINGS}, {LIMITS}, weeks AS (SELECT r.*, 'Week_' || (i + 1) || '_back' AS period FROM readings r, generate_series(0, 3) s(i), (SELECT max(time) AS e FROM readings) WHERE time BETWEEN e - INTERVAL 1 DAY * (7 * (i + 1)) AND e - INTERVAL 1 DAY * (7 * i)),
    ws AS (SELECT period, plant, unit, tag, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM weeks GROUP BY ALL),
    wt AS (SELECT period, plant, unit, tag, count(*) AS rows, count(*) FILTER (n >= 10 AND abs(value - m) > 3 * s) AS h3, count(*) FILTER (n >= 10 AND abs(value - m) > 4 * s) AS h4,
      count(*) FILTER (n >= 5 AND (value < coalesce(lower_limit, m - 4 * s) OR value > coalesce(upper_limit, m + 4 * s))) AS hb FROM weeks JOIN ws USING (period, plant, unit, tag) LEFT JOIN limits USING (plant, unit, tag) GROUP BY period, plant, unit, tag),
    long AS (SELECT period, plant, unit, rows, 'original_3sigma' AS method, h3 AS h FROM wt UNION ALL SELECT period, plant, unit, rows, 'conservative_4sigma', h4 FROM wt UNION ALL SELECT period, plant, unit, rows, 'baseline_tuned', hb FROM wt),
    methods AS (SELECT period, plant, unit, method, sum(rows) AS records, sum(h) AS total_anomalies, count(*) FILTER (h > 0) AS tags_with_anomalies, sum(h) * 1.0 / sum(rows) AS anomaly_rate FROM long GROUP BY period, plant, unit, method),
    perf AS (SELECT *, greatest(0, 1 - avg_rate / 10) * 0.4 + consistency * 0.4 + CASE WHEN method = 'baseline_tuned' THEN 0.2 ELSE 0 END AS score FROM (SELECT plant, unit, method, avg(anomaly_rate) * 100 AS avg_rate, stddev_pop(anomaly_rate) * 100 AS std_rate, min(anomaly_rate) * 100 AS min_rate,
      max(anomaly_rate) * 100 AS max_rate, avg(total_anomalies) AS avg_anomalies, 1 / (1 + stddev_pop(anomaly_rate)) AS consistency, count(*) AS periods FROM methods GROUP BY plant, unit, method))"""


def period_methods_table(spark, sf):
    return backtest.period_methods(readings(spark, sf), limits(spark, sf))


@query("B2_period_methods", "period plant unit method records:l total_anomalies:l tags_with_anomalies:l anomaly_rate:d", "SELECT * FROM methods", PERIODS)
def period_methods(spark, sf):
    return period_methods_table(spark, sf)


@query("B3_forest_on_means", "period plant unit total_anomalies:l tags:l anomaly_rate:d", """
    SELECT period, plant, unit, count(*) FILTER (is_outlier) AS total_anomalies, count(*) AS tags, count(*) FILTER (is_outlier) * 1.0 / count(*) AS anomaly_rate FROM judged GROUP BY period, plant, unit""",
    f"{PERIODS}, wm AS (SELECT period, plant, unit, tag, avg(value) AS value FROM weeks GROUP BY ALL), {forest_ctes('wm', ['value'], keys=('period', 'plant', 'unit'), identity=('tag',), min_rows=5)}")
def forest_on_means(spark, sf):
    return backtest.forest_on_means(readings(spark, sf))


@query("B4_period_summary", "period plant unit methods:l mean_rate:d consistency:d", """
    SELECT period, plant, unit, count(*) AS methods, avg(anomaly_rate) AS mean_rate, 1 / (1 + stddev_pop(anomaly_rate)) AS consistency FROM methods GROUP BY period, plant, unit""", PERIODS)
def period_summary(spark, sf):
    return backtest.period_summary(period_methods_table(spark, sf))


@query("B5_method_performance", "plant unit method avg_rate:d std_rate:d min_rate:d max_rate:d avg_anomalies:d consistency:d periods:l score:d", "SELECT * FROM perf", PERIODS)
def method_performance(spark, sf):
    return backtest.method_performance(period_methods_table(spark, sf))


@query("B5_best_method", "plant unit best score:d recommendations", """
    SELECT plant, unit, arg_max(method, (score, method)) AS best, max(score) AS score, CASE WHEN max(avg_rate) FILTER (method = 'baseline_tuned') < 2 THEN 'keep_baseline' ELSE 'review_baseline' END
           || CASE WHEN bool_or(consistency < 0.5) THEN ',investigate_variability' ELSE '' END || CASE WHEN bool_or(avg_rate > 10) THEN ',high_false_positives' ELSE '' END || ',recalibrate_monthly,compare_with_operators' AS recommendations FROM perf GROUP BY plant, unit""", PERIODS)
def best_method(spark, sf):
    best = backtest.best_method(backtest.method_performance(period_methods_table(spark, sf)))
    return best.withColumn("recommendations", F.array_join("recommendations", ","))


@query("B6_tuned_against_plain", "plant unit records:l original:l tuned:l fewer:l reduction_percent:d rating", """
    SELECT *, o - t AS fewer, o AS original, t AS tuned, coalesce((o - t) * 100.0 / nullif(o, 0), 0) AS reduction_percent, CASE WHEN coalesce((o - t) * 100.0 / nullif(o, 0), 0) > 50 THEN 'EXCELLENT' WHEN coalesce((o - t) * 100.0 / nullif(o, 0), 0) > 25 THEN 'GOOD' WHEN o - t > 0 THEN 'MODEST' ELSE 'NONE' END AS rating FROM
      (SELECT plant, unit, count(*) AS records, count(*) FILTER (abs(value - mean) > 3 * std) AS o, count(*) FILTER (value < coalesce(lower_limit, mean - 4 * std) OR value > coalesce(upper_limit, mean + 4 * std)) AS t
       FROM zs LEFT JOIN limits USING (plant, unit, tag) WHERE n >= 10 GROUP BY plant, unit)""", f"{ZS}, {LIMITS}")
def tuned_against_plain(spark, sf):
    return backtest.tuned_against_plain(readings(spark, sf), limits(spark, sf))


INJECTED = f"""{ZS}, picks AS (SELECT plant, unit, tag, time, mean + CASE WHEN u2 < 0.5 THEN -1 ELSE 1 END * 6 * std AS injected FROM
      (SELECT *, row_number() OVER (PARTITION BY plant, unit, tag ORDER BY u) AS rn FROM (SELECT *, {U.format(seed=42)} AS u, {U.format(seed=43)} AS u2 FROM zs WHERE n >= 20)) WHERE rn <= greatest(1, floor(n * 0.005)))"""


@query("B7_injected_readings", "plant unit tag time:t value:d is_injected:b", """
    SELECT r.plant, r.unit, r.tag, r.time, coalesce(injected, value) AS value, injected IS NOT NULL AS is_injected FROM readings r LEFT JOIN picks USING (plant, unit, tag, time)""", INJECTED)
def injected_readings(spark, sf):
    return backtest.inject(readings(spark, sf))


@query("B8_sensitivity", "plant unit injected_tags:l detected_tags:l recall:d false_alarm_rate:d before:l after:l", """
    SELECT plant, unit, count(*) FILTER (t) AS injected_tags, count(*) FILTER (t AND a > b) AS detected_tags, count(*) FILTER (t AND a > b) * 1.0 / nullif(count(*) FILTER (t), 0) AS recall, count(*) FILTER (NOT t AND a > b) * 1.0 / nullif(count(*) FILTER (NOT t), 0) AS false_alarm_rate,
           sum(b) AS before, sum(a) AS after FROM
      (SELECT plant, unit, tag, tag IN ('click', 'error') AS t, (SELECT count(*) FROM zs z WHERE z.plant = s.plant AND z.unit = s.unit AND z.tag = s.tag AND abs(z) > 2.5) AS b,
              (SELECT count(*) FROM zn z WHERE z.plant = s.plant AND z.unit = s.unit AND z.tag = s.tag AND abs(z2) > 2.5) AS a FROM (SELECT DISTINCT plant, unit, tag FROM readings) s) GROUP BY plant, unit""",
    f"""{INJECTED}, nv AS (SELECT r.plant, r.unit, r.tag, r.time, CASE WHEN r.tag IN ('click', 'error') THEN coalesce(injected, value) ELSE value END AS v FROM readings r LEFT JOIN picks USING (plant, unit, tag, time)),
    zn AS (SELECT *, (v - avg(v) OVER (PARTITION BY plant, unit, tag)) / stddev_samp(v) OVER (PARTITION BY plant, unit, tag) AS z2 FROM nv)""")
def sensitivity(spark, sf):
    r = readings(spark, sf)
    targets = r.where("tag IN ('click', 'error')").select(*SERIES).distinct()
    return backtest.sensitivity(r, targets)


# The chunk becomes part of the unit's name; the speed window is the unit's own.
CHUNKED = f"""{BINS}, rng AS (SELECT plant, unit, centre - greatest(100, centre * 0.03) AS speed_low, centre + greatest(100, centre * 0.03) AS speed_high FROM mode WHERE points >= 50),
    chunks AS (SELECT r.plant, r.unit || '#' || CAST(floor(date_diff('microsecond', start, time) / 8.64e11) AS BIGINT) AS unit, tag, time, value FROM readings r
      JOIN (SELECT plant, unit, max(time) AS e, greatest(min(time), max(time) - INTERVAL 30 DAY) AS start FROM readings GROUP BY plant, unit) USING (plant, unit) WHERE time >= start AND time < e)"""
CHUNKED += breakout_ctes(60).removeprefix(READINGS).replace("readings", "chunks").replace("LEFT JOIN filled s ON", "LEFT JOIN rng g ON g.plant = o.plant AND g.unit = split_part(o.unit, '#', 1) LEFT JOIN filled s ON").replace("BETWEEN 0 AND 100", "BETWEEN speed_low AND speed_high")


@query("B9_breakout_backtest", "plant unit total_tags:l flagged_tags:l events:l flag_rate:d", """
    WITH RECURSIVE chain AS (SELECT plant, unit, tag, min(p) AS p FROM hops GROUP BY plant, unit, tag
      UNION ALL SELECT c.plant, c.unit, c.tag, h.nxt FROM chain c JOIN hops h ON c.plant = h.plant AND c.unit = h.unit AND c.tag = h.tag AND c.p = h.p WHERE h.nxt IS NOT NULL)
    SELECT plant, unit, total_tags, coalesce(f, 0) AS flagged_tags, coalesce(e, 0) AS events, coalesce(f, 0) * 1.0 / total_tags AS flag_rate FROM
      (SELECT plant, split_part(unit, '#', 1) AS unit, count(DISTINCT tag) AS total_tags FROM chunks WHERE tag <> 'click' GROUP BY ALL)
      LEFT JOIN (SELECT plant, split_part(unit, '#', 1) AS unit, count(DISTINCT tag) AS f, count(*) AS e FROM chain GROUP BY ALL) USING (plant, unit)""", CHUNKED)
def breakout_backtest(spark, sf):
    r = readings(spark, sf)
    from plantspark.operators.speed import speed_window

    ranges = speed_window(r.where("tag = 'click'"))
    return backtest.breakout_backtest(r, "click", ranges, chunk_days=10, minutes=60)


# Plain readings (hm, hf, mx) and readings with injected spikes (the same names with _i).
SPIKED = (
    INSTRUMENTS + INJECTED.removeprefix(READINGS).replace("readings", "instruments")
    + ", spiked AS (SELECT r.plant, r.unit, r.tag, r.time, coalesce(injected, value) AS value FROM instruments r LEFT JOIN picks USING (plant, unit, tag, time)), "
    + GRID.format(src="instruments") + ", " + GRID.format(src="spiked").replace("hm", "hm_i").replace("hg", "hg_i").replace("hf", "hf_i") + ", " + matrix_cte() + ", " + matrix_cte("mx_i", "hf_i")
)


def _grid_ctes(fraction: float, end: str) -> str:
    return ", ".join(
        f"{based_cte(fraction, m, f'bx{e}')}, ob{e} AS (SELECT * FROM bx{e} WHERE is_base), {distance_ctes(f'bx{e}', f'ob{e}', e)}, {rates_ctes(f'md{e}', 0.99, e)}" for m, e in (("mx", end), ("mx_i", f"{end}i"))
    )


@query("B10_distance_grid", "plant unit baseline_fraction:d quantile:d base_rate:d after_rate:d score:d", " UNION ALL ".join(
    f"SELECT a.plant, a.unit, {f} AS baseline_fraction, 0.99 AS quantile, a.anomaly_rate AS base_rate, c.anomaly_rate AS after_rate, c.anomaly_rate - a.anomaly_rate - 2 * a.anomaly_rate AS score FROM rate{e} a JOIN rate{e}i c USING (plant, unit)" for f, e in ((0.6, "_6"), (0.7, "_7"))),
    f"{SPIKED}, {_grid_ctes(0.6, '_6')}, {_grid_ctes(0.7, '_7')}")
def distance_grid(spark, sf):
    return multivariate.tune_distance(instruments(spark, sf), fractions=(0.6, 0.7), quantiles=(0.99,))


def _forest_grid_ctes() -> str:
    out = [SPIKED, runs_ctes(), runs_ctes("hm_i", "mx_i", "_i"), split_runs_ctes(0.7), split_runs_ctes(0.7, "_i")]
    for e in ("", "_i"):
        out.append(forest_ctes(f"sr{e}", VALUES, fit="is_base", among="is_base", share=0.01, end=f"{e}_a", **UNIT_FOREST))
        out += cut_ctes("plant, unit", f"ranked{e}_a", 0.03, "is_base", f"{e}_b")
    for name, share in (("a", 0.01), ("b", 0.03)):
        out.append(f"grid_{name} AS (SELECT plant, unit, {share} AS contamination, p.anomaly_rate AS base_rate, q.anomaly_rate AS after_rate FROM ({FOREST_RATE.format('judged_' + name)}) p JOIN ({FOREST_RATE.format('judged_i_' + name)}) q USING (plant, unit))")
    return ", ".join(out)


@query("B11_forest_grid", "plant unit contamination:d trees:l base_rate:d after_rate:d score:d", """
    SELECT * EXCLUDE (r), 50 AS trees FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY score DESC, base_rate, after_rate, contamination) AS r FROM
      (SELECT *, after_rate - base_rate - 2 * base_rate AS score FROM (SELECT * FROM grid_a UNION ALL SELECT * FROM grid_b))) WHERE r = 1""", _forest_grid_ctes())
def forest_grid(spark, sf):
    return multivariate.best_setting(multivariate.tune_forest(instruments(spark, sf), contaminations=(0.01, 0.03), tree_counts=(50,)))
