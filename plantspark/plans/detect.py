"""Detectors, incidents and validation (T, U7 to U9, O8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark import pipeline
from plantspark.operators import dedup, detectors, incidents, speed, validation
from plantspark.plans.forests import forest_ctes
from plantspark.plans.inputs import INSTRUMENTS, READINGS, instruments, readings
from plantspark.plans.registry import query
from plantspark.plans.rows import SPEED, ZS, some_limits, speed_and_others
from plantspark.plans.speeds import FACTORS, config, factors
from plantspark.schema import SERIES, UNIT
from plantspark.streaming import pipelines

PART = "PARTITION BY plant, unit, tag ORDER BY time"
ROW = "plant unit tag time:t value:d"
KEY = "plant, unit, tag, time, value"


def sigma_ctes(source: str, base: str, z: str, recent: str) -> str:
    return f"""{base}, rolled AS (SELECT plant, unit, tag, time, value, count(value) OVER w AS rn, avg(value) OVER w AS rm, stddev_samp(value) OVER w AS rs FROM {source}
      WINDOW w AS ({PART} RANGE BETWEEN INTERVAL '89 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)),
    flags AS (SELECT *, coalesce(rn >= 20 AND abs(value - rm) / nullif(rs, 0) >= {z}, false) AS f, CASE WHEN rn >= 20 THEN rm END AS base, coalesce(rn >= 20 AND abs(value - rm) / nullif(rs, 0) >= {z}, false)
      AND time >= (SELECT max(time) FROM {source}) - INTERVAL {recent} AS r FROM rolled),
    isles AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER ({PART}) AS isle FROM flags),
    runs AS (SELECT plant, unit, tag, max(n) AS longest_run FROM (SELECT plant, unit, tag, isle, count(*) AS n FROM isles WHERE r GROUP BY ALL) GROUP BY ALL),
    tagged AS (SELECT plant, unit, tag, count(*) AS rows, count(*) FILTER (f) AS count, count(*) FILTER (r) AS last_24h, arg_max(value, time) AS current_value, coalesce(arg_max(base, time), arg_max(value, time)) AS baseline_mean FROM flags GROUP BY plant, unit, tag),
    scored AS (SELECT t.*, count * 1.0 / rows AS rate, coalesce(longest_run, 0) AS longest_run, last_24h >= 5 AS is_anomalous_24h, least(300, coalesce(abs((current_value - baseline_mean) / nullif(baseline_mean, 0)) * 100, 0)) AS deviation_percent,
      least(100, greatest(20, CAST(floor(20 + least(35, last_24h * 2.5) + least(30, coalesce(longest_run, 0) * 3) + least(15, count * 100.0 / rows)) AS BIGINT))) AS confidence_score FROM tagged t LEFT JOIN runs USING (plant, unit, tag)),
    sigma AS (SELECT *, CASE WHEN confidence_score >= 80 THEN 'HIGH' WHEN confidence_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM scored)"""


SIGMA_COLS = "plant unit tag rows:l count:l rate:d last_24h:l longest_run:l is_anomalous_24h:b current_value:d baseline_mean:d deviation_percent:d confidence_score:l confidence"
SIGMA = sigma_ctes("readings", READINGS, "2.5", "24 HOUR")


@query("T1_sigma_runs", SIGMA_COLS, "SELECT * FROM sigma", SIGMA)
def sigma_runs(spark, sf):
    """The default detector for every series, before its gate."""
    return detectors.sigma_runs(readings(spark, sf), gate=False)


RAISED = f"{READINGS}, lifted AS (SELECT plant, unit, tag, time, CASE WHEN tag IN ('click', 'view') AND time >= (SELECT max(time) FROM readings) - INTERVAL 14 HOUR THEN value + 600 ELSE value END AS value FROM readings)"
GATED = sigma_ctes("lifted", RAISED, "2.5", "24 HOUR")


def lifted(spark, sf):
    r = readings(spark, sf)
    late = F.col("tag").isin("click", "view") & (F.col("time") >= r.select(F.max("time")).scalar() - F.expr("INTERVAL '14' HOUR"))
    return r.withColumn("value", F.when(late, F.col("value") + 600).otherwise(F.col("value")))


@query("T1_sigma_gated", SIGMA_COLS, "SELECT * FROM sigma WHERE longest_run >= 6 AND last_24h > 0", GATED)
def sigma_gated(spark, sf):
    """The gated form on readings with a raised last half day."""
    return detectors.sigma_runs(lifted(spark, sf))


@query("T37_verified_units", "plant unit tags:l anomalies:l records:l verified:l", """
    SELECT plant, unit, count(*) AS tags, sum(count) AS anomalies, sum(rows) AS records, count(*) FILTER (longest_run >= 6 AND last_24h > 0) AS verified FROM sigma GROUP BY plant, unit""", GATED)
def verified_units(spark, sf):
    return detectors.verified_units(detectors.sigma_runs(lifted(spark, sf), gate=False))


@query("T1_run_pipeline", "plant unit tag rows:l count:l longest_run:l", "SELECT plant, unit, tag, rows, count, longest_run FROM sigma", GATED)
def run_pipeline(spark, sf):
    """Stored, read back, detected by name, stored again."""
    target, _ = pipelines.scratch(spark, "run")
    return pipeline.run(spark, lifted(spark, sf), target, "sigma_runs")


@query("T2_drop_alerts", ROW + " roll_mean:d alert:b", f"""
    SELECT {KEY}, CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END AS roll_mean, coalesce(value < 0.9 * CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END, false) AS alert
    FROM readings WINDOW w AS ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", READINGS)
def drop_alerts(spark, sf):
    return detectors.drop_alerts(readings(spark, sf))


@query("T3_sigma_candidates", ROW + " z:d", f"SELECT {KEY}, z FROM zs WHERE abs(z) > 2.5", ZS)
def sigma_candidates(spark, sf):
    return detectors.sigma_candidates(readings(spark, sf))


LIMITS = """limits AS (SELECT plant, unit, tag, min(value) + 1 AS lower_limit, max(value) / 2 AS upper_limit FROM readings WHERE tag IN ('click', 'view') GROUP BY plant, unit, tag)"""
BOUNDS = f"""{ZS}, {LIMITS}, b25 AS (SELECT r.*, coalesce(lower_limit, mean - 2.5 * std) AS lo, coalesce(upper_limit, mean + 2.5 * std) AS up, upper_limit IS NOT NULL AS configured FROM zs r LEFT JOIN limits USING (plant, unit, tag)),
    b40 AS (SELECT r.*, coalesce(lower_limit, mean - 4 * std) AS lo, coalesce(upper_limit, mean + 4 * std) AS up, upper_limit IS NOT NULL AS configured FROM zs r LEFT JOIN limits USING (plant, unit, tag))"""


def limits(spark, sf):
    return some_limits(spark, sf).join(readings(spark, sf).select(*SERIES).distinct(), ["unit", "tag"]).select(*SERIES, "lower_limit", "upper_limit")


VERIFIED = f"""{BOUNDS}, external AS (SELECT DISTINCT time FROM readings WHERE tag = 'signup' AND value > 230),
    ext AS (SELECT plant, unit, e.time FROM external e JOIN (SELECT plant, unit, min(time) AS a, max(time) AS b FROM readings GROUP BY plant, unit) ON e.time BETWEEN a AND b),
    times AS (SELECT plant, unit, time FROM zs WHERE abs(z) > 2.5 UNION SELECT * FROM ext),
    cand AS (SELECT b.*, date_diff('microsecond', time, (SELECT max(time) FROM readings)) / 3.6e9 AS a, value < lo OR value > up AS hit FROM b25 b JOIN times USING (plant, unit, time)),
    v0 AS (SELECT plant, unit, tag, max(n) AS n, count(*) AS candidates, count(*) FILTER (hit) AS mtd_count, coalesce(sum(exp(-ln(2) / 7 * greatest(0, a / 24))) FILTER (hit), 0) AS weighted_score,
      count(*) FILTER (hit AND a <= 24) AS last_24h, count(*) FILTER (hit AND a > 24 AND a <= 168) AS last_7d, count(*) FILTER (hit AND a > 168 AND a <= 720) AS last_30d, count(*) FILTER (hit AND a > 720) AS older FROM cand GROUP BY plant, unit, tag),
    v1 AS (SELECT v.*, mtd_count AS count, mtd_count * 1.0 / n AS rate, coalesce(s, 0) AS sigma_count, CAST(floor(coalesce(e, 0) * (candidates / greatest(1, t))) AS BIGINT) AS external_count, 0 AS forest_count FROM v0 v
      LEFT JOIN (SELECT plant, unit, tag, count(*) AS s FROM zs WHERE abs(z) > 2.5 GROUP BY ALL) USING (plant, unit, tag) LEFT JOIN (SELECT plant, unit, count(*) AS t FROM times GROUP BY ALL) USING (plant, unit)
      LEFT JOIN (SELECT plant, unit, count(*) AS e FROM ext GROUP BY ALL) USING (plant, unit)),
    v2 AS (SELECT *, CASE WHEN count > 0 THEN least(40.0, sigma_count * 4) + least(30.0, external_count * 3) + least(20.0, mtd_count * 2) END AS confidence_score,
      CASE WHEN count > 0 THEN CASE WHEN last_24h > 0 THEN 'CRITICAL' WHEN last_7d > 5 OR weighted_score > 10 THEN 'HIGH' WHEN last_30d > 10 OR weighted_score > 5 THEN 'MEDIUM' ELSE 'LOW' END END AS priority FROM v1),
    verified AS (SELECT *, CASE WHEN confidence_score >= 80 THEN 'VERY_HIGH' WHEN confidence_score >= 60 THEN 'HIGH' WHEN confidence_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM v2)"""
VERIFY_COLS = "plant unit tag n:l candidates:l count:l rate:d sigma_count:l external_count:l mtd_count:l forest_count:l weighted_score:d last_24h:l last_7d:l last_30d:l older:l priority confidence_score:d confidence"


def hybrid_table(spark, sf, **options):
    r = readings(spark, sf)
    external = r.where("tag = 'signup' AND value > 230").select("time")
    return detectors.hybrid(r, limits(spark, sf), external, **options)


@query("T4_verified_candidates", VERIFY_COLS, "SELECT * FROM verified", VERIFIED)
def verified_candidates(spark, sf):
    return hybrid_table(spark, sf)


def with_forest(body: str, trees: int = 50) -> str:
    """The verified table with the forest's rows beside the limits; ``body`` ends like VERIFIED."""
    forest = forest_ctes("readings", ["value"], trees=trees, min_rows=30, share=0.02, end="_v")
    body = body.replace("cand AS (SELECT", f"{forest}, cand AS (SELECT", 1)
    body = body.replace("value < lo OR value > up AS hit FROM b25 b JOIN times USING (plant, unit, time)", """value < lo OR value > up AS lim, coalesce(f, false) AS fo, value < lo OR value > up OR coalesce(f, false) AS hit FROM b25 b JOIN times USING (plant, unit, time)
      LEFT JOIN (SELECT plant, unit, tag, time, true AS f FROM judged_v WHERE is_outlier) USING (plant, unit, tag, time)""", 1)
    body = body.replace("count(*) FILTER (hit) AS mtd_count", "count(*) FILTER (lim) AS mtd_count, count(*) FILTER (fo) AS found, count(*) FILTER (hit) AS hits", 1)
    body = body.replace("mtd_count AS count, mtd_count * 1.0 / n AS rate", "hits AS count, hits * 1.0 / n AS rate", 1).replace("0 AS forest_count", "found AS forest_count", 1)
    return body.replace("+ least(20.0, mtd_count * 2) END", "+ least(20.0, mtd_count * 2) + least(10.0, forest_count) END", 1)


@query("T4_verified_with_forest", VERIFY_COLS, "SELECT * FROM verified", with_forest(VERIFIED))
def verified_with_forest(spark, sf):
    return hybrid_table(spark, sf, with_forest=True, trees=50)


@query("T5_hybrid_header", "plant unit records:l tags:l total_anomalies:l anomaly_rate:d sigma_total:l", """
    SELECT plant, unit, records, tags, total_anomalies, total_anomalies * 1.0 / records AS anomaly_rate, sigma_total FROM (SELECT plant, unit, count(*) AS records, count(DISTINCT tag) AS tags FROM readings GROUP BY plant, unit)
    JOIN (SELECT plant, unit, sum(count) AS total_anomalies, sum(sigma_count) AS sigma_total FROM verified GROUP BY plant, unit) USING (plant, unit)""", VERIFIED)
def hybrid_header(spark, sf):
    return detectors.unit_header(hybrid_table(spark, sf), readings(spark, sf))


INSTR_Z = f"""{INSTRUMENTS}, slow AS (SELECT plant, unit, tag, time, seq, CASE WHEN tag LIKE '%SI%' AND unit IN ('U-1', 'U-2') THEN value / 3 + 15 ELSE value + 60 END AS value FROM instruments),
    zs AS (SELECT r.*, n, m, sd, (value - m) / nullif(sd, 0) AS z FROM slow r JOIN (SELECT plant, unit, tag, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM slow GROUP BY plant, unit, tag) USING (plant, unit, tag)),
    times AS (SELECT DISTINCT plant, unit, time FROM zs WHERE abs(z) > 2.5),
    lim AS (SELECT plant, unit, tag, min(value) + 1 AS lo, max(value) / 2 AS up FROM slow WHERE tag LIKE '%FI-201%' GROUP BY plant, unit, tag),
    counted AS (SELECT plant, unit, tag, count(*) FILTER (value < coalesce(lo, m - 2.5 * sd) OR value > coalesce(up, m + 2.5 * sd)) AS c, max(n) AS n FROM zs JOIN times USING (plant, unit, time) LEFT JOIN lim USING (plant, unit, tag) GROUP BY plant, unit, tag),
    low AS (SELECT plant, unit, avg(value) < 50 AS low FROM slow WHERE tag LIKE '%SI%' AND time >= (SELECT max(time) FROM slow) - INTERVAL 72 HOUR GROUP BY plant, unit)"""


@query("T5_hybrid_status", "plant unit state mode", """
    SELECT plant, unit, CASE WHEN sum(count) > 0 THEN 'anomalies' ELSE 'clear' END AS state, 'sigma' AS mode FROM verified GROUP BY plant, unit
    UNION ALL SELECT DISTINCT plant, unit, 'awaiting_external_times', 'external' FROM readings""", VERIFIED)
def hybrid_status(spark, sf):
    """With sigma candidates, and with external times required but not given."""
    r = readings(spark, sf)
    with_sigma = detectors.hybrid_status(r, hybrid_table(spark, sf)).withColumn("mode", F.lit("sigma"))
    waiting = detectors.hybrid_status(r, detectors.hybrid(r, limits(spark, sf), require_external=True), require_external=True)
    return with_sigma.union(waiting.withColumn("mode", F.lit("external")))


@query("T6_status_aware", "plant unit tag unit_status count:l rate:d", """
    SELECT plant, unit, tag, CASE WHEN low THEN 'LOW_SPEED' ELSE 'RUNNING' END AS unit_status, CASE WHEN low THEN CAST(floor(c / 1.5) AS BIGINT) ELSE c END AS count, CASE WHEN low THEN c * 1.0 / n / 1.5 ELSE c * 1.0 / n END AS rate
    FROM counted JOIN low USING (plant, unit) WHERE NOT low OR floor(c / 1.5) > 0""", INSTR_Z)
def status_aware(spark, sf):
    slow = F.col("tag").contains("SI") & F.col("unit").isin("U-1", "U-2")
    df = instruments(spark, sf).withColumn("value", F.when(slow, F.col("value") / 3 + 15).otherwise(F.col("value") + 60))
    flow = df.where(F.col("tag").contains("FI-201")).groupBy(*SERIES).agg((F.min("value") + 1).alias("lower_limit"), (F.max("value") / 2).alias("upper_limit"))
    return detectors.status_aware(detectors.hybrid(df, flow), df, hours_back=72)


@query("T7_tuned_limits", ROW + " severity configured:b", f"""
    SELECT {KEY}, CASE WHEN abs(value - mean) > 3 * std THEN 'HIGH' ELSE 'MEDIUM' END AS severity, configured FROM b40 WHERE n >= 5 AND (value < lo OR value > up)""", BOUNDS)
def tuned_limits(spark, sf):
    return detectors.tuned_limits(readings(spark, sf), limits(spark, sf))


@query("T8_limit_counts", "plant unit tag n:l limit_count:l configured:b", """
    SELECT plant, unit, tag, max(n) AS n, count(*) FILTER (value < lo OR value > up) AS limit_count, bool_or(configured) AS configured FROM b40 WHERE n >= 5 GROUP BY plant, unit, tag""", BOUNDS)
def limit_counts(spark, sf):
    """The half of T8 that no random tree decides."""
    return detectors.tuned_counts(readings(spark, sf), limits(spark, sf)).drop("lower", "upper")


@query("T8_tuned_combined", "plant unit tag n:l limit_count:l forest_count:l count:l rate:d method confidence", """
    SELECT *, m AS limit_count, i AS forest_count, m + i AS count, (m + i) * 1.0 / n AS rate, CASE WHEN m > 0 AND i > 0 THEN 'MTD(' || m || ') + Isolation Forest(' || i || ')' WHEN m > 0 THEN 'MTD(' || m || ')' ELSE 'Isolation Forest(' || i || ')' END AS method,
           CASE WHEN m > 0 AND i > 0 THEN 'VERY HIGH' WHEN m > 0 THEN CASE WHEN c THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'HIGH' END AS confidence FROM
      (SELECT plant, unit, tag, max(n) AS n, count(*) FILTER (value < lo OR value > up) AS m, bool_or(configured) AS c FROM b40 WHERE n >= 5 GROUP BY plant, unit, tag)
      JOIN (SELECT plant, unit, tag, count(*) FILTER (is_outlier) AS i FROM judged GROUP BY plant, unit, tag) USING (plant, unit, tag) WHERE m + i > 0""", f"{BOUNDS}, {forest_ctes('readings', ['value'], trees=50, share=0.02)}")
def tuned_combined(spark, sf):
    """Limits and forest added up."""
    return detectors.tuned(readings(spark, sf), limits(spark, sf), trees=50)


@query("T10_four_sigma_fallback", "plant unit tag count:l rate:d", "SELECT plant, unit, tag, count(*) AS count, count(*) * 1.0 / max(n) AS rate FROM zs WHERE n >= 10 AND abs(value - mean) > 4 * std GROUP BY plant, unit, tag", ZS)
def four_sigma(spark, sf):
    return detectors.fallback_four_sigma(readings(spark, sf))


@query("T11_process_aware", "plant unit tag n:l anomaly_count:l anomaly_percent:d adjacent:l lower:d upper:d configured:b confidence", f"""
    SELECT plant, unit, tag, n, c AS anomaly_count, c * 100.0 / n AS anomaly_percent, adj AS adjacent, lo AS lower, up AS upper, configured, CASE WHEN adj > c * 0.5 THEN 'LOW (Possible Sensor Issue)' WHEN configured THEN 'HIGH (Baseline-Tuned)'
           ELSE 'MEDIUM (Default Conservative)' END AS confidence FROM
      (SELECT plant, unit, tag, max(n) AS n, count(*) FILTER (h) AS c, max(lo) AS lo, max(up) AS up, bool_or(configured) AS configured, greatest(0, coalesce(max(k) FILTER (h), 0) - 1) AS adj FROM
        (SELECT *, count(*) FILTER (h) OVER (PARTITION BY plant, unit, tag, isle) AS k FROM (SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER ({PART}) AS isle FROM (SELECT *, value < lo OR value > up AS h FROM b40))) GROUP BY plant, unit, tag)""", BOUNDS)
def process_aware(spark, sf):
    return detectors.process_aware(readings(spark, sf), limits(spark, sf), hours_back=None)


SPEED_CV = "scv AS (SELECT plant, unit, coalesce(stddev_samp(value) / nullif(avg(value), 0), 0) AS cv FROM readings r JOIN cfg c USING (plant, unit) WHERE r.tag IN (t1, t2) GROUP BY plant, unit)"
PRIMARY = f"""{FACTORS}, {SPEED_CV}, zs AS (SELECT r.*, n, mean, std, (value - mean) / nullif(std, 0) AS z FROM readings r JOIN (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM readings GROUP BY plant, unit, tag) s USING (plant, unit, tag)),
    prim AS (SELECT zs.*, CASE WHEN cv > 0.2 THEN 2.2 WHEN cv < 0.05 THEN 2.7 ELSE 2.5 END AS sigma_used FROM zs LEFT JOIN scv USING (plant, unit) WHERE n >= 20 AND abs(z) > CASE WHEN cv > 0.2 THEN 2.2 WHEN cv < 0.05 THEN 2.7 ELSE 2.5 END)"""


def primary(spark, sf):
    r = readings(spark, sf)
    return detectors.primary_sigma(r, speed_cv=detectors.speed_variation(r, config(spark)))


@query("T12_primary_sigma", ROW + " anomaly_score:d sigma_used:d", f"SELECT {KEY}, abs(z) AS anomaly_score, sigma_used FROM prim", PRIMARY)
def primary_sigma(spark, sf):
    return primary(spark, sf)


def tau_ctes(source: str, primary_name: str, end: str = "") -> str:
    return f"""near{end} AS (SELECT p.plant, p.unit, p.tag, p.time, p.value, max(p.n) AS n, max(p.mean) AS mean, max(p.std) AS std, count(r.value) AS nn, avg(r.value) AS nm, stddev_samp(r.value) AS ns FROM {primary_name} p JOIN {source} r
      ON p.plant = r.plant AND p.unit = r.unit AND p.tag = r.tag AND r.time BETWEEN p.time - INTERVAL 1 HOUR AND p.time + INTERVAL 1 HOUR GROUP BY p.plant, p.unit, p.tag, p.time, p.value),
    taus{end} AS (SELECT plant, unit, tag, time, value, CASE WHEN nn < 10 THEN n ELSE nn END AS k, abs(value - CASE WHEN nn < 10 THEN mean ELSE nm END) / nullif(CASE WHEN nn < 10 THEN std ELSE ns END, 0) AS tau FROM near{end}),
    ok{end} AS (SELECT *, CASE WHEN k <= 10 THEN 1.15 WHEN k <= 50 THEN 1.4 ELSE 1.5 END AS tau_limit FROM taus{end} WHERE k >= 3 AND tau > CASE WHEN k <= 10 THEN 1.15 WHEN k <= 50 THEN 1.4 ELSE 1.5 END)"""


@query("T13_tau_verified", ROW + " tau:d tau_limit:d", f"SELECT {KEY}, tau, tau_limit FROM ok", f"{PRIMARY}, {tau_ctes('readings', 'prim')}")
def tau_verified(spark, sf):
    return detectors.tau_verified(primary(spark, sf), readings(spark, sf))


FIVE = ["value", "lag1", "step", "mean5", "std5"]


def five_ctes(source: str, end: str = "", extra: str = "") -> str:
    """The five features of every reading of ``source``; ``extra``: more text in its FROM clause."""
    return f"""five{end} AS (SELECT * FROM (SELECT plant, unit, tag, time, value, coalesce(lag(value) OVER o, 0) AS lag1, coalesce(value - lag(value) OVER o, 0) AS step, avg(value) OVER w AS mean5, coalesce(stddev_samp(value) OVER w, 0) AS std5
      FROM {source} WINDOW o AS ({PART}), w AS ({PART} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)){extra})"""


STAGED = f"""{PRIMARY}, {tau_ctes('readings', 'prim')}, wanted AS (SELECT plant, unit, tag, count(*) AS wv, max(n) AS wn FROM ok JOIN (SELECT plant, unit, tag, time, n FROM prim) USING (plant, unit, tag, time) GROUP BY plant, unit, tag),
    {five_ctes('readings', '', ' JOIN wanted USING (plant, unit, tag) WHERE wn >= 10')}, {forest_ctes('five', FIVE, trees=50, share='least(0.1, wv * 1.0 / wn)')},
    final AS (SELECT ok.*, score FROM ok JOIN (SELECT plant, unit, tag, time, score FROM judged WHERE is_outlier) USING (plant, unit, tag, time) UNION ALL SELECT ok.*, NULL FROM ok SEMI JOIN (SELECT * FROM wanted WHERE wn < 10) USING (plant, unit, tag))"""


@query("T14_forest_verified", ROW + " tau:d forest_score:d", f"SELECT {KEY}, tau, score AS forest_score FROM final", STAGED)
def forest_verified(spark, sf):
    r = readings(spark, sf)
    return detectors.forest_verified(detectors.tau_verified(primary(spark, sf), r), r, trees=50)


@query("T15_three_stage", ROW + " anomaly_score:d tau:d stage", """
    SELECT p.plant, p.unit, p.tag, p.time, p.value, abs(z) AS anomaly_score, ok.tau, CASE WHEN f.time IS NOT NULL THEN 'primary+mtd+isolation_forest' WHEN ok.tau IS NOT NULL THEN 'primary+mtd' ELSE 'primary' END AS stage FROM prim p
    LEFT JOIN ok ON p.plant = ok.plant AND p.unit = ok.unit AND p.tag = ok.tag AND p.time = ok.time LEFT JOIN final f ON p.plant = f.plant AND p.unit = f.unit AND p.tag = f.tag AND p.time = f.time""", STAGED)
def three_stage(spark, sf):
    r = readings(spark, sf)
    return detectors.three_stage(r, speed_cv=detectors.speed_variation(r, config(spark)), trees=50)


QUART = """q AS (SELECT plant, unit, tag, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM readings GROUP BY plant, unit, tag)"""


@query("T16_statistical", ROW + " anomaly_score:d anomaly_method", f"""
    SELECT {KEY}, abs(value - mean) / nullif(std, 0) AS anomaly_score, CASE WHEN abs(value - mean) / std > CASE WHEN cv > 0.2 THEN 2.5 ELSE 3 END THEN 'z_score' ELSE 'iqr' END AS anomaly_method
    FROM zs JOIN q USING (plant, unit, tag) LEFT JOIN scv USING (plant, unit) WHERE n >= 10 AND (abs(value - mean) / std > CASE WHEN cv > 0.2 THEN 2.5 ELSE 3 END
      OR value < q1 - CASE WHEN cv > 0.2 THEN 1.2 ELSE 1.5 END * (q3 - q1) OR value > q3 + CASE WHEN cv > 0.2 THEN 1.2 ELSE 1.5 END * (q3 - q1))""", f"{PRIMARY}, {QUART}")
def statistical(spark, sf):
    r = readings(spark, sf)
    return detectors.statistical(r, adaptive=True, speed_cv=detectors.speed_variation(r, config(spark)))


SIXTH = """near AS (SELECT plant, unit, tag, time, coalesce(CASE WHEN nt IS NULL OR gb <= gn THEN CASE WHEN gb <= 600000000 THEN bv END WHEN gn <= 600000000 THEN nv END, 0) AS speed_value FROM
      (SELECT b.*, n.time AS nt, n.value AS nv, coalesce(epoch_us(n.time) - epoch_us(b.time), 1000000000000) AS gn FROM
        (SELECT o.*, s.value AS bv, coalesce(epoch_us(o.time) - epoch_us(s.time), 1000000000000) AS gb FROM readings o ASOF LEFT JOIN speed s ON o.plant = s.plant AND o.unit = s.unit AND o.time >= s.time) b
       ASOF LEFT JOIN speed n ON b.plant = n.plant AND b.unit = n.unit AND b.time <= n.time))"""


@query("T17_forest_anomalies", ROW + " anomaly_score:d anomaly_method", f"SELECT {KEY}, score AS anomaly_score, 'isolation_forest' AS anomaly_method FROM judged WHERE is_outlier",
    f"{SPEED}, {SIXTH}, {five_ctes('readings', '', ' JOIN near USING (plant, unit, tag, time)')}, {forest_ctes('five', [*FIVE, 'speed_value'], trees=50, share=0.05)}")
def forest_anomalies(spark, sf):
    speed_rows, _ = speed_and_others(spark, sf)
    return detectors.forest_anomalies(readings(spark, sf), adaptive=True, speed_rows=speed_rows, trees=50)


@query("T18_hybrid_union", ROW + " anomaly_score:d anomaly_method", f"""
    SELECT {KEY}, arg_min(s, k) AS anomaly_score, 'hybrid' AS anomaly_method FROM (SELECT {KEY}, score AS s, 0 AS k FROM judged WHERE is_outlier UNION ALL
      SELECT {KEY}, coalesce(abs(value - mean) / nullif(std, 0), 1) AS s, 1 AS k FROM zs JOIN q USING (plant, unit, tag) WHERE n >= 10 AND (abs(value - mean) / nullif(std, 0) > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) GROUP BY {KEY}""",
    f"{ZS}, {QUART}, {five_ctes('readings')}, {forest_ctes('five', FIVE, trees=50)}")
def hybrid_union(spark, sf):
    return detectors.hybrid_union(readings(spark, sf), trees=50)


@query("T19_speed_correlated", ROW + " speed_n:l speed_mean:d speed_std:d speed_cv_near:d", f"""
    SELECT * FROM (SELECT o.plant, o.unit, tag, o.time, o.value, count(s.value) AS speed_n, avg(s.value) AS speed_mean, stddev_samp(s.value) AS speed_std, stddev_samp(s.value) / nullif(avg(s.value), 0) AS speed_cv_near
      FROM others o LEFT JOIN speed s ON o.plant = s.plant AND o.unit = s.unit AND s.time BETWEEN o.time - INTERVAL 120 MINUTE AND o.time + INTERVAL 120 MINUTE WHERE o.value > 100 GROUP BY o.plant, o.unit, tag, o.time, o.value)
    WHERE speed_n >= 3 AND speed_mean > 0 AND speed_cv_near > 0.1""", SPEED)
def speed_correlated(spark, sf):
    speed_rows, others = speed_and_others(spark, sf)
    return detectors.speed_correlated(others.where("value > 100").select(*SERIES, "time", "value"), speed_rows, minutes=120)


@query("T20_isolation_forest", ROW + " score:d is_outlier:b", f"SELECT {KEY}, score, is_outlier FROM judged", f"{READINGS}, {forest_ctes('readings', ['value'], share=0.02)}")
def isolation_forest(spark, sf):
    from plantspark.operators import forest

    return forest.outliers(readings(spark, sf).select(*SERIES, "time", "value"), contamination=0.02)


@query("T21_speed_aware", "plant unit data_points:l original_anomalies:l compensated_anomalies:l reduction:d factor:d", """
    SELECT plant, unit, d AS data_points, coalesce(o, 0) AS original_anomalies, coalesce(k, 0) AS compensated_anomalies, CASE WHEN coalesce(o, 0) = 0 THEN 0 ELSE greatest(0, (o - coalesce(k, 0)) * 1.0 / o) END AS reduction, CASE WHEN applied THEN raw_factor ELSE 1 END AS factor FROM factors
    JOIN (SELECT plant, unit, count(*) AS d FROM readings GROUP BY plant, unit) USING (plant, unit)
    LEFT JOIN (SELECT plant, unit, count(*) AS o FROM zs JOIN q USING (plant, unit, tag) WHERE n >= 10 AND (abs(value - mean) / std > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) GROUP BY plant, unit) USING (plant, unit)
    LEFT JOIN (SELECT plant, unit, count(*) AS k FROM (SELECT r.*, s.* EXCLUDE (plant, unit, tag) FROM compensated r JOIN (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM compensated GROUP BY plant, unit, tag) s USING (plant, unit, tag)) LEFT JOIN scv USING (plant, unit)
      WHERE n >= 10 AND (abs(value - mean) / std > CASE WHEN cv > 0.2 THEN 2.5 ELSE 3 END OR value < q1 - CASE WHEN cv > 0.2 THEN 1.2 ELSE 1.5 END * (q3 - q1) OR value > q3 + CASE WHEN cv > 0.2 THEN 1.2 ELSE 1.5 END * (q3 - q1)) GROUP BY plant, unit) USING (plant, unit)""",
    f"{PRIMARY}, {QUART}")
def speed_aware(spark, sf):
    return detectors.speed_aware(readings(spark, sf), config(spark), "statistical", min_confidence=0.3)


REPORT = f"""{PRIMARY}, p0 AS (SELECT * FROM zs WHERE n >= 20 AND abs(z) > 2.5), {tau_ctes("readings", "p0")},
    zc AS (SELECT r.*, n, mean, std, (value - mean) / nullif(std, 0) AS z FROM compensated r JOIN (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM compensated GROUP BY plant, unit, tag) s USING (plant, unit, tag)),
    pc AS (SELECT zc.* FROM zc LEFT JOIN scv USING (plant, unit) WHERE n >= 20 AND abs(z) > CASE WHEN cv > 0.2 THEN 2.2 WHEN cv < 0.05 THEN 2.7 ELSE 2.5 END), {tau_ctes("compensated", "pc", "_c")},
    spd AS (SELECT r.plant, r.unit, r.time, r.value FROM readings r JOIN cfg c ON c.plant = r.plant AND c.unit = r.unit AND r.tag IN (t1, t2)),
    corr AS (SELECT o.plant, o.unit, o.tag, o.time, count(s.value) AS k, avg(s.value) AS m, stddev_samp(s.value) AS sd FROM ok o JOIN spd s ON s.plant = o.plant AND s.unit = o.unit AND s.time BETWEEN o.time - INTERVAL 30 MINUTE AND o.time + INTERVAL 30 MINUTE GROUP BY ALL),
    counts AS (SELECT f.*, d, coalesce(o, 0) AS o, coalesce(k, 0) AS k, coalesce(x, 0) AS x, CASE WHEN coalesce(o, 0) > 0 THEN greatest(0, (o - coalesce(k, 0)) * 1.0 / o) ELSE 0 END AS red,
      CASE f.unit WHEN 'U-2' THEN CASE WHEN confidence < 0.3 THEN 3 ELSE 2 END WHEN 'U-3' THEN 1 ELSE 0 END AS w FROM factors f JOIN (SELECT plant, unit, count(*) AS d FROM readings GROUP BY ALL) USING (plant, unit)
      LEFT JOIN (SELECT plant, unit, count(*) AS o FROM ok GROUP BY ALL) USING (plant, unit) LEFT JOIN (SELECT plant, unit, count(*) AS k FROM ok_c GROUP BY ALL) USING (plant, unit)
      LEFT JOIN (SELECT plant, unit, count(*) AS x FROM corr WHERE k >= 3 AND m > 0 AND sd / m > 0.1 GROUP BY ALL) USING (plant, unit))"""


@query("T22_speed_aware_report", "plant unit data_points:l original_anomalies:l compensated_anomalies:l speed_correlated:l reduction:d confidence_score:d factor:d compensation_confidence:d warnings_count:l", """
    SELECT plant, unit, d AS data_points, o AS original_anomalies, k AS compensated_anomalies, x AS speed_correlated, red AS reduction, CASE WHEN applied THEN raw_factor ELSE 1 END AS factor, confidence AS compensation_confidence, w AS warnings_count,
           greatest(0, least(1, (confidence + CASE WHEN o > 0 THEN least(0.3, red * 0.5) ELSE 0 END) * CASE WHEN speed_points < 10 THEN 0.8 ELSE 1 END - w * 0.05)) AS confidence_score FROM counts""", REPORT)
def speed_aware_report(spark, sf):
    return detectors.speed_aware(readings(spark, sf), config(spark), "sigma_tau", min_confidence=0.3)


SEGMENT = f"""{FACTORS}, {LIMITS}, seg AS (SELECT plant, unit, tag, time, seq, f AS factor, CASE WHEN abs(f - 1) >= 0.01 AND tag IS DISTINCT FROM t1 AND tag IS DISTINCT FROM t2 THEN value * f ELSE value END AS value FROM
      (SELECT r.*, t1, t2, CASE WHEN s > 0 AND base IS NOT NULL THEN greatest(0.1, least(10, base / s)) ELSE 1 END AS f FROM readings r LEFT JOIN cfg c USING (plant, unit)
       LEFT JOIN (SELECT c.plant, c.unit, avg(value) AS s FROM cfg c JOIN readings r ON c.plant = r.plant AND c.unit = r.unit AND c.t1 = r.tag GROUP BY c.plant, c.unit) USING (plant, unit)))"""
SEGMENT_VERIFIED = SEGMENT + with_forest(VERIFIED.removeprefix(READINGS).replace(", " + LIMITS, "")).replace("readings", "seg").replace("WHERE tag = 'signup' AND value > 230", "WHERE false")


@query("T23_segment_aware", "plant unit tag n:l count:l sigma_count:l mtd_count:l forest_count:l confidence factor:d verified:b", """
    SELECT v.*, factor, (sigma_count > 0 OR external_count > 0) AND (mtd_count > 0 OR forest_count > 0) AND confidence IN ('HIGH', 'MEDIUM') AS verified FROM verified v JOIN (SELECT plant, unit, max(factor) AS factor FROM seg GROUP BY plant, unit) USING (plant, unit)""", SEGMENT_VERIFIED)
def segment_aware(spark, sf):
    return detectors.segment_aware(readings(spark, sf), config(spark), limits(spark, sf), trees=50)


def breakout_ctes(minutes: int) -> str:
    return f"""{READINGS}, means AS (SELECT plant, unit, tag, time_bucket(INTERVAL {minutes} MINUTE, time) AS b, avg(value) AS value FROM readings GROUP BY ALL),
    grid AS (SELECT plant, unit, tag, b FROM (SELECT DISTINCT plant, unit, tag FROM means) JOIN (SELECT plant, unit, unnest(generate_series(min(b), max(b), INTERVAL {minutes} MINUTE)) AS b FROM means GROUP BY plant, unit) USING (plant, unit)),
    filled AS (SELECT plant, unit, tag, b, last_value(value IGNORE NULLS) OVER (PARTITION BY plant, unit, tag ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM grid LEFT JOIN means USING (plant, unit, tag, b)),
    outside AS (SELECT plant, unit, tag, b, CASE WHEN count(value) OVER w >= 10 THEN coalesce(value < quantile_cont(value, 0.1) OVER w OR value > quantile_cont(value, 0.9) OVER w, false) ELSE false END AS o FROM filled WHERE tag <> 'click'
      WINDOW w AS (PARTITION BY plant, unit, tag ORDER BY b ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    held AS (SELECT o.*, coalesce(s.value BETWEEN 0 AND 100, false) AS mask, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY o.plant, o.unit, o.tag ORDER BY o.b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS h,
      row_number() OVER (PARTITION BY o.plant, o.unit, o.tag ORDER BY o.b) AS p FROM outside o LEFT JOIN filled s ON s.plant = o.plant AND s.unit = o.unit AND s.b = o.b AND s.tag = 'click'),
    hits AS (SELECT plant, unit, tag, p FROM held WHERE h AND mask),
    hops AS (SELECT h.plant, h.unit, h.tag, h.p, min(n.p) AS nxt FROM hits h LEFT JOIN hits n ON h.plant = n.plant AND h.unit = n.unit AND h.tag = n.tag AND n.p >= h.p + 5 AND n.p < h.p + 3000 GROUP BY ALL)"""


@query("T24_breakouts", "plant unit tag events:l points:l rate:d", """
    WITH RECURSIVE chain AS (SELECT plant, unit, tag, min(p) AS p FROM hops GROUP BY plant, unit, tag
      UNION ALL SELECT c.plant, c.unit, c.tag, h.nxt FROM chain c JOIN hops h ON c.plant = h.plant AND c.unit = h.unit AND c.tag = h.tag AND c.p = h.p WHERE h.nxt IS NOT NULL)
    SELECT plant, unit, tag, events, points, events * 1.0 / greatest(1, points) AS rate FROM (SELECT plant, unit, tag, count(*) AS events FROM chain GROUP BY plant, unit, tag)
    JOIN (SELECT plant, unit, tag, count(*) FILTER (mask) AS points FROM held GROUP BY plant, unit, tag) USING (plant, unit, tag)""", breakout_ctes(60))
def breakouts(spark, sf):
    r = readings(spark, sf)
    ranges = r.select(*UNIT).distinct().withColumn("speed_low", F.lit(0.0)).withColumn("speed_high", F.lit(100.0))
    return detectors.breakouts(r, "click", ranges, minutes=60)


@query("T26_iqr_anomalies", ROW + " iqr_low:d iqr_high:d", f"""
    SELECT {KEY}, q1 - 1.5 * (q3 - q1) AS iqr_low, q3 + 1.5 * (q3 - q1) AS iqr_high FROM zs JOIN q USING (plant, unit, tag) WHERE n >= 50 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""", f"{ZS}, {QUART}")
def iqr_anomalies(spark, sf):
    return detectors.iqr_anomalies(readings(spark, sf))


STABLE = f"""{READINGS}, m0 AS (SELECT plant, unit, tag, avg(value) AS m, stddev_pop(value) AS s FROM readings GROUP BY plant, unit, tag),
    m1 AS (SELECT plant, unit, tag, avg(value) AS sm, stddev_pop(value) AS ss FROM readings JOIN m0 USING (plant, unit, tag) WHERE abs((value - m) / s) <= 2.5 GROUP BY plant, unit, tag)"""


@query("T27_stable_band", "plant unit tag stable_mean:d stable_std:d band_low:d band_high:d",
    "SELECT plant, unit, tag, sm AS stable_mean, ss AS stable_std, sm - 2.5 * ss AS band_low, sm + 2.5 * ss AS band_high FROM m1", STABLE)
def stable_band(spark, sf):
    return detectors.stable_band(readings(spark, sf))


@query("T27_stabilised", ROW + " is_spike:b stabilised:d", f"""
    SELECT {KEY}, spike AS is_spike, coalesce(CASE WHEN NOT spike THEN value END, a.v + (b.v - a.v) * (epoch_us(time) - a.t) / nullif(b.t - a.t, 0), a.v, b.v) AS stabilised FROM
      (SELECT *, last_value(p IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(p IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM
        (SELECT r.*, abs((value - sm) / ss) > 2.5 AS spike, CASE WHEN abs((value - sm) / ss) <= 2.5 THEN {{'t': epoch_us(time), 'v': value}} END AS p FROM readings r JOIN m1 USING (plant, unit, tag)))""", STABLE)
def stabilised(spark, sf):
    return detectors.stabilised(readings(spark, sf))


@query("T28_upper_spikes", ROW + " threshold:d", f"""
    SELECT {KEY}, m + 3 * s AS threshold FROM readings JOIN (SELECT plant, unit, avg(value) AS m, stddev_samp(value) AS s FROM readings GROUP BY plant, unit) USING (plant, unit) WHERE value > m + 3 * s""", READINGS)
def upper_spikes(spark, sf):
    return detectors.upper_spikes(readings(spark, sf)).withColumn("threshold", F.col("mean") + 3 * F.col("std"))


INCIDENTS = f"""{ZS}, steps AS (SELECT *, abs(value - lag(value) OVER ({PART})) AS d FROM zs), lim AS (SELECT plant, unit, tag, quantile_cont(d, 0.95) AS t FROM steps GROUP BY plant, unit, tag),
    zi AS (SELECT {KEY}, abs(z) AS size, CASE WHEN abs(z) > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'z_score' AS method, 0 AS mo FROM zs WHERE n > 10 AND abs(z) > 3),
    ji AS (SELECT {KEY}, d AS size, CASE WHEN d > 2 * t THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'jump_detection' AS method, 1 AS mo FROM steps JOIN lim USING (plant, unit, tag) WHERE n >= 10 AND d > t),
    inc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, date_trunc('minute', time) AS minute, row_number() OVER (PARTITION BY plant, unit, tag, date_trunc('minute', time) ORDER BY mo, time) AS rn FROM (SELECT * FROM zi UNION ALL SELECT * FROM ji)) WHERE rn = 1)"""
INCIDENT = ROW + " size:d severity method"


@query("T29_jump_incidents", INCIDENT, "SELECT * FROM ji", INCIDENTS)
def jump_incidents(spark, sf):
    return incidents.jump_incidents(readings(spark, sf))


@query("T30_z_incidents", INCIDENT, "SELECT * FROM zi", INCIDENTS)
def z_incidents(spark, sf):
    return incidents.z_incidents(readings(spark, sf))


@query("U9_one_per_minute", INCIDENT + " minute:t", "SELECT * FROM inc ORDER BY time DESC", INCIDENTS)
def one_per_minute(spark, sf):
    return incidents.incidents(readings(spark, sf))


@query("T31_incident_report", "plant unit tag rank:l total_anomalies:l equipment area tag_id tag_type incidents:l high_incidents:l last_incident:t action", """
    SELECT plant, unit, tag, rank, total_anomalies, coalesce(name, 'Equipment Unknown') AS equipment, CASE WHEN name IS NULL THEN 'Unknown Area' ELSE 'Hall' END AS area, split_part(tag, '_', 3) AS tag_id,
           CASE split_part(tag, '_', 3) WHEN 'TI-401' THEN 'Temperature Indicator' WHEN 'PIA-301' THEN 'Pressure Indicator' WHEN 'FI-201' THEN 'Flow Indicator' WHEN 'SI-101' THEN 'Speed Indicator' ELSE 'Vibration Indicator' END AS tag_type,
           i AS incidents, h AS high_incidents, l AS last_incident, CASE split_part(tag, '_', 3)
             WHEN 'TI-401' THEN 'URGENT: Check thermal conditions on ' || coalesce(name, 'Equipment Unknown') || ' - ' || i || ' temperature anomalies detected. Verify cooling/heating systems.'
             WHEN 'PIA-301' THEN 'URGENT: Investigate pressure system on ' || coalesce(name, 'Equipment Unknown') || ' - ' || i || ' pressure anomalies. Check for leaks, blockages, or control issues.'
             WHEN 'FI-201' THEN 'CHECK: Investigate flow conditions on ' || coalesce(name, 'Equipment Unknown') || ' - ' || i || ' flow anomalies. Verify flow elements and control.'
             WHEN 'SI-101' THEN 'URGENT: Check rotational equipment on ' || coalesce(name, 'Equipment Unknown') || ' - ' || i || ' speed anomalies. Inspect coupling, bearings, drive system.'
             ELSE 'URGENT: Mechanical inspection required on ' || coalesce(name, 'Equipment Unknown') || ' - ' || i || ' vibration anomalies. Check alignment, balance, bearings.' END AS action FROM
      (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY total_anomalies DESC, tag) AS rank FROM (SELECT plant, unit, tag, count(*) AS total_anomalies FROM zs WHERE abs(z) > 2.5 GROUP BY plant, unit, tag))
    JOIN (SELECT plant, unit, tag, count(*) AS i, count(*) FILTER (severity = 'HIGH') AS h, max(time) AS l FROM inc GROUP BY plant, unit, tag) USING (plant, unit, tag)
    LEFT JOIN (VALUES ('U-0', 'Compressor A'), ('U-1', 'Compressor B')) e(unit, name) USING (unit) WHERE rank <= 3""",
    f"{INSTRUMENTS}{INCIDENTS.removeprefix(READINGS).replace('readings', 'instruments')}")
def incident_report(spark, sf):
    df = instruments(spark, sf)
    equipment = spark.createDataFrame(
        [("U-0", "Compressor A", "Centrifugal", "Hall", "Gas", "High"), ("U-1", "Compressor B", "Centrifugal", "Hall", "Gas", "High")], incidents.EQUIPMENT
    )
    return incidents.incident_report(df, detectors.candidate_counts(detectors.sigma_candidates(df)), equipment, hours_back=24 * 365, top=3)


CHECKS = f"""{INSTRUMENTS}, src AS (SELECT plant, unit, tag, time, CASE WHEN tag LIKE '%PIA%' THEN value - 5 WHEN tag LIKE '%XI%' THEN floor(value / 300) ELSE value END AS value FROM instruments),
    base AS (SELECT plant, unit, tag, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM src GROUP BY plant, unit, tag),
    mads AS (SELECT plant, unit, tag, median(abs(value - med)) AS mad FROM src JOIN base USING (plant, unit, tag) GROUP BY plant, unit, tag),
    sv AS (SELECT plant, unit, tag, max(n) AS n, count(*) FILTER (abs(value - mean) > 3 * sd) AS z_outliers, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
      count(*) FILTER (mad > 0 AND abs(0.6745 * (value - med) / nullif(mad, 0)) > 3.5) AS mad_outliers FROM src JOIN base USING (plant, unit, tag) JOIN mads USING (plant, unit, tag) WHERE n >= 30 GROUP BY plant, unit, tag),
    stat AS (SELECT *, CASE WHEN mean_rate < 1 THEN 'LIKELY_FALSE_POSITIVE' WHEN mean_rate < 5 THEN 'INVESTIGATE_FURTHER' ELSE 'LIKELY_GENUINE' END AS verdict, CASE WHEN mean_rate < 1 THEN 85 WHEN mean_rate < 5 THEN 60 ELSE 80 END AS confidence
      FROM (SELECT *, (z_outliers + iqr_outliers + mad_outliers) / 3.0 / n * 100 AS mean_rate FROM sv)),
    typed AS (SELECT *, CASE WHEN tag LIKE '%TI-%' THEN 'TEMPERATURE' WHEN tag LIKE '%PIA%' THEN 'PRESSURE' WHEN tag LIKE '%FI-%' THEN 'FLOW' WHEN tag LIKE '%SI-%' THEN 'SPEED' ELSE 'VIBRATION' END AS tag_type FROM src),
    ev AS (SELECT plant, unit, tag, tag_type, count(*) AS n, count(*) FILTER (CASE tag_type WHEN 'TEMPERATURE' THEN value < -50 OR value > 1000 WHEN 'VIBRATION' THEN false ELSE value < 0 END) * 100.0 / count(*) AS impossible_rate,
      count(*) FILTER (CASE tag_type WHEN 'TEMPERATURE' THEN value < 0 OR value > 200 WHEN 'PRESSURE' THEN value > 100 WHEN 'VIBRATION' THEN false ELSE value > 10000 END) * 100.0 / count(*) AS suspicious_rate FROM typed GROUP BY ALL),
    eng AS (SELECT *, CASE WHEN impossible_rate > 5 THEN 'DATA_QUALITY_ISSUE' WHEN suspicious_rate > 20 THEN 'INVESTIGATE_SENSOR' ELSE 'ENGINEERING_OK' END AS verdict, CASE WHEN impossible_rate > 5 THEN 90 WHEN suspicious_rate > 20 THEN 75 ELSE 70 END AS confidence FROM ev),
    st AS (SELECT *, value - lag(value) OVER ({PART}) AS d FROM src), nz AS (SELECT plant, unit, tag, count(*) AS n, count(d) AS k, stddev_pop(d) AS noise, stddev_pop(value) AS signal FROM st GROUP BY plant, unit, tag),
    jm AS (SELECT plant, unit, tag, count(*) FILTER (abs(d) > 5 * noise) AS j FROM st JOIN nz USING (plant, unit, tag) GROUP BY plant, unit, tag),
    sk AS (SELECT plant, unit, tag, max(c) AS longest_same FROM (SELECT plant, unit, tag, g, count(*) AS c FROM (SELECT *, sum(CASE WHEN d IS NULL OR abs(d) >= 0.001 THEN 1 ELSE 0 END) OVER ({PART}) AS g FROM st) GROUP BY ALL) GROUP BY ALL),
    tv AS (SELECT plant, unit, tag, n, longest_same, longest_same * 100.0 / n AS stuck_rate, CASE WHEN signal > 0 THEN noise / signal ELSE 0 END AS noise_ratio, j * 100.0 / k AS jump_rate FROM nz JOIN jm USING (plant, unit, tag) JOIN sk USING (plant, unit, tag)),
    tmp AS (SELECT *, CASE WHEN stuck_rate > 30 THEN 'STUCK_SENSOR' WHEN noise_ratio > 2 THEN 'NOISY_SENSOR' WHEN jump_rate > 5 THEN 'UNSTABLE_SENSOR' ELSE 'TEMPORAL_OK' END AS verdict, CASE WHEN stuck_rate > 30 THEN 85 WHEN noise_ratio > 2 THEN 80 WHEN jump_rate > 5 THEN 75 ELSE 70 END AS confidence FROM tv WHERE n >= 10)"""


def checked(spark, sf):
    v, tag = F.col("value"), F.col("tag")
    return instruments(spark, sf).withColumn("value", F.when(tag.contains("PIA"), v - 5).when(tag.contains("XI"), F.floor(v / 300).cast("double")).otherwise(v))


@query("T32_statistical_check", "plant unit tag n:l z_outliers:l iqr_outliers:l mad_outliers:l mean_rate:d verdict confidence:l", "SELECT * FROM stat", CHECKS)
def statistical_check(spark, sf):
    return validation.statistical_check(checked(spark, sf))


@query("T33_engineering_check", "plant unit tag tag_type n:l impossible_rate:d suspicious_rate:d verdict confidence:l", "SELECT * FROM eng", CHECKS)
def engineering_check(spark, sf):
    return validation.engineering_check(checked(spark, sf))


@query("T34_temporal_check", "plant unit tag n:l longest_same:l stuck_rate:d noise_ratio:d jump_rate:d verdict confidence:l", "SELECT * FROM tmp", CHECKS)
def temporal_check(spark, sf):
    return validation.temporal_check(checked(spark, sf))


@query("T35_combined_verdict", "plant unit tag s_verdict e_verdict t_verdict verdict confidence:l", """
    SELECT plant, unit, tag, s.verdict AS s_verdict, e.verdict AS e_verdict, t.verdict AS t_verdict, CASE WHEN e.verdict = 'DATA_QUALITY_ISSUE' OR t.verdict = 'STUCK_SENSOR' THEN 'FALSE_POSITIVE' WHEN s.verdict = 'LIKELY_GENUINE' THEN 'GENUINE_ANOMALY'
             WHEN s.verdict = 'INVESTIGATE_FURTHER' OR e.verdict = 'INVESTIGATE_SENSOR' THEN 'REQUIRES_INVESTIGATION' ELSE 'LIKELY_FALSE_POSITIVE' END AS verdict,
           CASE WHEN e.verdict = 'DATA_QUALITY_ISSUE' OR t.verdict = 'STUCK_SENSOR' OR s.verdict = 'LIKELY_GENUINE' THEN greatest(s.confidence, e.confidence, t.confidence) ELSE CAST(floor((s.confidence + e.confidence + t.confidence) / 3.0) AS BIGINT) END AS confidence
    FROM stat s JOIN eng e USING (plant, unit, tag) JOIN tmp t USING (plant, unit, tag)""", CHECKS)
def combined_verdict(spark, sf):
    return validation.combined_verdict(checked(spark, sf))


@query("T36_running_only_candidates", "plant unit tag count:l", """
    SELECT plant, unit, tag, count(*) AS count FROM (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM run WINDOW w AS (PARTITION BY plant, unit, tag)) WHERE abs(z) > 2.5 GROUP BY plant, unit, tag""",
    f"""{INSTRUMENTS}, run AS (SELECT * FROM instruments i WHERE EXISTS (SELECT 1 FROM instruments s WHERE s.plant = i.plant AND s.unit = i.unit AND s.time = i.time AND s.value > 5 AND (s.tag LIKE '%SI%' OR s.tag LIKE '%FI%')))""")
def running_only(spark, sf):
    rows = speed.running_rows(instruments(spark, sf), 5)
    return detectors.candidate_counts(detectors.sigma_candidates(rows))


@query("T38_alerts", "plant unit tag priority confidence_score:d alert:b", """
    SELECT plant, unit, tag, priority, confidence_score, coalesce(priority IN ('CRITICAL', 'HIGH') AND last_24h > 0 AND confidence_score >= CASE priority WHEN 'CRITICAL' THEN 50 ELSE 60 END AND (sigma_count > 0 OR external_count > 0) AND mtd_count > 0, false) AS alert FROM verified""", VERIFIED)
def alerts(spark, sf):
    return detectors.alerts(hybrid_table(spark, sf))


@query("T39_verified_gate", "plant unit tag confidence verified:b", """
    SELECT plant, unit, tag, confidence, (sigma_count > 0 OR external_count > 0) AND mtd_count > 0 AND confidence IN ('HIGH', 'MEDIUM') AS verified FROM verified""", VERIFIED)
def verified_gate(spark, sf):
    from plantspark.functions.scoring import verified_gate as gate

    columns = [F.col(c) for c in ("sigma_count", "external_count", "mtd_count", "forest_count", "confidence")]
    return hybrid_table(spark, sf).withColumn("verified", gate(*columns))


@query("U7_confirmation_union", "plant unit tag by_limit:l by_fence:l confirmed:l", """
    SELECT plant, unit, tag, count(*) FILTER (value < lo OR value > up) AS by_limit, count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS by_fence, count(*) FILTER (value < lo OR value > up OR value > q3 + 1.5 * (q3 - q1)) AS confirmed
    FROM b25 JOIN q USING (plant, unit, tag) GROUP BY plant, unit, tag""", f"{BOUNDS}, {QUART}")
def confirmation_union(spark, sf):
    from plantspark.operators import joins

    r = readings(spark, sf)
    bounded = joins.limits_or_sigma(r, limits(spark, sf), 2.5).join(detectors.iqr_limits(r).drop("n"), list(SERIES))
    limit, fence = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), F.col("value") > F.col("iqr_high")
    return bounded.groupBy(*SERIES).agg(F.count_if(limit).alias("by_limit"), F.count_if(fence).alias("by_fence"), F.count_if(limit | fence).alias("confirmed"))


@query("U8_labelled_union", ROW + " anomaly_method", f"""
    SELECT {KEY}, CASE WHEN abs(z) > 3 THEN 'z_score' ELSE 'iqr' END AS anomaly_method FROM zs JOIN q USING (plant, unit, tag) WHERE abs(z) > 3 OR (n >= 50 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))""", f"{ZS}, {QUART}")
def labelled_union(spark, sf):
    r = readings(spark, sf)
    by_z, by_iqr = (f.select(*SERIES, "time", "value") for f in (detectors.sigma_candidates(r, 3.0), detectors.iqr_anomalies(r)))
    return dedup.union_labelled({"z_score": by_z, "iqr": by_iqr}, (*SERIES, "time", "value"))


@query("O8_plot_selection", "plant unit tag plot_score:d rank:l", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant, unit ORDER BY plot_score DESC, tag) AS rank FROM (SELECT *, (count * 10.0 + rate * 1000) * CASE confidence WHEN 'HIGH' THEN 1.5 WHEN 'MEDIUM' THEN 1.2 ELSE 1 END AS plot_score FROM verified))
    WHERE rank <= 5 AND (count >= 10 OR rate >= 0.05 OR (rank <= 2 AND count > 0))""", VERIFIED)
def plot_selection(spark, sf):
    return detectors.plot_selection(hybrid_table(spark, sf))
