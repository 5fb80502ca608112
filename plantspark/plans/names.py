"""Name, time and scoring expressions over real columns (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.functions import scoring, tags, times
from plantspark.plans.inputs import INSTRUMENTS, READINGS, SHIPMENTS, instruments, readings, shipments, table
from plantspark.plans.registry import query
from plantspark.schema import SERIES, hours_between
from plantspark.sources import readers


@query("X1_slug", "url slug", r"""
    SELECT url, regexp_replace(regexp_replace(trim(url), '\s+', '_', 'g'), '[^A-Za-z0-9_\-]', '_', 'g') AS slug FROM pages""")
def slug(spark, sf):
    return table(spark, sf, "pages").select("url", tags.slug(F.col("url")).alias("slug"))


@query("X2_slug_variants", "url lower_slug dot_slug",
    "SELECT url, translate(lower(url), '.-', '__') AS lower_slug, replace(url, '.', '_') AS dot_slug FROM pages")
def slug_variants(spark, sf):
    return table(spark, sf, "pages").select("url", tags.slug_lower(F.col("url")).alias("lower_slug"), tags.slug_dots(F.col("url")).alias("dot_slug"))


HEADERS = """headers AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'PLANT ' || l_returnflag || '-' || (10 + l_suppkey % 80) || '-0' || l_linenumber || '  FLOW ' || l_linestatus
    WHEN 1 THEN 'pump ' || l_returnflag || '-' || (10 + l_suppkey % 80) ELSE 'no unit here ' || l_suppkey END AS header, l_orderkey, l_linenumber FROM lineitem)"""


@query("X3_header_parts", "header plant unit tag rows:l", r"""
    SELECT header, CASE WHEN m THEN regexp_extract(header, '^([A-Za-z0-9_\-]+)\s+([A-Za-z]+-\d{2}(?:-\d{2})?)\s+(.+)$', 1) END AS plant,
           CASE WHEN m THEN regexp_extract(header, '^([A-Za-z0-9_\-]+)\s+([A-Za-z]+-\d{2}(?:-\d{2})?)\s+(.+)$', 2)
                ELSE nullif(regexp_extract(upper(header), '\b([A-Z]+-\d{2}(?:-\d{2})?)\b', 1), '') END AS unit,
           CASE WHEN m THEN trim(regexp_extract(header, '^([A-Za-z0-9_\-]+)\s+([A-Za-z]+-\d{2}(?:-\d{2})?)\s+(.+)$', 3)) ELSE header END AS tag, count(*) AS rows
    FROM (SELECT header, regexp_matches(header, '^([A-Za-z0-9_\-]+)\s+([A-Za-z]+-\d{2}(?:-\d{2})?)\s+(.+)$') AS m FROM headers) GROUP BY header, m""", HEADERS)
def header_parts(spark, sf):
    line = F.col("l_linenumber").cast("string")
    unit = F.concat("l_returnflag", F.lit("-"), (10 + F.col("l_suppkey") % 80).cast("string"))
    header = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("PLANT "), unit, F.lit("-0"), line, F.lit("  FLOW "), "l_linestatus"))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("pump "), unit))
        .otherwise(F.concat(F.lit("no unit here "), F.col("l_suppkey").cast("string")))
    )
    counted = table(spark, sf, "lineitem").groupBy(header.alias("header")).agg(F.count("*").alias("rows"))
    return counted.select("header", "rows", tags.header_parts(F.col("header")).alias("p")).select("header", "rows", "p.*")


@query("X4_tag_parts", "tag plant unit tag_id suffix", """
    SELECT tag, CASE WHEN n >= 3 THEN p[1] ELSE 'Unknown' END AS plant, CASE WHEN n >= 3 THEN p[2] ELSE 'Unknown' END AS unit,
           CASE WHEN n >= 3 THEN p[3] ELSE tag END AS tag_id, CASE WHEN n >= 4 THEN p[4] ELSE 'PV' END AS suffix FROM
      (SELECT tag, string_split(tag, '_') AS p, len(string_split(tag, '_')) AS n FROM
        (SELECT DISTINCT tag FROM instruments UNION SELECT DISTINCT unit || '_' || tag FROM shipments UNION SELECT DISTINCT unit || '_' || tag || '_TI-1' FROM shipments))""",
    f"{INSTRUMENTS}, {SHIPMENTS}")
def tag_parts(spark, sf):
    short = shipments(spark, sf).select(F.concat_ws("_", "unit", "tag").alias("tag")).distinct()
    names = instruments(spark, sf).select("tag").union(short).union(short.select(F.concat("tag", F.lit("_TI-1")))).distinct()
    return names.select("tag", tags.tag_parts(F.col("tag")).alias("p")).select("tag", "p.*")


KIND_SQL = """CASE WHEN t LIKE '%TI%' OR t LIKE '%TE%' THEN 'TEMPERATURE' WHEN t LIKE '%PI%' OR t LIKE '%PE%' OR t LIKE '%PRESS%' THEN 'PRESSURE'
    WHEN t LIKE '%FI%' OR t LIKE '%FE%' OR t LIKE '%FLOW%' THEN 'FLOW' WHEN t LIKE '%LI%' OR t LIKE '%LE%' THEN 'LEVEL'
    WHEN t LIKE '%SI%' OR t LIKE '%SPEED%' OR t LIKE '%RPM%' THEN 'SPEED' WHEN t LIKE '%XI%' OR t LIKE '%VIB%' THEN 'VIBRATION'
    WHEN t LIKE '%ZI%' OR t LIKE '%VALVE%' OR t LIKE '%POS%' THEN 'POSITION' WHEN t LIKE '%PERFORMANCE%' THEN 'PERFORMANCE' ELSE 'UNKNOWN' END"""


@query("X5_tag_type", "source tag_type rows:l", f"""
    SELECT source, {KIND_SQL} AS tag_type, count(*) AS rows FROM (SELECT source, upper(source) AS t FROM (SELECT url AS source FROM pages UNION ALL SELECT tag FROM instruments)) GROUP BY ALL""", INSTRUMENTS)
def tag_type(spark, sf):
    both = table(spark, sf, "pages").select(F.col("url").alias("source")).unionAll(instruments(spark, sf).select("tag"))
    return both.groupBy("source").agg(F.count("*").alias("rows")).select("source", tags.tag_type(F.col("source")).alias("tag_type"), "rows")


@query("X6_relative_times", "start minutes:d step:d est_rows:l", """
    SELECT start, minutes, step, greatest(2000, least(100000, CAST(floor(greatest(1, minutes) / step + 10) AS BIGINT))) AS est_rows FROM
      (SELECT DISTINCT '-' || (l_partkey % 200) || '.5' || substr('ydhm', 1 + l_linenumber % 4, 1) AS start,
         ((l_partkey % 200) + 0.5) * CASE l_linenumber % 4 WHEN 0 THEN 525600 WHEN 1 THEN 1440 WHEN 2 THEN 60 ELSE 1 END AS minutes,
         CASE WHEN l_linenumber % 2 = 0 THEN 6.0 ELSE 15.0 END AS step FROM lineitem)""")
def relative_times(spark, sf):
    start = F.concat(F.lit("-"), (F.col("l_partkey") % 200).cast("string"), F.lit(".5"), F.substring(F.lit("ydhm"), 1 + F.col("l_linenumber") % 4, F.lit(1)))
    step = F.when(F.col("l_linenumber") % 2 == 0, "-0.1h").otherwise("-15m")
    asked = table(spark, sf, "lineitem").select(start.alias("start"), step.alias("step_text")).distinct()
    now = F.lit("2024-01-31").cast("timestamp")
    return asked.select(
        "start", times.relative_minutes(F.col("start")).alias("minutes"), times.step_minutes(F.col("step_text")).alias("step"),
        times.estimated_rows(F.col("start"), F.col("step_text"), now).alias("est_rows"),
    )


@query("X7_fetch_hours", "unit tag fetch_hours:l", """
    SELECT unit, tag, least(CAST(floor(date_diff('microsecond', max(time), (SELECT max(time) FROM shipments)) / 3.6e9 * 1.1) + 1 AS BIGINT), 720) AS fetch_hours
    FROM shipments GROUP BY unit, tag""", SHIPMENTS)
def fetch_hours(spark, sf):
    s = shipments(spark, sf)
    latest = s.groupBy("unit", "tag").agg(F.max("time").alias("t"))
    now = s.select(F.max("time")).scalar()
    return latest.select("unit", "tag", times.fetch_hours(hours_between(now, F.col("t"))).alias("fetch_hours"))


@query("X8_day_numbers", "event_id:l time:t back:d", """
    SELECT event_id, make_timestamp(CAST(round((epoch_us(ts) / 86400e6 + 25569 - 25569) * 86400e6) AS BIGINT)) AS time,
           epoch_us(ts) / 86400e6 + 25569 AS back FROM events""")
def day_numbers(spark, sf):
    serial = times.to_day_number(F.col("ts").cast("timestamp"))
    raw = table(spark, sf, "events").select("event_id", serial.cast("string").alias("time"), serial.alias("back"))
    return readers.resolve_times(raw).withColumn("time", F.timestamp_micros(F.unix_micros("time")))


@query("X9_plant_of_unit", "unit plant", """
    SELECT unit, CASE WHEN unit IN ('K-12-01', 'K-16-01', 'K-19-01', 'K-31-01') THEN 'PCFS' WHEN unit IN ('C-104', 'XT-07002', 'C-201', 'C-202') THEN 'PCMSB'
           WHEN unit = '07-MT01-K001' THEN 'ABFSB' WHEN unit LIKE 'K-%' THEN 'PCFS' WHEN unit LIKE 'C-%' THEN 'PCMSB' ELSE 'UNKNOWN' END AS plant FROM
      (SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'K-' || s_suppkey WHEN 1 THEN 'C-' || s_suppkey WHEN 2 THEN 'XT-07002' WHEN 3 THEN '07-MT01-K001' ELSE 'Z' || s_suppkey END AS unit FROM supplier)""")
def plant_of_unit(spark, sf):
    key, text = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    unit = (
        F.when(key == 0, F.concat(F.lit("K-"), text)).when(key == 1, F.concat(F.lit("C-"), text))
        .when(key == 2, "XT-07002").when(key == 3, "07-MT01-K001").otherwise(F.concat(F.lit("Z"), text))
    )
    return table(spark, sf, "supplier").select(unit.alias("unit")).distinct().select("unit", tags.plant_of_unit(F.col("unit")).alias("plant"))


@query("X10_categories", "source categories", r"""
    SELECT source, coalesce(nullif(concat_ws(',', CASE WHEN regexp_matches(t, 'fi[-_]?\d+') THEN 'flow_indicator' END,
        CASE WHEN regexp_matches(t, 'ti[ac]?[-_]?\d+') THEN 'temperature' END, CASE WHEN regexp_matches(t, 'pi[-_]?\d+') THEN 'pressure' END,
        CASE WHEN regexp_matches(t, 'li[ac]?[-_]?\d+') THEN 'level' END, CASE WHEN regexp_matches(t, '[fl]v[-_]?\d+|mv') THEN 'control_valve' END,
        CASE WHEN regexp_matches(t, 'motor|drive|speed|rpm') THEN 'motor_drive' END, CASE WHEN regexp_matches(t, 'f[hic]+[-_]?\d+') THEN 'flow_control' END,
        CASE WHEN regexp_matches(t, 'xia[-_]?\d+') THEN 'analyzer' END, CASE WHEN regexp_matches(t, 'pdia|dpia') THEN 'differential_pressure' END,
        CASE WHEN regexp_matches(t, 'margin|performance') THEN 'performance' END), ''), 'unknown') AS categories
    FROM (SELECT source, lower(source) AS t FROM (SELECT DISTINCT tag AS source FROM instruments UNION SELECT DISTINCT url FROM pages))""", INSTRUMENTS)
def categories(spark, sf):
    names = instruments(spark, sf).select(F.col("tag").alias("source")).union(table(spark, sf, "pages").select("url")).distinct()
    return names.select("source", F.array_join(tags.categories(F.col("source")), ",").alias("categories"))


@query("X11_speed_names", "doc_id:l pure:b broad:b", """
    SELECT doc_id, regexp_matches(t, 'speed|rpm|freq|hz|rps|vfd|rotation|velocity') AS pure,
           regexp_matches(t, 'speed|rpm|velocity|rate|flow|freq|hz|rps|rotation|spin|motor|drive|pump|compressor|turbine|fan|agitator|mixer|stirrer') AS broad
    FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def speed_names(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tags.is_pure_speed(text).alias("pure"), tags.is_broad_speed(text).alias("broad"))


KINDS = f"{SHIPMENTS}, peaks AS (SELECT unit, CASE tag WHEN 'AF' THEN 'main_RPM' WHEN 'RF' THEN 'drive_Hz' WHEN 'NO' THEN 'pump' WHEN 'NF' THEN 'turbine' WHEN 'AO' THEN 'compressor' ELSE 'x' END AS name, max(value) / 100 AS top FROM shipments GROUP BY ALL)"


@query("X12_speed_kind", "unit name speed_type units_likely machine_class", """
    SELECT unit, name, CASE name WHEN 'main_RPM' THEN 'motor_rpm' WHEN 'drive_Hz' THEN 'drive_frequency' WHEN 'pump' THEN 'pump_speed' WHEN 'turbine' THEN 'turbine_speed'
             WHEN 'compressor' THEN 'compressor_speed' ELSE 'unknown' END AS speed_type,
           CASE WHEN name IN ('main_RPM', 'turbine') THEN 'RPM' WHEN name = 'drive_Hz' THEN 'Hz' WHEN name = 'x' THEN 'unknown' WHEN top > 100 THEN 'RPM' ELSE 'Hz' END AS units_likely,
           CASE name WHEN 'main_RPM' THEN CASE WHEN top > 1000 THEN 'high_speed_motor' ELSE 'low_speed_motor' END
             WHEN 'drive_Hz' THEN CASE WHEN top <= 100 THEN 'variable_frequency_drive' ELSE 'high_frequency_drive' END END AS machine_class FROM peaks""", KINDS)
def speed_kind(spark, sf):
    name = F.lit("x")
    for tag, text in {"AF": "main_RPM", "RF": "drive_Hz", "NO": "pump", "NF": "turbine", "AO": "compressor"}.items():
        name = F.when(F.col("tag") == tag, text).otherwise(name)
    peaks = shipments(spark, sf).groupBy("unit", name.alias("name")).agg((F.max("value") / 100).alias("top"))
    return peaks.select("unit", "name", tags.speed_kind(F.col("name"), F.col("top")).alias("k")).select("unit", "name", "k.*")


@query("X13_suitability", "unit tag n:l cv:d suitability", """
    SELECT unit, tag, n, sd / nullif(m, 0) AS cv, CASE WHEN n < 10 THEN 'insufficient_data' WHEN m = 0 OR sd / m > 2 THEN 'high_variability' WHEN sd / m < 0.05 THEN 'low_variability'
           WHEN lo < 0 THEN 'invalid_range' WHEN hi = 0 THEN 'zero_speed' ELSE 'excellent' END AS suitability FROM
      (SELECT unit, tag, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM (SELECT unit, tag, value - 2000 AS v FROM shipments) GROUP BY unit, tag)""", SHIPMENTS)
def suitability(spark, sf):
    s = shipments(spark, sf).withColumn("value", F.col("value") - 2000)
    stats = s.groupBy("unit", "tag").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    label = scoring.suitability(*[F.col(c) for c in ("n", "m", "sd", "lo", "hi")])
    return stats.select("unit", "tag", "n", (F.col("sd") / F.col("m")).alias("cv"), label.alias("suitability"))


@query("X14_staleness", "unit tag age_hours:d coarse fine severity gap", """
    SELECT unit, tag, a AS age_hours, CASE WHEN a <= 24 THEN 'FRESH' WHEN a <= 48 THEN 'MILDLY_STALE' WHEN a <= 168 THEN 'STALE' ELSE 'SEVERELY_STALE' END AS coarse,
           CASE WHEN a <= 1 THEN 'FRESH' WHEN a <= 6 THEN 'MILDLY_STALE' WHEN a <= 24 THEN 'STALE' WHEN a <= 168 THEN 'VERY_STALE' ELSE 'EXTREMELY_STALE' END AS fine,
           CASE WHEN a <= 1 THEN 'none' WHEN a <= 6 THEN 'low' WHEN a <= 24 THEN 'medium' WHEN a <= 168 THEN 'high' ELSE 'critical' END AS severity,
           CASE WHEN a > 24 THEN 'SHUTDOWN' WHEN a > 4 THEN 'DATA_INTERRUPTION' ELSE 'MINOR' END AS gap
    FROM (SELECT unit, tag, date_diff('microsecond', time, (SELECT max(time) FROM readings)) / 3.6e9 AS a FROM readings)""", READINGS)
def staleness(spark, sf):
    """X14, X15 and X26 over the age of every reading."""
    r = readings(spark, sf)
    age = hours_between(r.select(F.max("time")).scalar(), F.col("time"))
    a = F.col("age_hours")
    return r.select("unit", "tag", age.alias("age_hours")).select(
        "unit", "tag", "age_hours", scoring.staleness(a).alias("coarse"), scoring.fine_staleness(a).alias("fine"),
        scoring.fine_severity(a).alias("severity"), scoring.gap_diagnosis(a).alias("gap"),
    )


SCORED = f"""{READINGS}, ages AS (SELECT plant, unit, tag, value, date_diff('microsecond', time, (SELECT max(time) FROM readings)) / 3.6e9 AS a FROM readings),
    scored AS (SELECT plant, unit, tag, sum(exp(-ln(2) / 7 * greatest(0, a / 24))) FILTER (value > 130) AS weighted, count(*) FILTER (value > 130 AND a <= 24) AS last_24h,
      count(*) FILTER (value > 130 AND a > 24 AND a <= 168) AS last_7d, count(*) FILTER (value > 130 AND a > 168 AND a <= 720) AS last_30d, count(*) FILTER (value > 130 AND a > 720) AS older
      FROM ages GROUP BY plant, unit, tag)"""


@query("X16_recency_priority", "plant unit tag weighted:d last_24h:l last_7d:l last_30d:l older:l priority", """
    SELECT *, CASE WHEN last_24h > 0 THEN 'CRITICAL' WHEN last_7d > 5 OR weighted > 10 THEN 'HIGH' WHEN last_30d > 10 OR weighted > 5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM scored""", SCORED)
def recency_priority(spark, sf):
    """Decayed weight, exclusive age buckets, priority."""
    r = readings(spark, sf)
    age = hours_between(r.select(F.max("time")).scalar(), F.col("time"))
    hit, a = F.col("value") > 130, F.col("a")
    out = r.withColumn("a", age).groupBy(*SERIES).agg(
        F.sum(F.when(hit, scoring.decayed(a / 24))).alias("weighted"), *[c.alias(n) for n, c in scoring.recency_counts(a, hit).items()]
    )
    return out.withColumn("priority", scoring.priority(*[F.col(c) for c in ("last_24h", "last_7d", "last_30d", "weighted")]))


COUNTS = f"""{SHIPMENTS}, counts AS (SELECT unit, count(*) FILTER (value > 100000) AS s, count(*) FILTER (value > 95000 AND tag = 'AF') AS a,
    count(*) FILTER (value > 103000) AS m, count(*) FILTER (value > 104000) AS f, count(*) FILTER (year(time) = 2001) AS r FROM shipments GROUP BY unit)"""


def hit_counts(spark, sf):
    v = F.col("value")
    return shipments(spark, sf).groupBy("unit").agg(
        F.count_if(v > 100000).alias("s"), F.count_if((v > 95000) & (F.col("tag") == "AF")).alias("a"),
        F.count_if(v > 103000).alias("m"), F.count_if(v > 104000).alias("f"), F.count_if(F.year("time") == 2001).alias("r"),
    )


@query("X19_confidence", "unit s:l a:l m:l f:l score:d level", """
    SELECT *, CASE WHEN score >= 80 THEN 'VERY_HIGH' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM
      (SELECT *, least(40.0, s * 4) + least(30.0, a * 3) + least(20.0, m * 2) + least(10.0, f * 1) AS score FROM counts)""", COUNTS)
def confidence(spark, sf):
    c = hit_counts(spark, sf).withColumn("score", scoring.confidence_score(*[F.col(x) for x in "samf"]))
    return c.withColumn("level", scoring.confidence_level(F.col("score")))


@query("X20_dynamic_confidence", "unit score:l level", """
    SELECT unit, score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM
      (SELECT unit, least(100, greatest(20, CAST(floor(20 + least(35, a * 2.5) + least(30, m * 3) + least(15, s / 2.0)) AS BIGINT))) AS score FROM counts)""", COUNTS)
def dynamic_confidence(spark, sf):
    score = scoring.dynamic_confidence(F.col("a"), F.col("m"), F.col("s") / 200)
    c = hit_counts(spark, sf).select("unit", score.alias("score"))
    return c.withColumn("level", scoring.dynamic_level(F.col("score")))


@query("X21_deviation_percent", "unit tag time:t deviation:d", """
    SELECT unit, tag, time, least(300, coalesce(abs((value - m) / nullif(m, 0)) * 100, 0)) AS deviation FROM (SELECT *, avg(value) OVER (PARTITION BY unit, tag) AS m FROM readings)""", READINGS)
def deviation(spark, sf):
    r = readings(spark, sf)
    means = r.groupBy("unit", "tag").agg(F.avg("value").alias("m"))
    return r.join(means, ["unit", "tag"]).select("unit", "tag", "time", scoring.deviation_percent(F.col("value"), F.col("m")).alias("deviation"))


@query("X22_engineering_limits", "unit kind min_physical:d max_physical:d min_reasonable:d max_reasonable:d", """
    SELECT unit, kind, CASE kind WHEN 'TEMPERATURE' THEN -273 WHEN 'UNKNOWN' THEN NULL ELSE 0 END AS min_physical,
           CASE kind WHEN 'TEMPERATURE' THEN 2000 WHEN 'PRESSURE' THEN 1000 WHEN 'FLOW' THEN 50000 WHEN 'LEVEL' THEN 100 WHEN 'SPEED' THEN 20000 END AS max_physical,
           CASE kind WHEN 'TEMPERATURE' THEN greatest(-50, lo - r * 0.5) WHEN 'PRESSURE' THEN greatest(0, lo - r * 0.3) WHEN 'FLOW' THEN greatest(0, lo - r * 0.2)
             WHEN 'LEVEL' THEN greatest(0, lo - 5) WHEN 'SPEED' THEN greatest(0, lo - r * 0.3) ELSE lo - r * 0.5 END AS min_reasonable,
           CASE kind WHEN 'TEMPERATURE' THEN least(500, hi + r * 0.5) WHEN 'PRESSURE' THEN least(200, hi + r * 0.5) WHEN 'FLOW' THEN hi + r * 0.8
             WHEN 'LEVEL' THEN least(100, hi + 5) WHEN 'SPEED' THEN hi + r * 0.5 ELSE hi + r * 0.5 END AS max_reasonable FROM
      (SELECT unit, CASE tag WHEN 'AF' THEN 'TEMPERATURE' WHEN 'RF' THEN 'PRESSURE' WHEN 'NO' THEN 'FLOW' WHEN 'NF' THEN 'LEVEL' WHEN 'AO' THEN 'SPEED' ELSE 'UNKNOWN' END AS kind,
              min(value) / 500 AS lo, max(value) / 500 AS hi, max(value) / 500 - min(value) / 500 AS r FROM shipments GROUP BY ALL)""", SHIPMENTS)
def engineering_limits(spark, sf):
    kind = F.lit("UNKNOWN")
    for tag, name in {"AF": "TEMPERATURE", "RF": "PRESSURE", "NO": "FLOW", "NF": "LEVEL", "AO": "SPEED"}.items():
        kind = F.when(F.col("tag") == tag, name).otherwise(kind)
    ends = shipments(spark, sf).groupBy("unit", kind.alias("kind")).agg((F.min("value") / 500).alias("lo"), (F.max("value") / 500).alias("hi"))
    limits = scoring.engineering_limits(F.col("kind"), F.col("lo"), F.col("hi"))
    return ends.select("unit", "kind", *[c.alias(n) for n, c in limits.items()])


@query("X23_stability", "unit cv:d stability sigma:d sensitivity", """
    SELECT unit, cv, stability, CASE stability WHEN 'VERY_STABLE' THEN 4.0 WHEN 'STABLE' THEN 3.5 WHEN 'MODERATELY_STABLE' THEN 3.0 ELSE 2.5 END AS sigma,
           CASE WHEN stability IN ('VERY_STABLE', 'STABLE') AND o < 2 THEN 'LOW_SENSITIVITY' WHEN stability = 'MODERATELY_STABLE' AND o < 3 THEN 'MEDIUM_SENSITIVITY' ELSE 'HIGH_SENSITIVITY' END AS sensitivity FROM
      (SELECT unit, cv, o, CASE WHEN cv < 2 THEN 'VERY_STABLE' WHEN cv < 5 THEN 'STABLE' WHEN cv < 10 THEN 'MODERATELY_STABLE' ELSE 'VARIABLE' END AS stability FROM
        (SELECT unit, stddev_samp(v) / avg(v) * 100 AS cv, count(*) FILTER (value > 103000) * 100.0 / count(*) AS o FROM
          (SELECT *, value + (hash_free % 20) * 100000.0 AS v FROM (SELECT *, CAST(substr(unit, 3) AS BIGINT) AS hash_free FROM shipments)) GROUP BY unit))""", SHIPMENTS)
def stability(spark, sf):
    """X23 and X24 over units whose level (and so whose variation) differs."""
    lifted = F.col("value") + F.substring("unit", 3, 9).cast("bigint") % 20 * 100000.0
    stats = shipments(spark, sf).withColumn("v", lifted).groupBy("unit").agg(
        (F.stddev_samp("v") / F.avg("v") * 100).alias("cv"), (F.count_if(F.col("value") > 103000) * 100 / F.count("*")).alias("o")
    )
    labelled = stats.withColumn("stability", scoring.stability(F.col("cv")))
    return labelled.select("unit", "cv", "stability", scoring.sigma_of_stability(F.col("stability")).alias("sigma"), scoring.sensitivity(F.col("stability"), F.col("o")).alias("sensitivity"))


@query("X25_recommended_action", "unit kind action", """
    SELECT unit, kind, CASE WHEN s = 0 THEN 'Monitor ' || lower(kind) || ' on ' || unit || ' - no recent incidents' ELSE CASE kind
             WHEN 'Temperature Indicator' THEN 'URGENT: Check thermal conditions on ' || unit || ' - ' || s || ' temperature anomalies detected. Verify cooling/heating systems.'
             WHEN 'Speed Indicator' THEN 'URGENT: Check rotational equipment on ' || unit || ' - ' || s || ' speed anomalies. Inspect coupling, bearings, drive system.'
             ELSE 'INVESTIGATE: ' || s || ' anomalies detected on ' || unit || '. Detailed analysis required.' END END AS action FROM
      (SELECT unit, CASE WHEN r % 3 = 0 THEN 'Temperature Indicator' WHEN r % 3 = 1 THEN 'Speed Indicator' ELSE 'Process Variable' END AS kind, CASE WHEN r % 4 = 0 THEN 0 ELSE s END AS s FROM counts)""", COUNTS)
def recommended_action(spark, sf):
    kind = F.when(F.col("r") % 3 == 0, "Temperature Indicator").when(F.col("r") % 3 == 1, "Speed Indicator").otherwise("Process Variable")
    n = F.when(F.col("r") % 4 == 0, F.lit(0).cast("bigint")).otherwise(F.col("s"))
    return hit_counts(spark, sf).select("unit", kind.alias("kind"), scoring.recommended_action(kind, F.col("unit"), n).alias("action"))


@query("X27_tau_critical", "unit n:l tau:d sigma:d", """
    SELECT unit, f AS n, CASE WHEN f <= 10 THEN 1.15 WHEN f <= 50 THEN 1.4 ELSE 1.5 END AS tau,
           CASE WHEN cv > 0.2 THEN 2.2 WHEN cv < 0.05 THEN 2.7 ELSE 2.5 END AS sigma FROM (SELECT unit, f, s / 100.0 AS cv FROM counts)""", COUNTS)
def tau_critical(spark, sf):
    """X27 and X28."""
    return hit_counts(spark, sf).select(
        "unit", F.col("f").alias("n"), scoring.tau_critical(F.col("f")).alias("tau"), scoring.adaptive_sigma(F.lit(2.5), F.col("s") / 100).alias("sigma")
    )
