"""Freshness, gaps, data quality and tag health (H1 to H24), and refresh planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantspark.functions import scoring, tags
from plantspark.operators import aggregates as agg
from plantspark.operators import sequence
from plantspark.operators.dedup import latest_rows
from plantspark.operators.quantiles import grouped_quantiles
from plantspark.schema import SERIES, UNIT, days, hours, hours_between, ratio
from plantspark.schema import as_of as as_of_column


def aged(df: DataFrame, by: Sequence[str], as_of=None) -> DataFrame:
    """Newest and oldest reading, count and age in hours per key."""
    now = as_of_column(df, as_of)
    spans = df.groupBy(*by).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("records"))
    return spans.withColumn("age_hours", hours_between(now, F.col("last_time")))


# -- freshness -------------------------------------------------------------------------

def tag_freshness(df: DataFrame, max_age_hours: float = 24.0, as_of=None) -> DataFrame:
    """H1: age, span, count, level and stale flag per series."""
    age = F.col("age_hours")
    return aged(df, SERIES, as_of).select(
        *SERIES, "first_time", "last_time", "records", "age_hours", (age / 24).alias("age_days"),
        (hours_between(F.col("last_time"), F.col("first_time")) / 24).alias("span_days"),
        (age > max_age_hours).alias("is_stale"), scoring.staleness(age, max_age_hours).alias("level"),
    )


def freshness_summary(df: DataFrame, max_age_hours: float = 24.0, as_of=None) -> DataFrame:
    """H1: totals and the distribution over the four levels."""
    level = F.col("level")
    return tag_freshness(df, max_age_hours, as_of).agg(
        F.count("*").alias("total_tags"), F.count_if(~F.col("is_stale")).alias("fresh_tags"),
        F.count_if("is_stale").alias("stale_tags"), (F.count_if(~F.col("is_stale")) / F.count("*") * 100).alias("fresh_percent"),
        *[F.count_if(level == name).alias(name.lower()) for name in ("FRESH", "MILDLY_STALE", "STALE", "SEVERELY_STALE")],
    )


def stale_tags(df: DataFrame, max_age_hours: float = 24.0, as_of=None) -> DataFrame:
    """H2: stale series, oldest first."""
    return tag_freshness(df, max_age_hours, as_of).where("is_stale").orderBy(F.col("age_hours").desc(), *SERIES)


def freshness_with_metadata(df: DataFrame, metadata: DataFrame, stale_hours: float = 1.0, as_of=None) -> DataFrame:
    """H3: newest reading per series beside its stored update record."""
    now = as_of_column(df, as_of)
    joined = agg.latest_times(df).join(metadata, list(SERIES), "left")
    age = hours_between(now, F.col("last_time"))
    return joined.select(*SERIES, "last_time", "last_update", "record_count", age.alias("age_hours"), (age > stale_hours).alias("is_stale"))


def fetch_decisions(wanted: DataFrame, df: DataFrame, max_age_hours: float = 1.0, as_of=None) -> DataFrame:
    """H4: per configured tag: fetch when it has no data or its data is too old."""
    now = as_of_column(df, as_of)
    joined = wanted.join(agg.latest_times(df), list(SERIES), "left")
    age = hours_between(now, F.col("last_time"))
    return joined.select(*SERIES, "last_time", age.alias("age_hours"), (age.isNull() | (age > max_age_hours)).alias("fetch"))


def scan_plan(wanted: DataFrame, df: DataFrame, max_age_hours: float = 1.0, as_of=None) -> DataFrame:
    """H5: per unit how many tags to fetch, how many are served from storage."""
    return fetch_decisions(wanted, df, max_age_hours, as_of).groupBy(*UNIT).agg(
        F.count("*").alias("tags"), F.count_if("fetch").alias("to_fetch"), F.count_if(~F.col("fetch")).alias("cached"),
        (F.count_if(~F.col("fetch")) / F.count("*")).alias("cached_rate"),
    )


def unit_fresh_by_tags(wanted: DataFrame, df: DataFrame, max_age_hours: float = 1.0, share: float = 0.5, as_of=None) -> DataFrame:
    """H6: a unit is fresh when at least half of its configured tags are."""
    now = as_of_column(df, as_of)
    named = df.where(F.col("tag").isNotNull())
    joined = wanted.join(agg.latest_times(named), list(SERIES), "left")
    fresh = F.count_if(F.col("last_time") > now - hours(max_age_hours))
    return joined.groupBy(*UNIT).agg(F.count("*").alias("tags"), fresh.alias("fresh_tags")).withColumn(
        "is_fresh", F.col("fresh_tags") / F.col("tags") >= share
    )


def tag_activity(df: DataFrame, active_days: float = 90, as_of=None) -> DataFrame:
    """H7: all tags and tags with data in the last days, per unit."""
    now = as_of_column(df, as_of)
    return agg.latest_times(df.where(F.col("tag").isNotNull())).groupBy(*UNIT).agg(
        F.count("*").alias("total_tags"), F.count_if(F.col("last_time") > now - days(active_days)).alias("active_tags")
    )


def fleet_status(df: DataFrame, warn_hours: float = 0.5, limit_hours: float = 1.0, as_of=None) -> DataFrame:
    """H8: FRESH / WARNING / CRITICAL per unit with the alert text."""
    return judged_fleet(aged(df, ("unit",), as_of), warn_hours, limit_hours)


def judged_fleet(ages: DataFrame, warn_hours: float = 0.5, limit_hours: float = 1.0) -> DataFrame:
    """H8 over a table of units that already has ``records``, ``last_time``, ``age_hours``; with their plant where it is known."""
    age = F.col("age_hours")
    status = F.when(age > limit_hours, "CRITICAL").when(age > warn_hours, "WARNING").otherwise("FRESH")
    alert = F.when(
        age > limit_hours, F.format_string(f"Data age %.1fh exceeds {limit_hours:.1f}h limit", age)
    ).when(age > warn_hours, F.format_string("Data age %.1fh approaching limit", age))
    keys = [c for c in UNIT if c in ages.columns]
    return ages.select(*keys, "records", "last_time", age, status.alias("status"), alert.alias("alert"))


def fleet_summary(status: DataFrame) -> DataFrame:
    """H8: counts per status, overall status, share of fresh units."""
    count = {name: F.count_if(F.col("status") == name) for name in ("FRESH", "WARNING", "CRITICAL")}
    overall = F.when(count["CRITICAL"] > 0, "CRITICAL").when(count["WARNING"] > 0, "WARNING").otherwise("FRESH")
    return status.agg(
        F.count("*").alias("total_units"), *[c.alias(f"{n.lower()}_units") for n, c in count.items()],
        overall.alias("overall_status"), F.coalesce(ratio(count["FRESH"], F.count("*")), F.lit(0.0)).alias("freshness_rate"),
    )


def stale_units(df: DataFrame, max_age_hours: float = 1.0, as_of=None) -> DataFrame:
    """H9: units split into stale and fresh, oldest first."""
    return aged(df, UNIT, as_of).withColumn("is_stale", F.col("age_hours") > max_age_hours).orderBy(F.col("age_hours").desc(), *UNIT)


def freshness_report(units: DataFrame, df: DataFrame, as_of=None) -> DataFrame:
    """One line per known unit, unknown ages first, then oldest first."""
    now = as_of_column(df, as_of)
    per_unit = df.groupBy("unit").agg(F.count("*").alias("records"), F.count_distinct("tag").alias("tags"), F.max("time").alias("last_time"))
    out = units.join(per_unit, ["unit"], "left").withColumn("age_hours", hours_between(now, F.col("last_time")))
    return out.orderBy(F.desc_nulls_first("age_hours"), "unit")


def unit_health(units: DataFrame, df: DataFrame, as_of=None) -> DataFrame:
    """Does the unit have data, how much, from when, and is it fresh?"""
    now = as_of_column(df, as_of)
    base = df.groupBy("unit").agg(
        F.count("*").alias("records"), F.count_distinct("tag").alias("tags"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )
    age = hours_between(now, F.col("last_time"))
    status = F.when(age.isNull(), "NO_DATA").when(age < 2, "FRESH").when(age < 24, "STALE").otherwise("VERY_STALE")
    return units.join(base, ["unit"], "left").select(
        "unit", F.col("records").isNotNull().alias("has_data"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("tags", F.lit(0)).alias("tags"), "first_time", "last_time",
        F.coalesce(F.year("first_time") == 1970, F.lit(False)).alias("epoch_dates"), age.alias("age_hours"), status.alias("status"),
    )


# -- gaps ------------------------------------------------------------------------------

def gaps(df: DataFrame, max_gap_hours: float = 1.0, points_per_hour: float = 1.0) -> DataFrame:
    """H12 + H15 + X26: gaps above the limit with the values on both sides.

    ``points_per_hour`` is 1 as published although the usual cadence is six minutes.
    """
    length = hours_between(F.col("time"), F.col("prev_time"))
    drop = F.col("prev_value") - F.col("value")
    return agg.with_previous(df).where(length > max_gap_hours).select(
        *SERIES, F.col("prev_time").alias("gap_start"), F.col("time").alias("gap_end"), length.alias("gap_hours"),
        F.floor(length * points_per_hour).alias("expected_points"), F.col("prev_value").alias("value_before"),
        F.col("value").alias("value_after"), (ratio(drop, F.col("prev_value")) * 100).alias("drop_percent"),
        scoring.gap_diagnosis(length).alias("diagnosis"),
    )


def unit_gaps(df: DataFrame, max_gap_hours: float = 1.0) -> DataFrame:
    """Tags, tags with gaps and gaps per unit, all tags in one plan."""
    found = gaps(df, max_gap_hours).groupBy(*SERIES).agg(F.count("*").alias("_g"), F.sum("gap_hours").alias("_h"))
    return agg.latest_times(df).join(found, list(SERIES), "left").groupBy(*UNIT).agg(
        F.count("*").alias("total_tags"), F.count("_g").alias("tags_with_gaps"),
        F.coalesce(F.sum("_g"), F.lit(0)).alias("total_gaps"), F.coalesce(F.sum("_h"), F.lit(0.0)).alias("gap_hours"),
    )


def fetch_preview(found: DataFrame) -> DataFrame:
    """What filling the gaps would bring, per month of the gap start."""
    return found.groupBy(F.date_format("gap_start", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("gaps"), F.sum("gap_hours").alias("hours"), F.sum("expected_points").alias("points")
    )


def tag_state(df: DataFrame) -> DataFrame:
    """Newest reading per tag and how far it lags behind its unit."""
    latest = agg.latest_times(df)
    unit = latest.groupBy(*UNIT).agg(F.max("last_time").alias("_unit"))
    return latest.join(unit, list(UNIT)).select(*SERIES, "last_time", hours_between(F.col("_unit"), F.col("last_time")).alias("behind_hours"))


def units_with_news(df: DataFrame, state: DataFrame) -> DataFrame:
    """Units whose newest reading is later than the stored state (or has none)."""
    latest = df.groupBy("unit").agg(F.max("time").alias("last_time"))
    joined = latest.join(state, ["unit"], "left")
    return joined.where(F.col("seen").isNull() | (F.col("last_time") > F.col("seen"))).drop("seen")


def backfill_windows(ends: DataFrame, total_days: int = 365, window_days: int = 30) -> DataFrame:
    """The plan of a backfill: windows of ``window_days`` back from each unit's end."""
    last = -(-total_days // window_days) - 1
    numbered = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("window_no"))
    back = F.least((F.col("window_no") + 1) * window_days, F.lit(total_days))
    return numbered.select(
        *[c for c in ends.columns if c != "end"], "window_no",
        (F.col("end") - F.make_dt_interval(back)).alias("window_start"),
        (F.col("end") - F.make_dt_interval(F.col("window_no") * window_days)).alias("window_end"),
    )


def sessions(df: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Stretches of readings at most one gap apart, by run numbers, so that a hot series is cut."""
    previous = agg.with_previous(df.select(*SERIES, "time"), ("time",))
    late = F.col("prev_time").isNull() | (F.col("time") > F.col("prev_time") + F.expr(f"INTERVAL {gap}"))
    runs = sequence.run_ids(previous, late)
    out = runs.groupBy(*SERIES, "run_id").agg(F.min("time").alias("session_start"), F.max("time").alias("last_time"), F.count("*").alias("records"))
    return out.drop("run_id")


# -- quality ---------------------------------------------------------------------------

def validate_window(df: DataFrame, start, end, max_gap_hours: float = 2.0) -> DataFrame:
    """Per series of a fetched window: late start, early end, nulls, constant, gaps."""
    start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    gap = hours_between(F.col("time"), F.col("prev_time"))
    one = agg.with_previous(df, ("time",)).groupBy(*SERIES).agg(
        F.count("*").alias("records"), F.min("time").alias("_a"), F.max("time").alias("_b"),
        F.count_if(F.col("value").isNull()).alias("null_count"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max(gap).alias("_gap"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_a") > start, "starts_late"), F.when(F.col("_b") < end, "ends_early"),
            F.when(F.col("null_count") > 0, "null_values"), F.when(F.col("_lo") == F.col("_hi"), "constant"),
            F.when(F.col("_gap") > max_gap_hours, "large_gap"),
        )
    )
    return one.select(*SERIES, "records", "null_count", F.col("_gap").alias("largest_gap_hours"), warnings.alias("warnings"))


def file_validation(raw: DataFrame, by: Sequence[str], numeric: str = "value") -> DataFrame:
    """Per file (or source) rows, nulls per column and values that are no numbers."""
    text = F.col(numeric).cast("string")
    bad = text.isNotNull() & text.try_cast("double").isNull()
    return raw.groupBy(*by).agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in raw.columns if c not in by],
        F.count_if(bad).alias("non_numeric"),
    )


def repair(df: DataFrame, default: float = 0.0) -> DataFrame:
    """Fill forward, then backward, then with a default, within each series."""
    forward = sequence.carry(df, "value", "_f")
    both = sequence.carry(forward, "value", "_b", backward=True)
    filled = F.coalesce("_f", "_b", F.lit(default))
    return sequence.strip(both.withColumn("repaired", filled).drop("_f", "_b"))


def tag_health(df: DataFrame, anomalies: DataFrame, as_of=None, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Issues per tag and HEALTHY / WARNING / CRITICAL.

    ``anomalies``: one row per series with ``rate`` (a detector's per-tag table).
    """
    now = as_of_column(df, as_of)
    base = df.groupBy(*SERIES).agg(
        F.count("*").alias("records"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.max("time").alias("last_time"),
    )
    last = latest_rows(df.where(F.col("value").isNotNull()), 50, SERIES, tie).groupBy(*SERIES).agg(F.count_distinct("value").alias("_distinct"))
    spikes = (
        df.join(base.select(*SERIES, "mean", "std"), list(SERIES))
        .where(F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std"))
        .groupBy(*SERIES).agg(F.count("*").alias("_spikes"))
    )
    joined = base.join(last, list(SERIES), "left").join(spikes, list(SERIES), "left").join(anomalies.select(*SERIES, "rate"), list(SERIES), "left")
    n = F.col("n")
    missing = (F.col("records") - n) / F.col("records") * 100
    flat = (n >= 10) & (F.col("_distinct") <= 2)
    spiky = (n >= 10) & (F.col("std") > 0) & (F.coalesce("_spikes", F.lit(0)) / F.nullif(n, F.lit(0)) > 0.05)
    rate = F.coalesce("rate", F.lit(0.0)) * 100
    age = hours_between(now, F.col("last_time"))
    issues = F.array_compact(
        F.array(
            F.when(age > 24, "data_age"), F.when(missing > 50, "missing_data"), F.when(flat, "flatline"), F.when(spiky, "spikes"),
            F.when(rate > 10, "high_anomaly_rate").when(rate > 5, "elevated_anomaly_rate"),
        )
    )
    status = (
        F.when(n == 0, "NO_DATA").when(F.size(issues) == 0, "HEALTHY")
        .when((F.size(issues) == 1) & (rate < 10), "WARNING").otherwise("CRITICAL")
    )
    wide = F.when(F.abs("mean") > 0.01, F.col("std") > F.abs("mean") * 0.3).otherwise(False)
    return joined.select(
        *SERIES, n, missing.alias("missing_percent"), age.alias("age_hours"), "mean", "std", "min", "max",
        F.coalesce(flat, F.lit(False)).alias("is_flatline"), F.coalesce(spiky, F.lit(False)).alias("has_spikes"),
        F.coalesce(wide, F.lit(False)).alias("high_variance"), rate.alias("anomaly_percent"), issues.alias("issues"), status.alias("status"),
    )


def unit_health_summary(states: DataFrame) -> DataFrame:
    """Tags per health status and the healthy share of every unit."""
    count = {s: F.count_if(F.col("status") == s) for s in ("HEALTHY", "WARNING", "CRITICAL")}
    return states.groupBy(*UNIT).agg(
        F.count("*").alias("total_tags"), *[c.alias(f"{s.lower()}_tags") for s, c in count.items()],
        (count["HEALTHY"] / F.count("*") * 100).alias("health_percent"),
    )


def investigate_tags(df: DataFrame) -> DataFrame:
    """Stuck, nearly stuck, negative pressure."""
    stats = df.groupBy(*SERIES).agg(*agg.moments(), F.count_if(F.col("value") < 0).alias("negatives"))
    cv = F.coalesce(ratio(F.col("std"), F.abs("mean")) * 100, F.lit(float("inf")))
    verdict = (
        F.when(F.col("min") == F.col("max"), "STUCK_SENSOR").when(cv < 0.01, "NEARLY_STUCK")
        .when(F.col("tag").contains("PIA") & (F.col("negatives") > F.col("n") * 0.1), "NEGATIVE_PRESSURE").otherwise("UNKNOWN_ISSUE")
    )
    return stats.select(*SERIES, "n", ratio(F.col("std"), F.abs("mean")).alias("cv"), "negatives", verdict.alias("verdict"))


def data_reality(df: DataFrame) -> DataFrame:
    """Is a reported anomaly rate plausible? Variation and IQR outliers decide."""
    quart = grouped_quantiles(df, SERIES, "value", {"q1": 0.25, "q3": 0.75}).drop("n")
    stats = df.groupBy(*SERIES).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    limits = stats.join(quart, list(SERIES))
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    out = df.join(limits, list(SERIES)).groupBy(*SERIES).agg(
        F.count_if(outside).alias("outliers"), F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean") * 100).otherwise(0.0)
    rate = F.col("outliers") / F.col("n") * 100
    label = scoring.ladder(cv, ((5, "VERY_STABLE"), (10, "STABLE")), "VARIABLE", strict=True)
    verdict = F.when((rate < 5) & (cv < 10), "FALSE_POSITIVE").otherwise("MAY_BE_GENUINE")
    return out.select(*SERIES, "n", cv.alias("cv_percent"), label.alias("stability"), "outliers", rate.alias("outlier_percent"), verdict.alias("verdict"))


def coverage(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """Configured tags found and missing, compared by slug, per unit."""
    have = df.select(*UNIT, tags.slug(F.col("tag")).alias("slug")).distinct()
    want = wanted.select(*UNIT, "tag", tags.slug(F.col("tag")).alias("slug"))
    keys = [*UNIT, "slug"]
    found = want.join(have, keys, "left_semi").withColumn("found", F.lit(True))
    missing = want.join(have, keys, "left_anti").withColumn("found", F.lit(False))
    return found.unionByName(missing)


def instrumentation(df: DataFrame, active_hours: float = 2.0, as_of=None) -> DataFrame:
    """Staleness of every unit as an instrumentation finding, with its active tags."""
    ends = aged(df, UNIT, as_of)
    recent = (
        df.join(ends.select(*UNIT, F.col("last_time").alias("_end")), list(UNIT))
        .where(F.col("time") >= F.col("_end") - hours(active_hours))
        .groupBy(*UNIT).agg(F.count_distinct("tag").alias("active_tags"), F.count("*").alias("recent_records"))
    )
    age = F.col("age_hours")
    severity = scoring.fine_severity(age)
    return ends.join(recent, list(UNIT)).select(
        *UNIT, "records", "last_time", age, scoring.fine_staleness(age).alias("level"), severity.alias("severity"),
        severity.isin("medium", "high", "critical").alias("is_anomaly"), "active_tags", "recent_records",
    )

