"""Running state and speed compensation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.functions import scoring, tags
from plantspark.operators.aggregates import latest_values, moments
from plantspark.operators.dedup import latest_rows
from plantspark.schema import SERIES, UNIT, days, hours, ratio
from plantspark.schema import as_of as as_of_column

CONFIG = T.StructType(
    [
        T.StructField("plant", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("speed_tag", T.StringType()),
        T.StructField("primary_speed_tag", T.StringType()),
        T.StructField("secondary_speed_tag", T.StringType()),
        T.StructField("baseline_speed", T.DoubleType()),
        T.StructField("compensation_method", T.StringType()),
        T.StructField("speed_stability_threshold", T.DoubleType()),
        T.StructField("operating_range", T.ArrayType(T.DoubleType())),
    ]
)

# Fallbacks of the global settings.
DEFAULTS = {
    "enabled": True,
    "method": "rpm_normalized",
    "min_points": 10,
    "min_confidence": 0.7,
    "stability_threshold": 100.0,
}
FACTOR_RANGE = (0.1, 10.0)
SINGLE_METHODS = ("rpm_normalized", "percentage_normalized")
DUAL_METHOD = "dual_rpm_averaged"
NEAR_ZERO_RPM = 10


# -- running state ---------------------------------------------------------------------

def running_rows(df: DataFrame, threshold: float = 1.0, fallback_share: float | None = None) -> DataFrame:
    """Rows at times when any speed or flow tag of the unit is above the threshold.

    Units without such tags count as always running; ``fallback_share`` switches on the
    stricter intention: keep values above that share of the tag's own range.
    """
    sensor = df.where(tags.is_running_sensor(F.col("tag")))
    times = sensor.where(F.col("value") > threshold).select(*UNIT, "time").distinct()
    with_sensor = sensor.select(*UNIT).distinct()
    kept = df.join(times, [*UNIT, "time"], "left_semi")
    rest = df.join(with_sensor, list(UNIT), "left_anti")
    if fallback_share is not None:
        ends = rest.groupBy(*SERIES).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        span = F.col("_hi") - F.col("_lo")
        rest = rest.join(ends, list(SERIES)).where((span <= 1.0) | (F.col("value") > F.col("_lo") + fallback_share * span)).drop("_lo", "_hi")
    return kept.unionByName(rest)


def _sensor_stats(df: DataFrame, hours_back: float, last: int, as_of, tie: Sequence[str]) -> DataFrame:
    now = as_of_column(df, as_of)
    recent = df.where((F.col("time") >= now - hours(hours_back)) & tags.is_speed_sensor(F.col("tag")) & F.col("value").isNotNull())
    tail = latest_rows(recent, last, SERIES, tie).groupBy(*SERIES).agg(F.avg("value").alias("_tail"), F.count("*").alias("_k"))
    low = F.count_if(F.col("value") <= NEAR_ZERO_RPM) / F.count("*") * 100
    stats = recent.groupBy(*SERIES).agg(*moments(), low.alias("zero_percent"))
    current = F.when(F.col("_k") >= last, F.col("_tail")).otherwise(F.col("mean"))
    return stats.join(tail, list(SERIES)).withColumn("recent_speed", current).drop("_tail", "_k")


def sensor_status(df: DataFrame, hours_back: float = 2, as_of=None, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Status of every speed sensor over the last hours."""
    zero, recent, mean = F.col("zero_percent"), F.col("recent_speed"), F.col("mean")
    status = (
        F.when(zero > 80, "SHUTDOWN").when(recent <= NEAR_ZERO_RPM, "SHUTDOWN_RECENT").when(mean < 50, "LOW_SPEED").otherwise("RUNNING")
    )
    return _sensor_stats(df, hours_back, 5, as_of, tie).withColumn("status", status)


def sensor_status_detailed(df: DataFrame, hours_back: float = 2, as_of=None, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """The same with intermittent, unstable and start-up states."""
    zero, recent, mean = F.col("zero_percent"), F.col("recent_speed"), F.col("mean")
    status = (
        F.when(zero > 90, "SHUTDOWN").when(zero > 50, "INTERMITTENT").when(mean < 100, "LOW_SPEED")
        .when(F.col("std") > mean * 0.5, "UNSTABLE").when(recent < mean * 0.5, "SHUTDOWN_RECENT")
        .when((recent > mean * 1.2) & (mean < 1000), "STARTUP").otherwise("RUNNING")
    )
    return _sensor_stats(df, hours_back, 10, as_of, tie).withColumn("status", status)


# Which sensor status decides the unit's, most urgent first.
PRECEDENCE = ("SHUTDOWN", "LOW_SPEED", "RUNNING")
PRECEDENCE_DETAILED = ("SHUTDOWN", "STARTUP", "LOW_SPEED", "UNSTABLE", "INTERMITTENT", "RUNNING")


def _by_precedence(sensors: DataFrame, order: Sequence[str]) -> DataFrame:
    plain = F.when(F.col("status") == "SHUTDOWN_RECENT", "SHUTDOWN").otherwise(F.col("status"))
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), plain)
    first = sensors.groupBy(*UNIT).agg(F.min(rank).alias("_r"), F.count("*").alias("sensors"), F.avg("mean").alias("mean_speed"))
    return first.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in order]), F.col("_r").cast("int"))).drop("_r")


def unit_status(df: DataFrame, hours_back: float = 2, as_of=None, detailed: bool = False, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """One status per unit, also for units without recent data or speed sensor."""
    now = as_of_column(df, as_of)
    sensors = (sensor_status_detailed if detailed else sensor_status)(df, hours_back, as_of, tie)
    found = _by_precedence(sensors, PRECEDENCE_DETAILED if detailed else PRECEDENCE)
    ends = df.groupBy(*UNIT).agg(F.max("time").alias("_last"))
    no_data = F.col("_last") < now - hours(hours_back)
    label = F.when(no_data, "NO_RECENT_DATA").when(F.col("status").isNull(), "UNKNOWN" if detailed else "NO_SPEED_SENSOR").otherwise(F.col("status"))
    proceed = ("RUNNING", "STARTUP", "UNKNOWN") if detailed else ("RUNNING", "LOW_SPEED", "NO_SPEED_SENSOR")
    out = ends.join(found, list(UNIT), "left").withColumn("status", label)
    return out.select(*UNIT, "status", F.coalesce("sensors", F.lit(0)).alias("sensors"), "mean_speed", F.col("status").isin(*proceed).alias("proceed"))


# -- discovery -------------------------------------------------------------------------

def speed_tags(df: DataFrame) -> DataFrame:
    """Tags that look speed related, with their statistics."""
    return df.where(tags.is_broad_speed(F.col("tag"))).groupBy(*SERIES).agg(*moments())


def pure_speed_tags(df: DataFrame) -> DataFrame:
    """Pure speed tags with kind and suitability for compensation."""
    stats = df.where(tags.is_pure_speed(F.col("tag"))).groupBy(*SERIES).agg(*moments())
    fit = scoring.suitability(F.col("n"), F.col("mean"), F.col("std"), F.col("min"), F.col("max"))
    return stats.withColumn("suitability", fit).withColumn("_k", tags.speed_kind(F.col("tag"), F.col("max"))).select("*", "_k.*").drop("_k")


def proposed_config(df: DataFrame) -> DataFrame:
    """Per unit the first excellent speed tag (else the first tag) as configuration row."""
    best = F.struct((F.col("suitability") != "excellent").alias("_poor"), "tag")
    chosen = pure_speed_tags(df).groupBy(*UNIT).agg(
        F.min_by(F.struct("tag", "suitability", "mean", "min", "max"), best).alias("c"), F.count("*").alias("speed_tags")
    )
    good = F.col("c.suitability") == "excellent"
    return chosen.select(
        *UNIT, "speed_tags", F.col("c.tag").alias("primary_speed_tag"), F.when(good, "advanced").otherwise("basic").alias("compensation_type"),
        F.when(good, "high").otherwise("medium").alias("confidence"), F.when(good, F.col("c.mean")).otherwise(0.0).alias("baseline_speed"),
        F.when(good, F.coalesce(ratio(F.lit(1.0), F.col("c.mean")), F.lit(1.0))).otherwise(1.0).alias("compensation_factor"),
    )


def config_of(proposal: DataFrame) -> DataFrame:
    """Proposals as configuration rows; only an advanced one fills the required fields."""
    advanced, base = F.col("compensation_type") == "advanced", F.col("baseline_speed")
    none = F.lit(None).cast("string")
    return proposal.select(
        *UNIT, none.alias("speed_tag"), "primary_speed_tag", none.alias("secondary_speed_tag"), F.when(advanced, base).alias("baseline_speed"),
        F.when(advanced, F.array(F.lit(0.0), 2 * base)).alias("operating_range"), F.when(advanced, "rpm_normalized").alias("compensation_method"),
    )


def tag_categories(df: DataFrame) -> DataFrame:
    """Tags per unit and category."""
    named = df.select(*SERIES).distinct()
    exploded = named.select(*SERIES, F.explode(tags.categories(F.col("tag"))).alias("category"))
    return exploded.groupBy(*UNIT, "category").agg(F.array_sort(F.collect_list("tag")).alias("tags"), F.count("*").alias("n_tags"))


def monitoring_shortlist(df: DataFrame, size: int = 5) -> DataFrame:
    """Three flow controls, two valves, then performance tags, five in all."""
    sets = tag_categories(df).groupBy(*UNIT).agg(F.map_from_entries(F.collect_list(F.struct("category", "tags"))).alias("_m"))
    none = F.array().cast("array<string>")

    def first(name: str, count: int | None) -> Column:
        found = F.coalesce(F.try_element_at("_m", F.lit(name)), none)
        return F.slice(found, 1, count) if count else found

    all_tags = F.concat(first("flow_control", 3), first("control_valve", 2), first("performance", None))
    return sets.select(*UNIT, F.slice(all_tags, 1, size).alias("shortlist"))


def speed_window(speed: DataFrame, recent_days: float = 90, min_points: int = 50, by: Sequence[str] = UNIT) -> DataFrame:
    """The usual speed range: most frequent ten-rpm bin ± max(100, 3 %).

    ``bround`` rounds half to even as the bins require; equal counts take the lowest bin.
    """
    ends = speed.groupBy(*by).agg(F.max("time").alias("_end"))
    recent = speed.join(ends, list(by)).where((F.col("time") >= F.col("_end") - days(recent_days)) & F.col("value").isNotNull())
    bins = recent.groupBy(*by, F.bround(F.col("value") / 10, 0).cast("bigint").alias("_bin")).agg(F.count("*").alias("_c"))
    mode = bins.groupBy(*by).agg(F.sum("_c").alias("points"), F.max_by("_bin", F.struct("_c", -F.col("_bin"))).alias("_bin"))
    centre = F.col("_bin") * 10.0
    half = F.greatest(F.lit(100.0), centre * 0.03)
    return mode.where(F.col("points") >= min_points).select(*by, "points", centre.alias("centre"), (centre - half).alias("speed_low"), (centre + half).alias("speed_high"))


# -- compensation ----------------------------------------------------------------------

def configured_tags() -> Column:
    return F.array_compact(F.array("speed_tag", "primary_speed_tag", "secondary_speed_tag"))


def _trust(n: Column, mean: Column, std: Column, settings: dict) -> Column:
    """Fewer points, unsteady speed or a mean outside the range lower the confidence."""
    few = F.least(F.lit(1.0), n / F.lit(float(settings["min_points"])))
    steady = F.coalesce("speed_stability_threshold", F.lit(settings["stability_threshold"]))
    shaky = F.when(std > steady, steady / std).otherwise(1.0)
    low, high = F.col("operating_range")[0], F.col("operating_range")[1]
    outside = F.when(F.col("operating_range").isNotNull() & ~mean.between(low, high), 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), few * shaky * outside))


def compensation_factors(df: DataFrame, config: DataFrame, **options) -> DataFrame:
    """Factor, confidence, warnings and method for every configured unit.

    One grouped pass over the speed rows of all units; a unit is one small row after it.
    """
    settings = DEFAULTS | options
    cfg = config.withColumn("_tags", configured_tags()).withColumn("method", F.coalesce("compensation_method", F.lit(settings["method"])))
    wanted = cfg.select(*UNIT, F.posexplode("_tags").alias("_i", "tag"))
    speed = df.where(F.col("value").isNotNull()).join(wanted, list(SERIES))
    first, second = F.when(F.col("_i") == 0, F.col("value")), F.when(F.col("_i") == 1, F.col("value"))
    stats = speed.groupBy(*UNIT).agg(
        F.count("value").alias("points"), F.avg("value").alias("speed"), F.stddev_samp("value").alias("std"),
        *[f(c).alias(f"{name}{i}") for i, c in ((1, first), (2, second)) for name, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))],
    )
    row = cfg.join(stats, list(UNIT), "left")
    base, method = F.col("baseline_speed"), F.col("method")
    dual = (method == DUAL_METHOD) & (F.size("_tags") >= 2)
    both = dual & (F.col("n1") > 0) & (F.col("n2") > 0)
    single = method.isin(*SINGLE_METHODS)
    zero = single & (F.col("speed") == 0)
    by_speed = F.coalesce(ratio(base, F.col("speed")), F.lit(1.0))
    factor = (
        F.when(single, by_speed)
        .when(both, F.coalesce(ratio(base, (F.col("m1") + F.col("m2")) / 2), F.lit(1.0)))
        .when(dual, by_speed).otherwise(1.0)
    )
    one = _trust(F.col("points"), F.col("speed"), F.col("std"), settings)
    pair = (_trust(F.col("n1"), F.col("m1"), F.col("s1"), settings) + _trust(F.col("n2"), F.col("m2"), F.col("s2"), settings)) / 2
    agree = F.when(
        (F.col("m1") != 0) & (F.col("m2") != 0),
        F.greatest(F.lit(0.5), 1.0 - F.abs(F.col("m1") - F.col("m2")) / F.greatest("m1", "m2")),
    ).otherwise(0.5)
    trust = F.when(zero, 0.0).when(single, one).when(both, pair * agree).when(dual, 0.5).otherwise(0.0)
    has_speed = F.coalesce(F.col("points"), F.lit(0)) > 0
    enabled = F.lit(bool(settings["enabled"]))
    usable = enabled & has_speed
    low, high = FACTOR_RANGE
    raw = row.withColumns(
        {
            "_factor": F.when(usable, factor).otherwise(1.0),
            "_trust": F.when(usable, trust).otherwise(0.0),
            "_zero": usable & zero,
            "_lonely": usable & dual & ~both,
            "_short": usable & (method == DUAL_METHOD) & ~dual,
            "_unknown": usable & ~single & (method != DUAL_METHOD),
            "_usable": usable,
        }
    )
    extreme = F.col("_usable") & ~F.col("_factor").between(low, high)
    confidence = F.when(extreme, F.col("_trust") * 0.5).otherwise(F.col("_trust"))
    judged = raw.withColumn("_extreme", extreme).withColumn("confidence", confidence)
    unsure = F.col("_usable") & (F.col("confidence") < settings["min_confidence"])
    applied = F.col("_usable") & ~unsure & ~F.col("_extreme")
    warnings = F.array_compact(
        F.array(
            F.when(~enabled, "speed_awareness_disabled"), F.when(enabled & ~has_speed, "no_speed_data"), F.when(F.col("_zero"), "zero_speed"),
            F.when(F.col("_lonely"), "incomplete_dual_speed"), F.when(F.col("_short"), "insufficient_speed_tags"), F.when(F.col("_unknown"), "unknown_method"),
            F.when(F.col("_extreme"), "extreme_factor"), F.when(unsure, "low_confidence"), F.when(F.col("_usable") & ~applied, "not_applied"),
        )
    )
    return judged.select(
        *UNIT, F.col("_tags").alias("speed_tags"), F.coalesce("points", F.lit(0)).alias("speed_points"), "speed", F.col("std").alias("speed_std"),
        F.col("_factor").alias("raw_factor"), "confidence", applied.alias("applied"), F.when(applied, F.col("_factor")).otherwise(1.0).alias("factor"),
        F.when(applied, F.col("method")).otherwise("none").alias("method"), warnings.alias("warnings"), "baseline_speed",
    )


def compensate(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Values of the non-speed tags scaled by their unit's factor where it applies."""
    joined = df.join(factors.select(*UNIT, "speed_tags", "applied", "factor"), list(UNIT), "left")
    scale = F.coalesce(F.col("applied") & ~F.array_contains("speed_tags", F.col("tag")), F.lit(False))
    return joined.select(
        *[c for c in df.columns if c != "value"], F.when(scale, F.col("value") * F.col("factor")).otherwise(F.col("value")).alias("value"),
        scale.alias("compensated"), F.when(scale, F.col("factor")).alias("compensation_factor"),
    )


def compensation_summary(df: DataFrame, factors: DataFrame) -> DataFrame:
    """One report row per configured unit."""
    others = df.select(*SERIES).distinct().join(factors.select(*UNIT, "speed_tags"), list(UNIT)).where(~F.array_contains("speed_tags", F.col("tag")))
    counted = others.groupBy(*UNIT).agg(F.count("*").alias("_t"))
    return factors.join(counted, list(UNIT), "left").select(
        *UNIT, "method", "factor", "confidence", F.size("warnings").alias("warnings_count"), "speed_points", F.coalesce("_t", F.lit(0)).alias("target_tags")
    )


def segment_compensate(df: DataFrame, config: DataFrame) -> DataFrame:
    """Variant: clamped factor from the first speed tag, skipped when within 1 % of one."""
    first = config.select(*UNIT, configured_tags().alias("_tags"), "baseline_speed").withColumn("_first", F.try_element_at("_tags", F.lit(1)))
    speed = df.join(first.select(*UNIT, F.col("_first").alias("tag")), list(SERIES)).groupBy(*UNIT).agg(F.avg("value").alias("_speed"))
    low, high = FACTOR_RANGE
    factor = F.when(
        (F.col("_speed") > 0) & (F.col("baseline_speed") != 0), F.greatest(F.lit(low), F.least(F.lit(high), ratio(F.col("baseline_speed"), F.col("_speed"))))
    ).otherwise(1.0)
    units = first.join(speed, list(UNIT), "left").withColumn("_factor", factor)
    joined = df.join(units.select(*UNIT, "_tags", "_factor"), list(UNIT), "left")
    scale = F.coalesce((F.abs(F.col("_factor") - 1) >= 0.01) & ~F.array_contains("_tags", F.col("tag")), F.lit(False))
    return joined.select(
        *[c for c in df.columns if c != "value"], F.when(scale, F.col("value") * F.col("_factor")).otherwise(F.col("value")).alias("value"),
        F.coalesce("_factor", F.lit(1.0)).alias("factor"),
    )


REQUIRED = ("baseline_speed", "operating_range", "compensation_method")


def validate_config(config: DataFrame) -> DataFrame:
    """Missing required fields per unit."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return config.select(*UNIT, F.size(configured_tags()).alias("speed_tags"), missing.alias("missing"))


def config_summary(config: DataFrame) -> DataFrame:
    """Plants, units, speed tags, warnings."""
    checked = validate_config(config)
    return checked.agg(
        F.count_distinct("plant").alias("total_plants"), F.count("*").alias("total_units"), F.sum("speed_tags").alias("total_speed_tags"),
        F.sum(F.size("missing")).alias("warnings"),
    )


def speed_monitor(df: DataFrame, config: DataFrame) -> DataFrame:
    """Tags, method and latest speed of every unit."""
    wanted = config.select(*UNIT, configured_tags().alias("_tags"), F.coalesce("compensation_method", F.lit(DEFAULTS["method"])).alias("method"))
    rows = df.join(wanted.select(*UNIT, F.explode("_tags").alias("tag")), list(SERIES))
    last = latest_values(rows).withColumnRenamed("latest_value", "latest_speed")
    return wanted.join(last, list(UNIT), "left").select(*UNIT, F.size("_tags").alias("speed_tags"), "method", "latest_speed", "latest_time")

