"""The joins the analytics need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantspark.operators import blocks
from plantspark.schema import MICROS_PER_HOUR, SERIES, UNIT


def series_stats(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Count, mean, sample std per key, one small row each (partial sums before the shuffle)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def with_stats(df: DataFrame, by: Sequence[str] = SERIES, stats: DataFrame | None = None) -> DataFrame:
    """Rows beside their series' statistics.

    No broadcast hint: Spark broadcasts the statistics when they are small; otherwise
    the adaptive skew join splits a hot series.
    """
    return df.join(stats if stats is not None else series_stats(df, by), list(by))


def z_scores(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Z by the series' mean and std; null where the std is zero or unknown."""
    return with_stats(df, by).withColumn("z", (F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))


def at_candidate_times(df: DataFrame, times: DataFrame, by: Sequence[str] = UNIT) -> DataFrame:
    """Rows of any tag whose time is a candidate time of the unit."""
    return df.join(times.select(*by, "time").distinct(), [*by, "time"], "left_semi")


def common_times(left: DataFrame, right: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """(series, time) pairs present on both sides."""
    keys = [*by, "time"]
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)


def series_limits(df: DataFrame, limits: DataFrame, sigma: float = 2.5, by: Sequence[str] = SERIES) -> DataFrame:
    """Per series n, mean, std and the configured limits, else mean ± sigma · std."""
    stats = series_stats(df, by).join(limits, [c for c in by if c in limits.columns], "left")
    reach = sigma * F.coalesce("std", F.lit(0.0))
    return stats.select(
        *by, "n", "mean", "std",
        F.coalesce("lower_limit", F.col("mean") - reach).alias("lower"),
        F.coalesce("upper_limit", F.col("mean") + reach).alias("upper"),
        F.col("upper_limit").isNotNull().alias("configured"),
    )


def limits_or_sigma(df: DataFrame, limits: DataFrame, sigma: float = 2.5, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows beside the limits of their series."""
    return df.join(series_limits(df, limits, sigma, by), list(by))


def nearest_speed(df: DataFrame, speed: DataFrame, minutes: float = 10) -> DataFrame:
    """Speed reading nearest in time (within the tolerance) beside every reading."""
    return blocks.nearest_in_time(df, speed, "speed_value", tolerance_micros=int(minutes * 60_000_000))


def speed_around(anomalies: DataFrame, speed: DataFrame, minutes: float = 30) -> DataFrame:
    """Statistics of the speed readings within ± minutes of every anomaly."""
    return blocks.around(anomalies, speed, "speed", reach_micros=int(minutes * 60_000_000))


def neighbours(df: DataFrame, anomalies: DataFrame, around_hours: float = 1.0) -> DataFrame:
    """Statistics of the same series within ± hours of every anomaly."""
    return blocks.around(anomalies, df, "near", reach_micros=int(around_hours * MICROS_PER_HOUR), keys=SERIES)


def rows_at(df: DataFrame, moments: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """The reading of each asked (series, time); asked times come from the same rows."""
    return moments.join(df, [*by, "time"])


def compare_counts(before: DataFrame, after: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Anomaly counts of two detections side by side, 0 where one has none."""
    joined = before.select(*by, F.col("count").alias("_b")).join(after.select(*by, F.col("count").alias("_a")), list(by), "full")
    b, a = F.coalesce("_b", F.lit(0)), F.coalesce("_a", F.lit(0))
    return joined.select(*by, b.alias("count_before"), a.alias("count_after"), (a > b).alias("raised"))


def clip_and_union(df: DataFrame, sigma_times: DataFrame, external: DataFrame) -> DataFrame:
    """External times inside each unit's own range, united with its sigma times.

    A unit's range is laid out in months, so the join is an equi-join on the month.
    """
    ranges = df.groupBy(*UNIT).agg(F.min("time").alias("_from"), F.max("time").alias("_to"))
    months = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.make_ym_interval(F.lit(0), F.lit(1)))
    spread = ranges.withColumn("_month", F.explode(months))
    asked = external.select("time").distinct().withColumn("_month", F.trunc("time", "month"))
    inside = asked.join(spread, "_month").where((F.col("time") >= F.col("_from")) & (F.col("time") <= F.col("_to")))
    return sigma_times.select(*UNIT, "time").union(inside.select(*UNIT, "time")).distinct()
