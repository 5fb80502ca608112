"""Catalogs, summaries and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantspark.operators import sequence
from plantspark.operators.quantiles import grouped_quantiles
from plantspark.schema import SERIES, UNIT, hours_between, ratio
from plantspark.schema import as_of as as_of_column
from plantspark.schema import days, hours

SPAN = (F.min, "first_time"), (F.max, "last_time")


def _span():
    return [f("time").alias(name) for f, name in SPAN]


def tag_catalog(df: DataFrame) -> DataFrame:
    """A1: time range and rows per series."""
    return df.groupBy(*SERIES).agg(*_span(), F.count("*").alias("records"))


def unit_catalog(df: DataFrame) -> DataFrame:
    """A2: time range, rows and tags per unit, from the small tag catalog."""
    return tag_catalog(df).groupBy(*UNIT).agg(
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        F.sum("records").alias("records"), F.count("*").alias("tags"),
    )


def moments(value: str = "value"):
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]


def tag_summary(df: DataFrame, by: Sequence[str] = ("tag",)) -> DataFrame:
    """A3: count, moments, extremes and time range per tag."""
    return df.groupBy(*by).agg(*moments(), *_span())


def database_status(df: DataFrame) -> DataFrame:
    """A4: totals over everything, by way of the tag catalog (no distinct over fact rows)."""
    return tag_catalog(df).agg(
        F.sum("records").alias("records"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        F.count_distinct("tag").alias("tags"), F.count_distinct("plant").alias("plants"), F.count_distinct("unit").alias("units"),
    )


def recent_activity(df: DataFrame, *, hours_back: float = 24, top: int = 10, as_of=None) -> DataFrame:
    """A5: tags with data in the last hours, latest first, a top-k report."""
    recent = df.where(F.col("time") >= as_of_column(df, as_of) - hours(hours_back))
    latest = recent.groupBy("tag").agg(F.max("time").alias("last_time"), F.count("*").alias("records"))
    return latest.orderBy(F.col("last_time").desc(), "tag").limit(top)


def latest_times(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Newest reading per key."""
    return df.groupBy(*by).agg(F.max("time").alias("last_time"))


def latest_values(df: DataFrame, by: Sequence[str] = UNIT) -> DataFrame:
    """Newest value per key: newest per series first (a hash aggregate over the rows), then
    per key over that small table; at one time the last tag by name wins."""
    per_series = df.groupBy(*SERIES).agg(F.max_by("value", "time").alias("_v"), F.max("time").alias("latest_time"))
    at = F.struct("latest_time", "tag")
    return per_series.groupBy(*by).agg(F.max_by("_v", at).alias("latest_value"), F.max("latest_time").alias("latest_time"))


def unit_analytics(df: DataFrame) -> DataFrame:
    """Records, span, moments, latest value, mean + 3 sigma and what lies above it."""
    base = df.groupBy(*UNIT).agg(
        F.count("*").alias("records"), *_span(), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ).join(latest_values(df).select(*UNIT, "latest_value"), list(UNIT))
    limits = base.withColumn("threshold", F.col("mean") + 3 * F.col("std"))
    above = (
        df.join(limits.select(*UNIT, "threshold"), list(UNIT))
        .where(F.col("value") > F.col("threshold"))
        .groupBy(*UNIT)
        .agg(F.count("*").alias("above"), F.max("time").alias("latest_above"))
    )
    out = limits.join(above, list(UNIT), "left")
    count = F.coalesce("above", F.lit(0))
    return out.select(
        *UNIT, "records", "first_time", "last_time",
        hours_between(F.col("last_time"), F.col("first_time")).alias("hours_covered"),
        "mean", "std", "min", "max", "latest_value", (F.col("max") - F.col("min")).alias("value_range"), "threshold",
        count.alias("above_count"), (count / F.col("records") * 100).alias("above_percent"), "latest_above",
    )


def most_active(df: DataFrame, top: int = 10) -> DataFrame:
    """Tags by number of readings, a top-k report."""
    return df.groupBy("tag").agg(F.count("*").alias("records")).orderBy(F.col("records").desc(), "tag").limit(top)


def unit_profile(df: DataFrame) -> DataFrame:
    """Records per tag (min, max, mean, median), value stats, nulls, duplicates."""
    from plantspark.operators.dedup import duplicate_count

    per_tag = df.groupBy(*SERIES).agg(F.count("*").alias("_n"))
    tags = per_tag.groupBy(*UNIT).agg(
        F.count("*").alias("tags"), F.min("_n").alias("tag_min"), F.max("_n").alias("tag_max"), F.avg("_n").alias("tag_mean"),
        F.median("_n").alias("tag_median"),
    )
    values = df.groupBy(*UNIT).agg(
        F.count("*").alias("records"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.avg("value").alias("value_mean"), F.stddev_samp("value").alias("value_std"),
        (F.count_if(F.col("value").isNull()) / F.count("*") * 100).alias("null_percent"),
    )
    medians = grouped_quantiles(df, UNIT, "value", {"value_median": 0.5}).drop("n")
    copies = duplicate_count(df, (*SERIES, "time"), UNIT).select(*UNIT, "duplicates")
    out = values
    for side in (tags, medians, copies):
        out = out.join(side, list(UNIT), "left")
    return out


def compare_units(df: DataFrame) -> DataFrame:
    """A10: units side by side."""
    return df.groupBy("unit").agg(
        F.count("*").alias("records"), F.count_distinct("tag").alias("tags"), *_span(),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )


def daily_counts(df: DataFrame, last_days: int = 10, as_of=None) -> DataFrame:
    """Readings per day over the last days."""
    recent = df.where(F.col("time") >= as_of_column(df, as_of) - days(last_days))
    return recent.groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("records"))


def comprehensive(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Location, spread, shape (bias-corrected) and time span per series."""
    agg = df.groupBy(*by).agg(
        *moments(), F.var_samp("value").alias("var"), F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"), *_span(),
    )
    quart = grouped_quantiles(df, by, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    n = F.col("n")
    skew = F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    kurt = ((n + 1) * F.col("_g2") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    return agg.join(quart, list(by)).select(
        *by, "n", "mean", "median", "std", "var", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), skew.alias("skew"), kurt.alias("kurtosis"),
        (hours_between(F.col("last_time"), F.col("first_time")) / 24).alias("span_days"),
    )


def pivot_by_tag(df: DataFrame, tags: Sequence[str], by: Sequence[str] = (*UNIT, "time")) -> DataFrame:
    """One row per time, one mean per listed tag (the list bounds the width)."""
    return df.groupBy(*by).pivot("tag", list(tags)).agg(F.avg("value"))


def bucket(width_minutes: int):
    """Start of the time bucket, epoch aligned."""
    width = width_minutes * 60_000_000
    return F.timestamp_micros(F.floor(F.unix_micros("time") / width) * width)


def resample(df: DataFrame, minutes: int = 10, by: Sequence[str] = SERIES) -> DataFrame:
    """Mean per time bucket; empty buckets are absent."""
    return df.groupBy(*by, bucket(minutes).alias("bucket")).agg(F.avg("value").alias("value"))


def resample_runs(df: DataFrame, minutes: int = 10, by: Sequence[str] = SERIES) -> DataFrame:
    """A14 filled forward as runs: each mean, its first bucket, and the ``buckets`` it stands for until the next one.

    Rows grow with the readings, however long the gaps are.
    """
    means = resample(df, minutes, by).withColumnRenamed("bucket", "time")
    micros = minutes * 60_000_000
    following = sequence.row_frame(means, lambda w: {"_next": F.lead("time").over(w)}, after=1, keys=by)
    buckets = F.coalesce((F.unix_micros("_next") - F.unix_micros("time")) / micros, F.lit(1)).cast("long")
    return sequence.strip(following).select(*by, F.col("time").alias("bucket"), buckets.alias("buckets"), "value")


def expanded(runs: DataFrame, minutes: int, time: str = "time") -> DataFrame:
    """One row per bucket of runs with ``buckets``; only for a result that is wanted in this form."""
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    rest = [c for c in runs.columns if c not in (time, "buckets")]
    every = F.sequence(F.col(time), F.col(time) + (F.col("buckets") - 1) * step, step)
    return runs.select(*rest, F.explode(every).alias(time)).select(*[c for c in runs.columns if c != "buckets"])


def resample_filled(df: DataFrame, minutes: int = 10, by: Sequence[str] = SERIES) -> DataFrame:
    """A14 with every bucket from first to last, empty ones filled forward: the runs written out."""
    return expanded(resample_runs(df, minutes, by), minutes, "bucket").select(*by, "bucket", "value")


def value_frequencies(df: DataFrame, by: Sequence[str] = SERIES, most: int = 10) -> DataFrame:
    """Value counts with percent for series of at most ``most`` distinct values."""
    counts = df.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count("*").alias("count"))
    few = counts.groupBy(*by).agg(F.count("*").alias("_d"), F.sum("count").alias("_n")).where(F.col("_d") <= most)
    return counts.join(few, list(by)).select(*by, "value", "count", (F.col("count") / F.col("_n") * 100).alias("percent"))


def update_metadata(df: DataFrame) -> DataFrame:
    """Per series last update and record count."""
    return df.groupBy(*SERIES).agg(F.max("time").alias("last_update"), F.count("*").alias("record_count"))


def merge_metadata(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new metadata merged; the later update and the summed counts stay."""
    renamed = new.select(*SERIES, F.col("last_update").alias("_u"), F.col("record_count").alias("_c"))
    return stored.join(renamed, list(SERIES), "full").select(
        *SERIES, F.greatest("last_update", "_u").alias("last_update"),
        (F.coalesce("record_count", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("record_count"),
    )


def scan_summary(df: DataFrame, units: DataFrame, max_age_hours: float = 1.0, as_of=None) -> DataFrame:
    """Fresh, stale and empty units among the known ones."""
    ages = df.groupBy("unit").agg(F.max("time").alias("last_time"))
    joined = units.join(ages, ["unit"], "left").withColumn("_age", hours_between(as_of_column(df, as_of), F.col("last_time")))
    return joined.agg(
        F.count("*").alias("total_units"), F.count_if(F.col("_age") <= max_age_hours).alias("fresh_units"),
        F.count_if(F.col("_age") > max_age_hours).alias("stale_units"), F.count_if(F.col("_age").isNull()).alias("empty_units"),
    )


def with_previous(df: DataFrame, names: Sequence[str] = ("time", "value"), keys: Sequence[str] = SERIES, order=("time",)) -> DataFrame:
    """Previous time and value of the same series."""
    return sequence.row_frame(df, lambda w: {f"prev_{c}": F.lag(c).over(w) for c in names}, before=1, keys=keys, order=order)


def interval_stats(df: DataFrame) -> DataFrame:
    """Average interval and largest gap per series, in hours."""
    gap = hours_between(F.col("time"), F.col("prev_time"))
    return with_previous(df, ("time",)).groupBy(*SERIES).agg(F.avg(gap).alias("mean_interval_hours"), F.max(gap).alias("largest_gap_hours"))


def percent(part, whole):
    return F.coalesce(ratio(part, whole) * 100.0, F.lit(0.0))
