"""Backtests and injected faults."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantspark.functions.hashing import hash_fraction
from plantspark.operators import detectors, forest, joins
from plantspark.schema import SERIES, UNIT, moment, ratio, valid
from plantspark.schema import as_of as as_of_column


# -- periods ---------------------------------------------------------------------------

def weekly_periods(df: DataFrame, weeks: int = 4, as_of=None) -> DataFrame:
    """B1: the last weeks before ``as_of`` as a plan table."""
    end = as_of_column(df, as_of)
    numbered = df.sparkSession.range(weeks).select(F.col("id").cast("int").alias("i"))
    return numbered.select(
        F.format_string("Week_%d_back", F.col("i") + 1).alias("period"),
        (end - F.make_dt_interval((F.col("i") + 1) * 7)).alias("period_start"), (end - F.make_dt_interval(F.col("i") * 7)).alias("period_end"),
    )


def in_periods(df: DataFrame, weeks: int = 4, as_of=None) -> DataFrame:
    """Readings labelled with the week they fall into, both ends inclusive.

    The week follows from the distance to ``as_of``; a reading exactly on a border
    belongs to both weeks, so no join is needed.
    """
    end = F.unix_micros(moment(df, as_of))
    week = 7 * 86_400_000_000
    back = end - F.unix_micros("time")
    first = F.floor(back / week)
    member = F.array_compact(F.array(first, F.when((back % week == 0) & (first > 0), first - 1)))
    labelled = df.where((F.unix_micros("time") <= end) & (back <= weeks * week)).withColumn("_i", F.explode(member))
    return labelled.where(F.col("_i") < weeks).withColumn("period", F.format_string("Week_%d_back", F.col("_i") + 1)).drop("_i")


def period_methods(df: DataFrame, limits: DataFrame | None, weeks: int = 4, as_of=None) -> DataFrame:
    """B2: anomalies per week, unit and method over all tags, three rules in one pass.

    3 and 4 sigma need ten values of a tag in the week, the tuned rule five; tags without
    tuned limits fall back to four sigma. Without ``limits`` the tuned method is absent.
    """
    by = ["period", *SERIES]
    rows = in_periods(valid(df), weeks, as_of)
    stats = joins.series_stats(rows, by)
    if limits is not None:
        stats = stats.join(limits.select(*SERIES, "lower_limit", "upper_limit"), list(SERIES), "left")
    else:
        stats = stats.withColumns({"lower_limit": F.lit(None).cast("double"), "upper_limit": F.lit(None).cast("double")})
    scored = rows.join(stats, by)
    v, mean, std, n = (F.col(c) for c in ("value", "mean", "std", "n"))
    tuned_low, tuned_high = F.coalesce("lower_limit", mean - 4 * std), F.coalesce("upper_limit", mean + 4 * std)
    hits = {
        "original_3sigma": (n >= 10) & (F.abs(v - mean) > 3 * std),
        "conservative_4sigma": (n >= 10) & (F.abs(v - mean) > 4 * std),
    }
    if limits is not None:
        hits["baseline_tuned"] = (n >= 5) & ((v < tuned_low) | (v > tuned_high))
    per_tag = scored.groupBy(*by).agg(F.count("*").alias("_rows"), *[F.count_if(h).alias(m) for m, h in hits.items()])
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("hits")) for m in hits])).alias("_m")
    long = per_tag.select("period", *UNIT, "_rows", named).select("period", *UNIT, "_rows", "_m.*")
    out = long.groupBy("period", *UNIT, "method").agg(
        F.sum("_rows").alias("records"), F.sum("hits").alias("total_anomalies"), F.count_if(F.col("hits") > 0).alias("tags_with_anomalies")
    )
    return out.withColumn("anomaly_rate", F.col("total_anomalies") / F.col("records"))


def forest_on_means(df: DataFrame, weeks: int = 4, min_tags: int = 5, trees: int = 100, as_of=None) -> DataFrame:
    """A forest over the tags' mean values per week and unit."""
    means = in_periods(valid(df), weeks, as_of).groupBy("period", *SERIES).agg(F.avg("value").alias("value"))
    found = forest.outliers(means, contamination=0.1, keys=("period", *UNIT), identity=("tag",), trees=trees, min_rows=min_tags)
    return found.groupBy("period", *UNIT).agg(F.count_if("is_outlier").alias("total_anomalies"), F.count("*").alias("tags")).withColumn(
        "anomaly_rate", F.col("total_anomalies") / F.col("tags")
    )


def _steadiness(rate: Column) -> Column:
    return 1.0 / (1.0 + F.stddev_pop(rate))


def period_summary(methods: DataFrame) -> DataFrame:
    """Per week and unit how many methods ran and how far their rates agree."""
    return methods.groupBy("period", *UNIT).agg(
        F.count("*").alias("methods"), F.avg("anomaly_rate").alias("mean_rate"), _steadiness(F.col("anomaly_rate")).alias("consistency")
    )


def method_performance(methods: DataFrame) -> DataFrame:
    """Per unit and method rates over the weeks, consistency and total score."""
    r = F.col("anomaly_rate")
    stats = methods.groupBy(*UNIT, "method").agg(
        (F.avg(r) * 100).alias("avg_rate"), (F.stddev_pop(r) * 100).alias("std_rate"), (F.min(r) * 100).alias("min_rate"), (F.max(r) * 100).alias("max_rate"),
        F.avg("total_anomalies").alias("avg_anomalies"), _steadiness(r).alias("consistency"), F.count("*").alias("periods"),
    )
    few = F.greatest(F.lit(0.0), 1 - F.col("avg_rate") / 10)
    bonus = F.when(F.col("method").contains("baseline"), 0.2).otherwise(0.0)
    return stats.withColumn("score", few * 0.4 + F.col("consistency") * 0.4 + bonus)


def best_method(performance: DataFrame) -> DataFrame:
    """The method with the best score per unit and the advice that follows."""
    tuned = F.col("method") == "baseline_tuned"
    out = performance.groupBy(*UNIT).agg(
        F.max_by("method", F.struct("score", F.col("method"))).alias("best"), F.max("score").alias("score"),
        F.max(F.when(tuned, F.col("avg_rate"))).alias("_tuned"),
        F.array_sort(F.collect_set(F.when(F.col("consistency") < 0.5, F.col("method")))).alias("_shaky"),
        F.array_sort(F.collect_set(F.when(F.col("avg_rate") > 10, F.col("method")))).alias("_noisy"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("_tuned").isNull(), "generate_baseline").when(F.col("_tuned") < 2, "keep_baseline").otherwise("review_baseline"),
            F.when(F.size("_shaky") > 0, "investigate_variability"), F.when(F.size("_noisy") > 0, "high_false_positives"),
            F.lit("recalibrate_monthly"), F.lit("compare_with_operators"),
        )
    )
    return out.select(*UNIT, "best", "score", advice.alias("recommendations"))


def tuned_against_plain(df: DataFrame, limits: DataFrame, min_points: int = 10) -> DataFrame:
    """Tuned limits against plain three sigma per unit, with the reduction."""
    bounded = joins.limits_or_sigma(valid(df), limits, 4.0).where(F.col("n") >= min_points)
    v = F.col("value")
    tuned = (v < F.col("lower")) | (v > F.col("upper"))
    plain = F.abs(v - F.col("mean")) > 3 * F.col("std")
    out = bounded.groupBy(*UNIT).agg(F.count_if(plain).alias("original"), F.count_if(tuned).alias("tuned"), F.count("*").alias("records"))
    cut = F.col("original") - F.col("tuned")
    reduction = F.coalesce(ratio(cut, F.col("original")) * 100, F.lit(0.0))
    label = F.when(reduction > 50, "EXCELLENT").when(reduction > 25, "GOOD").when(reduction > 0, "MODEST").otherwise("NONE")
    return out.select(*UNIT, "records", "original", "tuned", cut.alias("fewer"), reduction.alias("reduction_percent"), label.alias("rating"))


# -- injection -------------------------------------------------------------------------

def identity_text() -> list[Column]:
    return [*[F.col(c) for c in SERIES], F.unix_micros("time").cast("string")]


#: Intervals of the hash in which the rows near the bound are counted.
INTERVALS = 4_096


def lowest(df: DataFrame, fraction: Column, wanted: Column, n: Column, by: Sequence[str]) -> DataFrame:
    """The ``wanted`` rows of every group with the lowest hash fractions.

    Only rows below a bound that holds ``wanted`` of ``n`` uniform numbers (ten standard
    deviations of margin) are looked at. They are counted by interval of the hash, the
    interval that holds the last wanted row is known from the sums, and rows are ranked
    within an interval only, so no task orders the share of a hot group.
    """
    share = wanted / n
    top = share + 10 * F.sqrt(share / n) + 20 / n
    near = df.withColumn("_u", fraction).where(F.col("_u") <= top)
    near = near.withColumn("_slot", F.least(F.floor(F.col("_u") / top * INTERVALS), F.lit(INTERVALS - 1)))
    counts = near.groupBy(*by, "_slot").agg(F.count("*").alias("_c"), F.max(wanted).alias("_wanted"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = counts.withColumn("_before", before).where((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_c")))
    edges = edges.select(*by, F.col("_slot").alias("_edge"), (F.col("_wanted") - F.col("_before")).alias("_left"))
    rank = F.row_number().over(Window.partitionBy(*by, "_slot").orderBy("_u"))
    placed = near.join(edges, list(by)).where(F.col("_slot") <= F.col("_edge")).withColumn("_rank", rank)
    return placed.where((F.col("_slot") < F.col("_edge")) | (F.col("_rank") <= F.col("_left"))).drop("_u", "_slot", "_edge", "_left", "_rank")


def injected_points(df: DataFrame, rate: float = 0.005, seed: int = 42, min_points: int = 20) -> DataFrame:
    """max(1, n · rate) readings per series moved to mean ± six sigma."""
    stats = joins.series_stats(valid(df)).where(F.col("n") >= min_points)
    scored = valid(df).select(*SERIES, "time", "value").join(stats, list(SERIES))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * rate))
    chosen = lowest(scored, hash_fraction(seed, *identity_text()), k, F.col("n"), SERIES)
    sign = F.when(hash_fraction(seed + 1, *identity_text()) < 0.5, -1.0).otherwise(1.0)
    spread = F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std"))
    return chosen.select(*SERIES, "time", (F.col("mean") + sign * 6 * spread).alias("injected"))


def inject(df: DataFrame, rate: float = 0.005, seed: int = 42, min_points: int = 20) -> DataFrame:
    """The readings with the injected ones replaced."""
    points = injected_points(df, rate, seed, min_points)
    joined = df.join(points, [*SERIES, "time"], "left")
    return joined.withColumn("value", F.coalesce("injected", "value")).withColumn("is_injected", F.col("injected").isNotNull()).drop("injected")


def default_detector(df: DataFrame) -> DataFrame:
    return detectors.candidate_counts(detectors.sigma_candidates(df))


def sensitivity(df: DataFrame, targets: DataFrame, detector: Callable[[DataFrame], DataFrame] = default_detector, *, rate: float = 0.005, seed: int = 42) -> DataFrame:
    """Recall on injected tags, false alarms on the others, before and after totals.

    ``targets``: the series to inject into.
    """
    keys = list(SERIES)
    chosen = df.join(targets.select(*keys), keys, "left_semi")
    rest = df.join(targets.select(*keys), keys, "left_anti")
    after_rows = inject(chosen, rate, seed).drop("is_injected").unionByName(rest)
    counts = joins.compare_counts(detector(df), detector(after_rows))
    every = df.select(*keys).distinct().join(targets.select(*keys).withColumn("_t", F.lit(True)), keys, "left")
    table = every.join(counts, keys, "left").select(
        *keys, F.coalesce("_t", F.lit(False)).alias("_t"), F.coalesce("raised", F.lit(False)).alias("_r"),
        F.coalesce("count_before", F.lit(0)).alias("_b"), F.coalesce("count_after", F.lit(0)).alias("_a"),
    )
    hit, alarm = F.count_if(F.col("_t") & F.col("_r")), F.count_if(~F.col("_t") & F.col("_r"))
    return table.groupBy(*UNIT).agg(
        F.count_if("_t").alias("injected_tags"), hit.alias("detected_tags"), F.coalesce(ratio(hit, F.count_if("_t")), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(alarm, F.count_if(~F.col("_t"))), F.lit(0.0)).alias("false_alarm_rate"), F.sum("_b").alias("before"), F.sum("_a").alias("after"),
    )


def breakout_backtest(df: DataFrame, speed_tag: str, ranges: DataFrame | None, *, horizon_days: int = 30, chunk_days: int = 30, **options) -> DataFrame:
    """Breakouts over the last days in chunks; flagged share of the tags per unit."""
    ends = df.groupBy(*UNIT).agg(F.min("time").alias("_first"), F.max("time").alias("_end"))
    rows = df.join(ends, list(UNIT))
    start = F.greatest(F.col("_first"), F.col("_end") - F.make_dt_interval(F.lit(horizon_days)))
    chunk = F.floor((F.unix_micros("time") - F.unix_micros(start)) / (chunk_days * 86_400_000_000)).cast("int")
    cut = rows.where((F.col("time") >= start) & (F.col("time") < F.col("_end"))).withColumn("chunk", chunk).drop("_first", "_end")
    events = detectors.breakouts(cut, speed_tag, ranges, by=(*SERIES, "chunk"), span=(*UNIT, "chunk"), **options)
    tags = cut.where(F.col("tag") != speed_tag).select(*SERIES).distinct().groupBy(*UNIT).agg(F.count("*").alias("total_tags"))
    flagged = events.groupBy(*UNIT).agg(F.count_distinct("tag").alias("_f"), F.sum("events").alias("_e"))
    out = tags.join(flagged, list(UNIT), "left").withColumn("flagged_tags", F.coalesce("_f", F.lit(0)))
    return out.select(*UNIT, "total_tags", "flagged_tags", F.coalesce("_e", F.lit(0)).alias("events"), (F.col("flagged_tags") / F.col("total_tags")).alias("flag_rate"))


# -- training sets ---------------------------------------------------------------------

def two_sigma_labels(df: DataFrame, bucket: Column | None = None) -> DataFrame:
    """A time is abnormal when any tag of the unit lies beyond two sigma of its mean."""
    means = valid(df).withColumn("time", bucket if bucket is not None else F.col("time")).groupBy(*SERIES, "time").agg(F.avg("value").alias("value"))
    scored = joins.with_stats(means)
    far = (F.col("n") > 10) & (F.abs(F.col("value") - F.col("mean")) > 2 * F.col("std"))
    return scored.groupBy(*UNIT, "time").agg(F.count("*").alias("tags"), F.coalesce(F.bool_or(far), F.lit(False)).alias("abnormal"))


def long_series(df: DataFrame, min_points: int = 100, top: int | None = None) -> DataFrame:
    """Forecasting sets: the tags (or ``top`` per unit) with more than ``min_points`` readings."""
    from plantspark.operators.windows import top_per_unit

    counts = df.groupBy(*SERIES).agg(F.count("*").alias("count")).where(F.col("count") > min_points)
    return df.join(top_per_unit(counts, "count", top).select(*SERIES, "rank"), list(SERIES))


def unit_summary(df: DataFrame) -> DataFrame:
    """Rows, values, tags and time range per unit."""
    return df.groupBy(*UNIT).agg(
        F.count("*").alias("rows"), F.count("value").alias("values"), F.count_distinct("tag").alias("tags"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


def sample_rows(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of at most ``size`` readings per unit (a sampling operator)."""
    counted = df.join(df.groupBy(*UNIT).agg(F.count("*").alias("_n")), list(UNIT))
    wanted = F.least(F.lit(size), F.col("_n"))
    return lowest(counted, hash_fraction(seed, *identity_text()), wanted, F.col("_n"), UNIT).drop("_n")
