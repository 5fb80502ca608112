"""Baseline tuning (M1 to M3): learn limits per tag from its own history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantspark.functions import scoring, tags
from plantspark.operators import joins, validation
from plantspark.operators.quantiles import distribution
from plantspark.schema import SERIES, UNIT, days, moment, ratio, valid

RELAX = 1.2
MAX_OUTLIER_PERCENT = 5.0


def tune(df: DataFrame, *, history_days: float = 90, min_points: int = 100, as_of=None) -> DataFrame:
    """M1: statistics, class and limits per series.

    Limits are the tightest of sigma, quartile and engineering limits. When more than
    five percent of the history lies outside, the first two are relaxed by 1.2; a lower
    limit is divided by it, which tightens a negative one (kept as published).
    """
    rows = valid(df).where(F.col("time") >= moment(df, as_of) - days(history_days)).select(*SERIES, "value")
    plain = {"mean": F.avg("value"), "std": F.stddev_samp("value"), "min": F.min("value"), "max": F.max("value")}
    stats, _ = distribution(rows, SERIES, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, plain)
    cv = F.coalesce(ratio(F.col("std"), F.col("mean")) * 100, F.lit(0.0))
    base = stats.where(F.col("n") >= min_points).withColumns({"cv": cv, "iqr": F.col("q3") - F.col("q1"), "tag_type": tags.tag_type(F.col("tag"))})
    base = base.withColumn("stability", scoring.stability(F.col("cv"))).withColumn("sigma", scoring.sigma_of_stability(F.col("stability")))
    limits = scoring.engineering_limits(F.col("tag_type"), F.col("min"), F.col("max"))
    fence = F.when(F.col("stability").isin("VERY_STABLE", "STABLE"), 2.0).otherwise(1.5)
    base = base.withColumns(
        {
            "_sh": F.col("mean") + F.col("sigma") * F.col("std"), "_sl": F.col("mean") - F.col("sigma") * F.col("std"),
            "_ih": F.col("q3") + fence * F.col("iqr"), "_il": F.col("q1") - fence * F.col("iqr"), **limits,
        }
    )
    base = base.withColumns({"_up": F.least("_sh", "_ih", "max_reasonable"), "_lo": F.greatest("_sl", "_il", "min_reasonable")})
    outside = (
        rows.join(base.select(*SERIES, "_up", "_lo"), list(SERIES))
        .where((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_up")))
        .groupBy(*SERIES).agg(F.count("*").alias("_out"))
    )
    joined = base.join(outside, list(SERIES), "left").withColumn("outlier_percent", F.coalesce("_out", F.lit(0)) / F.col("n") * 100)
    loose = F.col("outlier_percent") > MAX_OUTLIER_PERCENT
    upper = F.when(loose, F.least(F.col("_sh") * RELAX, F.col("_ih") * RELAX, F.col("max_reasonable"))).otherwise(F.col("_up"))
    lower = F.when(loose, F.greatest(F.col("_sl") / RELAX, F.col("_il") / RELAX, F.col("min_reasonable"))).otherwise(F.col("_lo"))
    return joined.select(
        *SERIES, "tag_type", "stability", "n", "mean", "std", "median", "q1", "q3", "iqr", "cv", upper.alias("upper_limit"), lower.alias("lower_limit"),
        F.col("sigma").alias("outlier_sigma"), "min_physical", "max_physical", "min_reasonable", "max_reasonable", "outlier_percent",
        scoring.sensitivity(F.col("stability"), F.col("outlier_percent")).alias("sensitivity"),
    )


def temporal_quality(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """M2: stuck share, noise ratio and GOOD / QUESTIONABLE per series."""
    out = validation.step_noise(df).where(F.col("n") >= min_rows)
    good = (F.col("stuck_rate") < 10) & (F.col("noise_ratio") < 1)
    return out.select(*SERIES, "longest_same", "stuck_rate", "noise_ratio", F.when(good, "GOOD").otherwise("QUESTIONABLE").alias("data_quality"))


def stability_distribution(baseline: DataFrame) -> DataFrame:
    """M3: tags per stability class and unit."""
    return baseline.groupBy(*UNIT).agg(
        F.count("*").alias("tags"), *[F.count_if(F.col("stability") == s).alias(s.lower()) for s in ("VERY_STABLE", "STABLE", "MODERATELY_STABLE", "VARIABLE")]
    )


def save(baseline: DataFrame, path: str) -> None:
    """M3: the limits as a Parquet table partitioned by plant and unit."""
    baseline.repartition("plant", "unit").write.mode("overwrite").partitionBy("plant", "unit").parquet(path)


def as_limits(baseline: DataFrame) -> DataFrame:
    """The columns the detectors read."""
    return baseline.select(*SERIES, "lower_limit", "upper_limit", "outlier_sigma", "sensitivity")


def check(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Readings outside the tuned limits."""
    joined = joins.with_stats(valid(df), stats=as_limits(baseline))
    return joined.where((F.col("value") < F.col("lower_limit")) | (F.col("value") > F.col("upper_limit")))
