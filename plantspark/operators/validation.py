"""Is a reported anomaly genuine? Three independent checks and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.functions import tags
from plantspark.operators import sequence, windows
from plantspark.operators.quantiles import CELLS, deviations, distribution
from plantspark.schema import SERIES, ratio, valid
from plantspark.session import cut_lineage

# Impossible low/high and suspicious low/high per tag type (None: unbounded).
ENGINEERING_CHECKS = {
    "TEMPERATURE": (-50.0, 1000.0, 0.0, 200.0),
    "PRESSURE": (0.0, None, None, 100.0),
    "FLOW": (0.0, None, None, 10000.0),
    "LEVEL": (0.0, 100.0, None, None),
    "SPEED": (0.0, None, None, 10000.0),
}


def _outside(value: Column, low: float | None, high: float | None) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | (value < low)
    if high is not None:
        out = out | (value > high)
    return out


def _statistics(df: DataFrame, sums: dict[str, Column] | None = None, hot: bool | None = None) -> DataFrame:
    """Per series n, mean, std, quartiles, median deviation and the three outlier counts, with further plain sums.

    Three passes over the readings, whatever is asked: sums and sketch, counts by value,
    deviations and outliers.
    """
    rows = valid(df).select(*SERIES, "value")
    plain = {"mean": F.avg("value"), "std": F.stddev_samp("value"), **(sums or {})}
    stats, slots = distribution(rows, SERIES, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, plain, cells=CELLS, hot=hot)
    v, iqr = F.col("value"), F.col("q3") - F.col("q1")
    outside = (v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr)
    return deviations(rows, SERIES, "value", stats, slots, counts={"z_outliers": F.abs(v - F.col("mean")) > 3 * F.col("std"), "iqr_outliers": outside})


def _statistical_verdict(stats: DataFrame, min_points: int) -> DataFrame:
    mean_rate = (F.col("z_outliers") + F.col("iqr_outliers") + F.col("mad_outliers")) / 3 / F.col("n") * 100
    rated = stats.where(F.col("n") >= min_points).withColumn("mean_rate", mean_rate)
    r = F.col("mean_rate")
    verdict = F.when(r < 1, "LIKELY_FALSE_POSITIVE").when(r < 5, "INVESTIGATE_FURTHER").otherwise("LIKELY_GENUINE")
    return rated.withColumn("verdict", verdict).withColumn("confidence", F.when(r < 1, 85).when(r < 5, 60).otherwise(80))


def statistical_check(df: DataFrame, min_points: int = 30) -> DataFrame:
    """Outlier rates by z, by quartile fences and by median deviation, averaged."""
    rated = _statistical_verdict(_statistics(df), min_points)
    return rated.select(*SERIES, "n", "z_outliers", "iqr_outliers", "mad_outliers", "mean_rate", "verdict", "confidence")


def _engineering_sums() -> dict[str, Column]:
    """Impossible and suspicious values for the tag's type."""
    kind, v = tags.tag_type(F.col("tag")), F.col("value")
    impossible = suspicious = F.lit(False)
    for name, (low, high, odd_low, odd_high) in ENGINEERING_CHECKS.items():
        impossible = F.when(kind == name, _outside(v, low, high)).otherwise(impossible)
        suspicious = F.when(kind == name, _outside(v, odd_low, odd_high)).otherwise(suspicious)
    return {"_impossible": F.count_if(impossible), "_suspicious": F.count_if(suspicious)}


def _engineering_verdict(sums: DataFrame) -> DataFrame:
    share = lambda c: F.col(c) / F.col("n") * 100
    out = sums.withColumns({"tag_type": tags.tag_type(F.col("tag")), "impossible_rate": share("_impossible"), "suspicious_rate": share("_suspicious")})
    bad, odd = F.col("impossible_rate") > 5, F.col("suspicious_rate") > 20
    verdict = F.when(bad, "DATA_QUALITY_ISSUE").when(odd, "INVESTIGATE_SENSOR").otherwise("ENGINEERING_OK")
    out = out.withColumn("verdict", verdict).withColumn("confidence", F.when(bad, 90).when(odd, 75).otherwise(70))
    return out.select(*SERIES, "tag_type", "n", "impossible_rate", "suspicious_rate", "verdict", "confidence")


def engineering_check(df: DataFrame) -> DataFrame:
    """Rates of impossible and suspicious values for the tag's type."""
    return _engineering_verdict(valid(df).groupBy(*SERIES).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in _engineering_sums().items()]))


def step_noise(df: DataFrame, tolerance: float = 0.001, hot: bool | None = None) -> DataFrame:
    """Longest stuck stretch in percent, noise ratio and share of large jumps.

    Two ordered passes: the second needs the noise that the first has measured.
    """
    rows = sequence.lay_out(valid(df).select(*SERIES, "time", "value"), hot=hot)
    stepped = sequence.row_frame(rows, lambda w: {"_step": F.col("value") - F.lag("value").over(w)}, before=1)
    base = cut_lineage(
        stepped.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count("_step").alias("steps"), F.stddev_pop("_step").alias("_noise"), F.stddev_pop("value").alias("_signal"))
    )
    breaks = F.col("_step").isNull() | (F.abs("_step") >= tolerance)
    # The runs are numbered on the layout of the first pass; large jumps are counted within them.
    numbered = sequence.strip(sequence.run_ids(stepped, breaks)).join(base.select(*SERIES, "_noise"), list(SERIES))
    runs = numbered.groupBy(*SERIES, "run_id").agg(F.count("*").alias("_n"), F.count_if(F.abs("_step") > 5 * F.col("_noise")).alias("_j"))
    joined = base.join(runs.groupBy(*SERIES).agg(F.max("_n").alias("longest_same"), F.sum("_j").alias("_j")), list(SERIES))
    noise = F.when(F.col("_signal") > 0, F.col("_noise") / F.col("_signal")).otherwise(0.0)
    return joined.select(
        *SERIES, "n", "longest_same", (F.col("longest_same") / F.col("n") * 100).alias("stuck_rate"), F.coalesce(noise, F.lit(0.0)).alias("noise_ratio"),
        F.coalesce(ratio(F.col("_j"), F.col("steps")) * 100, F.lit(0.0)).alias("jump_rate"),
    )


def temporal_check(df: DataFrame, min_points: int = 10, hot: bool | None = None) -> DataFrame:
    """Stuck, noisy or jumping sensors."""
    out = step_noise(df, hot=hot).where(F.col("n") >= min_points)
    stuck, noisy, jumpy = F.col("stuck_rate") > 30, F.col("noise_ratio") > 2, F.col("jump_rate") > 5
    verdict = F.when(stuck, "STUCK_SENSOR").when(noisy, "NOISY_SENSOR").when(jumpy, "UNSTABLE_SENSOR").otherwise("TEMPORAL_OK")
    return out.withColumn("verdict", verdict).withColumn("confidence", F.when(stuck, 85).when(noisy, 80).when(jumpy, 75).otherwise(70))


def combined_verdict(df: DataFrame) -> DataFrame:
    """One verdict per series from the checks that could be made.

    The first two checks come from one table of statistics, the third from one ordered pair of passes.
    """
    hot = sequence.has_hot_series(df)
    stats = _statistics(df, _engineering_sums(), hot)
    sides = {"s": _statistical_verdict(stats, 30), "e": _engineering_verdict(stats), "t": temporal_check(df, hot=hot)}
    out = df.select(*SERIES).distinct()
    for name, side in sides.items():
        out = out.join(side.select(*SERIES, F.col("verdict").alias(f"{name}_verdict"), F.col("confidence").alias(f"{name}_conf")), list(SERIES), "left")
    verdicts = F.array(*[F.col(f"{n}_verdict") for n in sides])
    confidences = F.array_compact(F.array(*[F.col(f"{n}_conf") for n in sides]))
    highest = F.array_max(confidences)
    mean = F.floor(F.aggregate(confidences, F.lit(0), lambda a, c: a + c) / F.size(confidences))

    def among(*names: str) -> Column:
        return F.coalesce(F.exists(verdicts, lambda v: v.isin(*names)), F.lit(False))

    sensor, genuine, unclear = among("DATA_QUALITY_ISSUE", "STUCK_SENSOR"), among("LIKELY_GENUINE"), among("INVESTIGATE_FURTHER", "INVESTIGATE_SENSOR")
    none = F.size(confidences) == 0
    verdict = (
        F.when(none, "VALIDATION_FAILED").when(sensor, "FALSE_POSITIVE").when(genuine, "GENUINE_ANOMALY")
        .when(unclear, "REQUIRES_INVESTIGATION").otherwise("LIKELY_FALSE_POSITIVE")
    )
    confidence = F.when(none, 0).when(sensor | genuine, highest).otherwise(mean)
    return out.select(*SERIES, "s_verdict", "e_verdict", "t_verdict", verdict.alias("verdict"), confidence.alias("confidence"))


def validate_top(df: DataFrame, anomaly_counts: DataFrame, top: int = 10) -> DataFrame:
    """T35 for the most anomalous tags of every unit, with what was reported."""
    chosen = windows.top_per_unit(anomaly_counts.where(F.col("count") > 0), "count", top).select(*SERIES, "count", "rate", "rank")
    rows = df.join(chosen.select(*SERIES), list(SERIES), "left_semi")
    return chosen.join(combined_verdict(rows), list(SERIES))
