"""Anomaly detectors (T1 to T30, T36 to T39): every series of every unit in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.functions import scoring
from plantspark.operators import dedup, forest, joins, sequence, speed, windows
from plantspark.operators.quantiles import grouped_quantiles
from plantspark.schema import SERIES, UNIT, hours, hours_between, ratio, valid
from plantspark.schema import as_of as as_of_column
from plantspark.session import cut_lineage

IDENTITY = (*SERIES, "time")


# -- default detector ------------------------------------------------------------------

def sigma_runs(
    df: DataFrame, *, z: float = 2.5, min_run: int = 6, width_days: float = 90, min_points: int = 20, recent_hours: float = 24, gate: bool = True, as_of=None
) -> DataFrame:
    """|z| >= 2.5 against the series' own trailing 90 days, six in a row in the last day.

    ``gate=False`` returns every series with its counts, which the gate then reads.
    """
    now = as_of_column(df, as_of)
    rolled = windows.rolling_days(valid(df).select(*SERIES, "time", "value"), width_days, min_points)
    score = F.abs(F.col("value") - F.col("roll_mean")) / F.nullif(F.col("roll_std"), F.lit(0.0))
    flag = F.coalesce(score >= z, F.lit(False))
    marked = rolled.withColumn("_flag", flag).withColumn("_recent", F.col("_flag") & (F.col("time") >= now - hours(recent_hours)))
    table = sequence.run_summary(
        marked, F.col("_recent"),
        sums={"count": F.col("_flag").cast("long"), "last_24h": F.col("_recent").cast("long")},
        latest={"current_value": F.col("value"), "_base": F.col("roll_mean")},
    )
    rate = F.col("count") / F.col("rows")
    current, base = F.col("current_value"), F.coalesce("_base", "current_value")
    confidence = scoring.dynamic_confidence(F.col("last_24h"), F.col("longest_run"), rate)
    out = table.select(
        *SERIES, "rows", "count", rate.alias("rate"), "last_24h", "longest_run", (F.col("last_24h") >= 5).alias("is_anomalous_24h"),
        current, base.alias("baseline_mean"), scoring.deviation_percent(current, base).alias("deviation_percent"), confidence.alias("confidence_score"),
        scoring.dynamic_level(confidence).alias("confidence"),
    )
    return out.where(passes_run_gate(min_run)) if gate else out


def passes_run_gate(min_run: int = 6) -> Column:
    return (F.col("longest_run") >= min_run) & (F.col("last_24h") > 0)


def verified_units(table: DataFrame, min_run: int = 6) -> DataFrame:
    """Per unit tags, anomalies and verified tags of the default detector."""
    return table.groupBy(*UNIT).agg(
        F.count("*").alias("tags"), F.sum("count").alias("anomalies"), F.sum("rows").alias("records"),
        F.count_if(passes_run_gate(min_run)).alias("verified"),
    )


# -- single rules ----------------------------------------------------------------------

def drop_alerts(df: DataFrame, rows: int = 5, drop: float = 0.1) -> DataFrame:
    """Value below (1 - drop) of its rolling mean."""
    rolled = windows.rolling_mean(df, rows, 2)
    return rolled.withColumn("alert", F.coalesce(F.col("value") < (1 - drop) * F.col("roll_mean"), F.lit(False)))


def sigma_candidates(df: DataFrame, sigma: float = 2.5) -> DataFrame:
    """Rows beyond ``sigma`` of the series' own mean (strictly)."""
    return joins.z_scores(valid(df)).where(F.abs("z") > sigma)


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(*SERIES).agg(F.count("*").alias("count"), (F.count("*") / F.max("n")).alias("rate"))


def beyond(df: DataFrame, sigma: float, min_points: int) -> DataFrame:
    """Rows outside mean ± sigma · std of series with enough points."""
    scored = joins.with_stats(valid(df))
    return scored.where((F.col("n") >= min_points) & (F.abs(F.col("value") - F.col("mean")) > sigma * F.col("std")))


def fallback_four_sigma(df: DataFrame) -> DataFrame:
    """Conservative detection without any configuration."""
    return beyond(df, 4.0, 10).groupBy(*SERIES).agg(F.count("*").alias("count"), (F.count("*") / F.max("n")).alias("rate"))


def upper_spikes(df: DataFrame) -> DataFrame:
    """Readings above the unit's mean + 3 sigma."""
    scored = joins.with_stats(valid(df), UNIT)
    return scored.where(F.col("value") > F.col("mean") + 3 * F.col("std"))


def iqr_limits(df: DataFrame, factor: float = 1.5, by: Sequence[str] = SERIES) -> DataFrame:
    q = grouped_quantiles(df, by, "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*by, "n", "q1", "q3", (F.col("q1") - factor * iqr).alias("iqr_low"), (F.col("q3") + factor * iqr).alias("iqr_high"))


def iqr_anomalies(df: DataFrame, factor: float = 1.5, min_points: int = 50) -> DataFrame:
    """Readings outside the quartile fences, with the fences."""
    joined = valid(df).join(iqr_limits(df, factor).where(F.col("n") >= min_points), list(SERIES))
    return joined.where((F.col("value") < F.col("iqr_low")) | (F.col("value") > F.col("iqr_high")))


def statistical(df: DataFrame, *, adaptive: bool = False, speed_cv: DataFrame | None = None) -> DataFrame:
    """Z > 3 and quartile fences 1.5 united; 2.5 and 1.2 when the unit's speed swings."""
    scored = joins.with_stats(valid(df)).join(iqr_limits(df).select(*SERIES, "q1", "q3"), list(SERIES)).where(F.col("n") >= 10)
    swings = F.lit(False)
    if adaptive and speed_cv is not None:
        scored = scored.join(speed_cv.select(*UNIT, "speed_cv"), list(UNIT), "left")
        swings = F.coalesce(F.col("speed_cv") > 0.2, F.lit(False))
    limit, fence = F.when(swings, 2.5).otherwise(3.0), F.when(swings, 1.2).otherwise(1.5)
    score = F.abs(F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    iqr = F.col("q3") - F.col("q1")
    by_z = F.coalesce(score > limit, F.lit(False))
    by_iqr = (F.col("value") < F.col("q1") - fence * iqr) | (F.col("value") > F.col("q3") + fence * iqr)
    hits = scored.where(by_z | by_iqr)
    return hits.select(*SERIES, "time", "value", F.coalesce(score, F.lit(1.0)).alias("anomaly_score"), F.when(by_z, "z_score").otherwise("iqr").alias("anomaly_method"))


def minimal_change_stats(df: DataFrame, threshold_percent: float = 0.5) -> DataFrame:
    """Share of quiet steps and size of the changes per series."""
    c = F.col("change_percent")
    return windows.with_change(df).groupBy(*SERIES).agg(
        F.count("*").alias("total_points"), F.count_if(c < threshold_percent).alias("quiet_points"),
        (F.count_if(c < threshold_percent) / F.greatest(F.lit(1), F.count("*") - 1) * 100).alias("quiet_percent"),
        F.avg(c).alias("mean_change"), F.max(c).alias("max_change"),
    )


def stable_band(df: DataFrame, sigma: float = 2.5) -> DataFrame:
    """Mean and band of the readings left after one clipping pass."""
    first = valid(df).groupBy(*SERIES).agg(F.avg("value").alias("_m0"), F.stddev_pop("value").alias("_s0"))
    usable = F.when(F.col("_s0") > 1e-12, F.col("_s0")).otherwise(1.0)
    first = first.withColumn("_s0", usable)
    kept = valid(df).join(first, list(SERIES)).where(F.abs((F.col("value") - F.col("_m0")) / F.col("_s0")) <= sigma)
    second = kept.groupBy(*SERIES).agg(F.avg("value").alias("_m1"), F.stddev_pop("value").alias("_s1"), F.count("*").alias("_k"))
    joined = first.join(second, list(SERIES), "left")
    mean = F.coalesce("_m1", "_m0")
    std = F.when((F.col("_k") > 1) & (F.col("_s1") > 1e-12), F.col("_s1")).otherwise(F.col("_s0"))
    return joined.select(*SERIES, mean.alias("stable_mean"), std.alias("stable_std"), (mean - sigma * std).alias("band_low"), (mean + sigma * std).alias("band_high"))


def stabilised(df: DataFrame, sigma: float = 2.5) -> DataFrame:
    """Spikes against the stable band replaced by interpolation in time."""
    joined = sequence.lay_out(df).join(stable_band(df, sigma), list(SERIES))
    spike = F.abs((F.col("value") - F.col("stable_mean")) / F.col("stable_std")) > sigma
    opened = joined.withColumn("is_spike", F.coalesce(spike, F.lit(False))).withColumn("_open", F.when(~F.coalesce(spike, F.lit(False)), F.col("value")))
    return windows.interpolate(opened, "_open", "stabilised").drop("_open")


# -- tuned limits ----------------------------------------------------------------------

def tuned_limits(df: DataFrame, limits: DataFrame, min_points: int = 5) -> DataFrame:
    """Configured limits, else four sigma; severity by three sigma, one row per hit."""
    bounded = joins.limits_or_sigma(valid(df), limits, 4.0)
    out = bounded.where((F.col("n") >= min_points) & ((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))))
    severe = F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std")
    return out.withColumn("severity", F.when(severe, "HIGH").otherwise("MEDIUM"))


def tuned_counts(df: DataFrame, limits: DataFrame, min_points: int = 5) -> DataFrame:
    bounded = joins.limits_or_sigma(valid(df), limits, 4.0).where(F.col("n") >= min_points)
    hit = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return bounded.groupBy(*SERIES).agg(
        F.count_if(hit).alias("limit_count"), F.max("n").alias("n"), F.max("lower").alias("lower"), F.max("upper").alias("upper"),
        F.bool_or("configured").alias("configured"),
    )


def tuned(df: DataFrame, limits: DataFrame, contamination: float = 0.02, trees: int = 100) -> DataFrame:
    """Limit and forest counts added up per tag, with method text and confidence."""
    by_limit = tuned_counts(df, limits)
    scored = forest.outliers(valid(df).select(*SERIES, "time", "value"), contamination=contamination, trees=trees)
    by_forest = scored.groupBy(*SERIES).agg(F.count_if("is_outlier").alias("_f"))
    joined = by_limit.join(by_forest, list(SERIES), "left").withColumn("forest_count", F.coalesce("_f", F.lit(0)))
    m, i = F.col("limit_count"), F.col("forest_count")
    text = (
        F.when((m > 0) & (i > 0), F.format_string("MTD(%d) + Isolation Forest(%d)", m, i)).when(m > 0, F.format_string("MTD(%d)", m))
        .when(i > 0, F.format_string("Isolation Forest(%d)", i)).otherwise("None")
    )
    level = F.when((m > 0) & (i > 0), "VERY HIGH").when(m > 0, F.when(F.col("configured"), "HIGH").otherwise("MEDIUM")).when(i > 0, "HIGH").otherwise("N/A")
    return joined.where(m + i > 0).select(
        *SERIES, "n", m, i, (m + i).alias("count"), ((m + i) / F.col("n")).alias("rate"), text.alias("method"), level.alias("confidence"),
    )


def process_aware(df: DataFrame, limits: DataFrame, hours_back: float | None = 24, as_of=None, min_points: int = 10) -> DataFrame:
    """Tuned limits with less confidence when more than half of the hits are neighbours."""
    recent = valid(df)
    if hours_back is not None:
        recent = recent.where(F.col("time") >= as_of_column(df, as_of) - hours(hours_back))
    laid = sequence.lay_out(recent)
    bounded = laid.join(joins.series_limits(recent, limits, 4.0), list(SERIES)).where(F.col("n") >= min_points)
    hit = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    table = sequence.run_summary(
        bounded, hit, sums={"anomaly_count": hit.cast("long")},
        latest={"lower": F.col("lower"), "upper": F.col("upper"), "configured": F.col("configured")},
    )
    adjacent = F.greatest(F.lit(0), F.col("longest_run") - 1)
    confidence = (
        F.when(adjacent > F.col("anomaly_count") * 0.5, "LOW (Possible Sensor Issue)")
        .when(F.col("configured"), "HIGH (Baseline-Tuned)").otherwise("MEDIUM (Default Conservative)")
    )
    return table.select(
        *SERIES, F.col("rows").alias("n"), "anomaly_count", (F.col("anomaly_count") / F.col("rows") * 100).alias("anomaly_percent"),
        adjacent.alias("adjacent"), "lower", "upper", "configured", confidence.alias("confidence"),
    )


# -- staged verification ---------------------------------------------------------------

def speed_variation(df: DataFrame, config: DataFrame) -> DataFrame:
    """Coefficient of variation of every unit's speed readings."""
    return unit_speed(df, config).groupBy(*UNIT).agg(
        F.coalesce(ratio(F.stddev_samp("value"), F.avg("value")), F.lit(0.0)).alias("speed_cv"), F.count("*").alias("speed_points")
    )


def unit_speed(df: DataFrame, config: DataFrame) -> DataFrame:
    wanted = config.select(*UNIT, F.explode(speed.configured_tags()).alias("tag"))
    return df.join(wanted, list(SERIES)).select(*UNIT, "time", "value")


def primary_sigma(df: DataFrame, *, sigma: float = 2.5, min_points: int = 20, speed_cv: DataFrame | None = None) -> DataFrame:
    """Z beyond a threshold that follows the unit's speed variation."""
    scored = joins.z_scores(valid(df)).where(F.col("n") >= min_points)
    limit: Column = F.lit(sigma)
    if speed_cv is not None:
        scored = scored.join(speed_cv.select(*UNIT, "speed_cv"), list(UNIT), "left")
        limit = scoring.adaptive_sigma(limit, F.col("speed_cv"))
    hits = scored.withColumn("sigma_used", limit).where(F.abs("z") > F.col("sigma_used"))
    return hits.select(*SERIES, "time", "value", F.abs("z").alias("anomaly_score"), "sigma_used", "n", "mean", "std")


def tau_verified(primary: DataFrame, df: DataFrame, around_hours: float = 1.0) -> DataFrame:
    """Thompson tau against the hour on both sides, or the whole tag when that is thin."""
    near = joins.neighbours(valid(df), primary, around_hours)
    thin = F.col("near_n") < 10
    n, mean, std = (F.when(thin, F.col(w)).otherwise(F.col(s)) for w, s in (("n", "near_n"), ("mean", "near_mean"), ("std", "near_std")))
    tau = F.abs(F.col("value") - mean) / F.nullif(std, F.lit(0.0))
    critical = scoring.tau_critical(n)
    judged = near.withColumns({"tau": tau, "tau_limit": critical, "_n": n})
    return judged.where((F.col("_n") >= 3) & (F.col("tau") > F.col("tau_limit"))).drop("_n", "near_n", "near_mean", "near_std")


def with_features(df: DataFrame) -> DataFrame:
    """Value, lag, step and short rolling statistics; gaps at the start become 0."""

    def outputs(w):
        frame = w.rowsBetween(-4, 0)
        return {
            "lag1": F.lag("value").over(w), "step": F.col("value") - F.lag("value").over(w),
            "mean5": F.avg("value").over(frame), "std5": F.stddev_samp("value").over(frame),
        }

    rows = sequence.strip(sequence.row_frame(valid(df).select(*SERIES, "time", "value"), outputs, before=4))
    return rows.fillna(0.0, ["lag1", "step", "mean5", "std5"])


FEATURES = ("value", "lag1", "step", "mean5", "std5")


def forest_verified(tau: DataFrame, df: DataFrame, trees: int = 100) -> DataFrame:
    """Tau-verified anomalies a five-feature forest isolates too.

    The forest may flag at most as many rows as tau verified (ten percent at most); tags
    with fewer than ten rows pass unverified.
    """
    wanted = tau.groupBy(*SERIES).agg(F.count("*").alias("_v"), F.max("n").alias("_n"))
    small = F.col("_n") < 10
    scored = forest.forest_scores(with_features(df).join(wanted.where(~small).select(*SERIES, "_v", "_n"), list(SERIES)), FEATURES, trees=trees)
    flagged = forest.cut_by_share(cut_lineage(scored), F.least(F.lit(0.1), F.col("_v") / F.col("_n"))).where("is_outlier")
    kept = tau.join(flagged.select(*IDENTITY, F.col("score").alias("forest_score")), list(IDENTITY))
    untested = tau.join(wanted.where(small).select(*SERIES), list(SERIES), "left_semi").withColumn("forest_score", F.lit(None).cast("double"))
    return kept.unionByName(untested)


def three_stage(df: DataFrame, *, speed_cv: DataFrame | None = None, trees: int = 100) -> DataFrame:
    """Sigma, then tau, then forest; every primary hit with the stage it reached."""
    primary = primary_sigma(df, speed_cv=speed_cv)
    tau = tau_verified(primary, df)
    final = forest_verified(tau, df, trees).select(*IDENTITY, "forest_score").withColumn("_f", F.lit(True))
    staged = primary.join(tau.select(*IDENTITY, "tau", "tau_limit"), list(IDENTITY), "left").join(final, list(IDENTITY), "left")
    stage = F.when(F.col("_f"), "primary+mtd+isolation_forest").when(F.col("tau").isNotNull(), "primary+mtd").otherwise("primary")
    return staged.withColumn("stage", stage).drop("_f")


def forest_anomalies(df: DataFrame, *, adaptive: bool = False, speed_rows: DataFrame | None = None, trees: int = 100) -> DataFrame:
    """Five-feature forest per tag, with the nearest speed as sixth feature when given."""
    rows, features = with_features(df), list(FEATURES)
    if adaptive and speed_rows is not None:
        rows = joins.nearest_speed(rows, speed_rows).fillna(0.0, ["speed_value"])
        features.append("speed_value")
    found = forest.outliers(rows, features, 0.05 if adaptive else 0.1, trees=trees).where("is_outlier")
    return found.select(*SERIES, "time", "value", F.col("score").alias("anomaly_score"), F.lit("isolation_forest").alias("anomaly_method"))


def hybrid_union(df: DataFrame, trees: int = 100) -> DataFrame:
    """Forest and statistical anomalies united, one row per reading."""
    both = dedup.union_labelled(
        {"iso": forest_anomalies(df, trees=trees).drop("anomaly_method"), "stat": statistical(df).drop("anomaly_method")}, (*IDENTITY, "value")
    )
    return both.withColumn("anomaly_method", F.lit("hybrid"))


def speed_correlated(anomalies: DataFrame, speed_rows: DataFrame, minutes: float = 30, min_cv: float = 0.1) -> DataFrame:
    """Anomalies while the speed itself varied by more than ten percent."""
    near = joins.speed_around(anomalies, speed_rows, minutes)
    cv = ratio(F.col("speed_std"), F.col("speed_mean"))
    return near.withColumn("speed_cv_near", cv).where((F.col("speed_n") >= 3) & (F.col("speed_mean") > 0) & (F.col("speed_cv_near") > min_cv))


@dataclass(frozen=True)
class Inputs:
    """What a detector may use besides the readings; speed data switch on the adaptive thresholds."""

    limits: DataFrame | None = None
    external: DataFrame | None = None
    speed_cv: DataFrame | None = None
    speed_rows: DataFrame | None = None
    trees: int = 100
    as_of: datetime | None = None

    def needed(self, name: str) -> DataFrame:
        given = getattr(self, name)
        if given is None:
            raise ValueError(f"this detector needs {name}")
        return given


# One row per anomalous reading.
READING_DETECTORS: dict[str, Callable[[DataFrame, Inputs], DataFrame]] = {
    "sigma_tau": lambda df, i: tau_verified(primary_sigma(df, speed_cv=i.speed_cv), df),
    "statistical": lambda df, i: statistical(df, adaptive=i.speed_cv is not None, speed_cv=i.speed_cv),
    "isolation_forest": lambda df, i: forest_anomalies(df, adaptive=i.speed_rows is not None, speed_rows=i.speed_rows, trees=i.trees),
    "hybrid": lambda df, i: hybrid_union(df, i.trees),
    "three_stage": lambda df, i: three_stage(df, speed_cv=i.speed_cv, trees=i.trees).where("stage = 'primary+mtd+isolation_forest'"),
}
# One row per tag with its counts.
TAG_DETECTORS: dict[str, Callable[[DataFrame, Inputs], DataFrame]] = {
    "sigma_runs": lambda df, i: sigma_runs(df, gate=False, as_of=i.as_of),
    "verified": lambda df, i: hybrid(df, i.needed("limits"), i.external, with_forest=True, trees=i.trees, as_of=i.as_of),
    "tuned": lambda df, i: tuned(df, i.needed("limits"), trees=i.trees),
    "process_aware": lambda df, i: process_aware(df, i.needed("limits"), as_of=i.as_of),
}


def detect(df: DataFrame, method: str, inputs: Inputs | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """One detector by name, over all tags or the named ones. An unknown name is an error."""
    run = READING_DETECTORS.get(method) or TAG_DETECTORS.get(method)
    if run is None:
        raise ValueError(f"no detector {method!r}; known: {', '.join(sorted(READING_DETECTORS | TAG_DETECTORS))}")
    rows = df if tags is None else df.where(F.col("tag").isin(list(tags)))
    return run(rows, inputs or Inputs())


def speed_aware(df: DataFrame, config: DataFrame, method: str = "sigma_tau", **options) -> DataFrame:
    """Detection before and after compensation, one report row per unit.

    Factors and variation (a row per unit) and the anomalies found first are written once
    and read by all that follows, instead of being derived from the readings each time.
    """
    if method not in READING_DETECTORS:
        raise ValueError(f"{method!r} finds no single readings; choose from {', '.join(READING_DETECTORS)}")
    factors = cut_lineage(speed.compensation_factors(df, config, **options))
    variation, rows = cut_lineage(speed_variation(df, config)), unit_speed(df, config)
    original = cut_lineage(detect(df, method))
    after = detect(speed.compensate(df, factors).select(*df.columns), method, Inputs(speed_cv=variation, speed_rows=rows))
    correlated = speed_correlated(original.select(*IDENTITY, "value"), rows)

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*UNIT).agg(F.count("*").alias(name))

    report = df.groupBy(*UNIT).agg(F.count("*").alias("data_points")).join(factors, list(UNIT))
    for frame, name in ((original, "original_anomalies"), (after, "compensated_anomalies"), (correlated, "speed_correlated")):
        report = report.join(counted(frame, name), list(UNIT), "left")
    report = report.fillna(0, ["original_anomalies", "compensated_anomalies", "speed_correlated"])
    before, later = F.col("original_anomalies"), F.col("compensated_anomalies")
    reduction = F.greatest(F.lit(0.0), F.coalesce(ratio(before - later, before), F.lit(0.0)))
    bonus = F.when(before > 0, F.least(F.lit(0.3), reduction * 0.5)).otherwise(0.0)
    quality = F.when(F.col("speed_points") < 10, 0.8).otherwise(1.0)
    confidence = (F.col("confidence") + bonus) * quality - F.size("warnings") * 0.05
    return report.select(
        *UNIT, "data_points", before, later, "speed_correlated", reduction.alias("reduction"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence_score"), "factor", F.col("confidence").alias("compensation_confidence"),
        F.size("warnings").alias("warnings_count"),
    )


# -- hybrid verification ---------------------------------------------------------------

def verify(
    df: DataFrame, candidate_times: DataFrame, limits: DataFrame, sigma_counts: DataFrame, external_counts: DataFrame | None = None,
    *, with_forest: bool = False, trees: int = 100, as_of=None,
) -> DataFrame:
    """T4: candidate readings confirmed by limits (configured or 2.5 sigma) or a forest.

    A time one tag fired at makes every tag of the unit a candidate at that time.
    """
    now = as_of_column(df, as_of)
    rows = valid(df).select(*SERIES, "time", "value")
    # Limits come from the whole series, not from its candidate rows.
    bounds = joins.series_limits(rows, limits, 2.5).select(*SERIES, "n", "lower", "upper")
    bounded = joins.at_candidate_times(rows, candidate_times).join(bounds, list(SERIES))
    by_limit = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    by_forest = F.lit(False)
    if with_forest:
        found = forest.outliers(rows, contamination=0.02, min_rows=30, trees=trees).where("is_outlier").select(*IDENTITY, F.lit(True).alias("_f"))
        bounded = bounded.join(found, list(IDENTITY), "left")
        by_forest = F.coalesce("_f", F.lit(False))
    judged = bounded.withColumns({"_limit": by_limit, "_forest": by_forest, "_hit": by_limit | by_forest, "_age": hours_between(now, F.col("time"))})
    table = judged.groupBy(*SERIES).agg(
        F.count("*").alias("candidates"), F.max("n").alias("n"), F.count_if("_limit").alias("mtd_count"), F.count_if("_forest").alias("forest_count"),
        F.count_if("_hit").alias("count"), F.coalesce(F.sum(F.when(F.col("_hit"), scoring.decayed(F.col("_age") / 24))), F.lit(0.0)).alias("weighted_score"),
        *[c.alias(name) for name, c in scoring.recency_counts(F.col("_age"), F.col("_hit")).items()],
    )
    table = table.join(sigma_counts.select(*SERIES, F.col("count").alias("_s")), list(SERIES), "left").withColumn("sigma_count", F.coalesce("_s", F.lit(0))).drop("_s")
    table = table.join(candidate_times.select(*UNIT, "time").distinct().groupBy(*UNIT).agg(F.count("*").alias("_times")), list(UNIT), "left")
    external = F.lit(0)
    if external_counts is not None:
        table = table.join(external_counts.select(*UNIT, F.col("count").alias("_e")), list(UNIT), "left")
        external = F.floor(F.coalesce("_e", F.lit(0)) * (F.col("candidates") / F.greatest(F.lit(1), F.col("_times"))))
    table = table.withColumn("external_count", external)
    raw = scoring.confidence_score(F.col("sigma_count"), F.col("external_count"), F.col("mtd_count"), F.col("forest_count"))
    hit = F.col("count") > 0
    score = F.when(hit, raw)
    urgency = scoring.priority(F.col("last_24h"), F.col("last_7d"), F.col("last_30d"), F.col("weighted_score"))
    return table.select(
        *SERIES, "n", "candidates", "count", (F.col("count") / F.col("n")).alias("rate"), "sigma_count", "external_count", "mtd_count", "forest_count",
        "weighted_score", "last_24h", "last_7d", "last_30d", "older", F.when(hit, urgency).alias("priority"), score.alias("confidence_score"),
        F.when(hit, scoring.confidence_level(raw)).otherwise("LOW").alias("confidence"),
    )


def hybrid(
    df: DataFrame, limits: DataFrame, external: DataFrame | None = None, *, require_external: bool = False, with_forest: bool = False, trees: int = 100, as_of=None
) -> DataFrame:
    """T5: sigma candidates plus external times, verified (T4). No sampling at any size.

    ``require_external`` without external times analyses nothing; ``hybrid_status`` tells
    that apart from a unit without anomalies.
    """
    candidates = sigma_candidates(df)
    times, counts = candidates.select(*UNIT, "time").distinct(), None
    if external is not None:
        nothing = times.limit(0)
        inside = joins.clip_and_union(df, nothing, external)
        counts = inside.groupBy(*UNIT).agg(F.count("*").alias("count"))
        times = times.union(inside).distinct()
    elif require_external:
        times = times.limit(0)
    return verify(df, times, limits, candidate_counts(candidates), counts, with_forest=with_forest, trees=trees, as_of=as_of)


def hybrid_status(df: DataFrame, table: DataFrame, external: DataFrame | None = None, *, require_external: bool = False) -> DataFrame:
    """T5: per unit ``awaiting_external_times``, ``anomalies`` or ``clear``."""
    units = df.select(*UNIT).distinct()
    if require_external and external is None:
        return units.withColumn("state", F.lit("awaiting_external_times"))
    hit = table.where("count > 0").select(*UNIT).distinct().withColumn("_hit", F.lit(True))
    return units.join(hit, list(UNIT), "left").select(*UNIT, F.when(F.col("_hit"), "anomalies").otherwise("clear").alias("state"))


def unit_header(table: DataFrame, df: DataFrame) -> DataFrame:
    """T5: totals per unit above the per-tag table."""
    totals = df.groupBy(*UNIT).agg(F.count("*").alias("records"), F.count_distinct("tag").alias("tags"))
    found = table.groupBy(*UNIT).agg(F.sum("count").alias("_c"), F.sum("sigma_count").alias("_s"))
    joined = totals.join(found, list(UNIT), "left")
    count = F.coalesce("_c", F.lit(0))
    return joined.select(*UNIT, "records", "tags", count.alias("total_anomalies"), (count / F.col("records")).alias("anomaly_rate"), F.coalesce("_s", F.lit(0)).alias("sigma_total"))


def status_aware(table: DataFrame, df: DataFrame, *, factor: float = 1.5, skip_offline: bool = False, as_of=None, hours_back: float = 2) -> DataFrame:
    """Hybrid result of a unit at low speed divided by 1.5 (zero counts dropped).

    The rate is taken over the tag's own records. Offline units are analysed all the
    same unless ``skip_offline``.
    """
    status = speed.unit_status(df, hours_back, as_of)
    joined = table.join(status.select(*UNIT, "status", "proceed"), list(UNIT), "left")
    low = F.col("status") == "LOW_SPEED"
    count = F.when(low, F.floor(F.col("count") / factor)).otherwise(F.col("count"))
    rate = F.when(low, F.col("rate") / factor).otherwise(F.col("rate"))
    level = F.when(low, "MEDIUM (Status-Adjusted)").otherwise(F.col("confidence"))
    out = joined.select(*SERIES, F.col("status").alias("unit_status"), "proceed", low.alias("_low"), count.alias("count"), rate.alias("rate"), level.alias("confidence"))
    out = out.where(~F.col("_low") | (F.col("count") > 0)).drop("_low")
    return out.where("proceed") if skip_offline else out


def segment_aware(df: DataFrame, config: DataFrame, limits: DataFrame, *, with_forest: bool = True, trees: int = 100, as_of=None) -> DataFrame:
    """Clamped compensation, then the hybrid detector, with the older verified gate."""
    scaled = speed.segment_compensate(df, config)
    factors = scaled.groupBy(*UNIT).agg(F.max("factor").alias("factor"))
    table = hybrid(scaled.drop("factor"), limits, with_forest=with_forest, trees=trees, as_of=as_of)
    gate = scoring.verified_gate(F.col("sigma_count"), F.col("external_count"), F.col("mtd_count"), F.col("forest_count"), F.col("confidence"))
    return table.join(factors, list(UNIT)).withColumn("verified", gate)


def alerts(table: DataFrame) -> DataFrame:
    """The alert decision for every tag of a verified table."""
    c = [F.col(x) for x in ("priority", "last_24h", "confidence_score", "sigma_count", "external_count", "mtd_count", "forest_count")]
    return table.withColumn("alert", F.coalesce(scoring.alert_gate(*c), F.lit(False)))


def plot_selection(table: DataFrame, most: int = 5) -> DataFrame:
    """Tags worth a picture: ranked by score, then the count, rate and top-two rules."""
    scored = table.withColumn("plot_score", scoring.plot_score(F.col("count"), F.col("rate"), F.col("confidence")))
    ranked = windows.top_per_unit(scored, "plot_score", most)
    place, count = F.col("rank") - 1, F.col("count")
    return ranked.where((count >= 10) | (F.col("rate") >= 0.05) | ((place < 2) & (count > 0)))


# -- breakout --------------------------------------------------------------------------

def on_grid(df: DataFrame, minutes: int = 10, by: Sequence[str] = SERIES, span: Sequence[str] = UNIT, wanted: DataFrame | None = None, longest: int = 1) -> DataFrame:
    """Bucket means of every series at its unit's buckets with readings, filled forward, with the ``buckets`` a row stands for.

    A run of empty buckets of the whole unit repeats the row before it: it is written out up
    to ``longest`` rows, and the last of them stands for the rest. So rows grow with the
    readings, not with the time between the first and the last. ``wanted``: the series to lay
    out (default all); the grid is the whole unit's.
    """
    from plantspark.operators.aggregates import resample

    means = resample(df, minutes, by)
    steps = cut_lineage(means.select(*span, F.col("bucket").alias("time")).distinct())
    # A series has at most one row per step of its unit, and ``longest`` for the gap behind it.
    most = steps.groupBy(*span).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    hot = None if most * longest > sequence.TARGET_ROWS else False
    micros = minutes * 60_000_000
    laid = sequence.lay_out(steps, span, hot=None if most > sequence.TARGET_ROWS else False)
    following = sequence.strip(sequence.row_frame(laid, lambda w: {"_next": F.lead("time").over(w)}, after=1, keys=span))
    n = F.coalesce((F.unix_micros("_next") - F.unix_micros("time")) / micros, F.lit(1)).cast("long")
    shown = F.least(F.col("_n"), F.lit(longest))
    runs = following.withColumn("_n", n).select(*span, "time", "_n", F.explode(F.sequence(F.lit(0).cast("long"), shown - 1)).alias("_i"))
    rows = runs.select(
        *span, F.timestamp_micros(F.unix_micros("time") + F.col("_i") * micros).alias("time"), F.when(F.col("_i") < shown - 1, F.lit(1)).otherwise(F.col("_n") - shown + 1).cast("long").alias("buckets")
    )
    if wanted is not None:
        means = means.join(wanted, list(by), "left_semi")
    full = means.select(*by).distinct().join(rows, list(span)).join(means.withColumnRenamed("bucket", "time"), [*by, "time"], "left")
    return sequence.carry(sequence.lay_out(full, by, hot=hot), "value", "value", keys=by)


def breakouts(
    df: DataFrame, speed_tag: str, windows_by_unit: DataFrame | None = None, *, minutes: int = 10, rows: int = 20, low: float = 0.1, high: float = 0.9,
    persist: int = 2, persist_rows: int = 3, cooldown: int = 5, by: Sequence[str] = SERIES, span: Sequence[str] = UNIT, since: Column | None = None,
) -> DataFrame:
    """Leaving the rolling quantile band twice in three steps at usual speed, as events.

    ``windows_by_unit``: speed_low / speed_high per unit; without it every time counts.
    ``since``: only events and points from then on count; the bands know the time before.

    Once a constant value fills the band's frame, nothing is outside it, and after the
    persistence and the cooldown no row depends on an earlier one. So a gap needs as many
    rows as these three frames hold, however long it is.
    """
    grid = on_grid(df, minutes, by, span, longest=rows + persist_rows + cooldown)
    series = grid.where(F.col("tag") != speed_tag)
    enough = max(3, rows // 2)

    def bands(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        ok = F.count("value").over(frame) >= enough
        return {"_low": F.when(ok, F.percentile("value", F.lit(low)).over(frame)), "_high": F.when(ok, F.percentile("value", F.lit(high)).over(frame))}

    banded = sequence.row_frame(series, bands, before=rows - 1, keys=by)
    outside = F.coalesce((F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high")), F.lit(False))
    marked = banded.withColumn("_out", outside.cast("int")).drop("_low", "_high")
    if persist_rows > 1 and persist > 1:
        held = sequence.row_frame(marked, lambda w: {"_held": F.sum("_out").over(w.rowsBetween(-(persist_rows - 1), 0)) >= persist}, before=persist_rows - 1, keys=by)
    else:
        held = marked.withColumn("_held", F.col("_out") == 1)
    steady = F.lit(True)
    if windows_by_unit is not None:
        speed_grid = grid.where(F.col("tag") == speed_tag).select(*span, "time", F.col("value").alias("_speed"))
        ranges = windows_by_unit.select(*UNIT, "speed_low", "speed_high")
        speed_grid = speed_grid.join(ranges, list(UNIT)).select(*span, "time", F.col("_speed").between(F.col("speed_low"), F.col("speed_high")).alias("_steady"))
        held = held.join(speed_grid, [*span, "time"], "left")
        steady = F.coalesce("_steady", F.lit(False))
    recent = F.lit(0).cast("long") if since is None else F.greatest(F.lit(0), F.ceil((F.unix_micros(since) - F.unix_micros("time")) / (minutes * 60_000_000)))
    within = F.greatest(F.lit(0), F.col("buckets") - recent)  # of the buckets of a row, those not before ``since``
    flagged = held.withColumn("_mask", steady).withColumn("_hit", F.col("_held") & steady & (recent <= 0))
    events = windows.cooldown_counts(flagged, F.col("_hit"), cooldown, by)
    points = flagged.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_mask"), within)), F.lit(0)).alias("points"))
    out = events.join(points, list(by)).where(F.col("events") > 0)
    return out.withColumn("rate", F.col("events") / F.greatest(F.lit(1), F.col("points")))

