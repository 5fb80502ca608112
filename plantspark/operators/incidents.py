"""Incidents: who, what, when, where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.functions import scoring, tags
from plantspark.operators import dedup, joins, sequence, windows
from plantspark.operators.quantiles import distribution
from plantspark.schema import SERIES, UNIT, hours, moment, valid
from plantspark.session import cut_lineage

EQUIPMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("unit", "equipment_name", "equipment_type", "area", "system", "criticality")])


def z_incidents(df: DataFrame, limit: float = 3.0, high: float = 5.0) -> DataFrame:
    """Readings beyond three sigma, HIGH beyond five, of series with more than ten values."""
    scored = joins.z_scores(valid(df)).where((F.col("n") > 10) & (F.abs("z") > limit))
    return scored.select(*SERIES, "time", "value", *[c.alias(n) for n, c in _z_incident(F.abs("z"), high).items()])


def _with_steps(df: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Rows beside their step to the previous value, its quantile per series, and n, mean and std of the values.

    The statistics of both kinds of incident come from the same two passes.
    """
    stepped = sequence.row_frame(valid(df).select(*SERIES, "time", "value"), lambda w: {"_step": F.abs(F.col("value") - F.lag("value").over(w))}, before=1)
    plain = {"_n": F.count("value"), "mean": F.avg("value"), "std": F.stddev_samp("value")}
    stats, _ = distribution(stepped, SERIES, "_step", {"_limit": quantile}, plain, hot=not sequence.is_whole(stepped))
    return sequence.strip(stepped).join(cut_lineage(stats), list(SERIES))


def _z_incident(size: Column, high: float) -> dict[str, Column]:
    return {"size": size, "severity": F.when(size > high, "HIGH").otherwise("MEDIUM"), "notes": F.format_string("Statistical outlier (Z=%.1f)", size), "method": F.lit("z_score")}


def _jump_incident(step: Column, limit: Column) -> dict[str, Column]:
    return {"size": step, "severity": F.when(step > 2 * limit, "HIGH").otherwise("MEDIUM"), "notes": F.format_string("Sudden jump (%.2f change)", step), "method": F.lit("jump_detection")}


def _is_jump(min_rows: int) -> Column:
    return (F.col("_step") > F.col("_limit")) & (F.col("_n") >= min_rows)


def jump_incidents(df: DataFrame, quantile: float = 0.95, min_rows: int = 10) -> DataFrame:
    """Steps above the series' own 95th percentile step, HIGH above twice that."""
    hits = _with_steps(df, quantile).where(_is_jump(min_rows))
    return hits.select(*SERIES, "time", "value", *[c.alias(n) for n, c in _jump_incident(F.col("_step"), F.col("_limit")).items()])


def incidents(df: DataFrame, limit: float = 3.0, high: float = 5.0, min_rows: int = 10) -> DataFrame:
    """Both kinds in one pass over the rows, one per series and minute, outliers before jumps."""
    size = F.abs((F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    struct = lambda kind: F.struct(*[c.alias(n) for n, c in kind.items()])
    both = F.array_compact(
        F.array(
            F.when((F.col("_n") > 10) & (size > limit), struct(_z_incident(size, high))),
            F.when(_is_jump(min_rows), struct(_jump_incident(F.col("_step"), F.col("_limit")))),
        )
    )
    rows = _with_steps(df).select(*SERIES, "time", "value", F.explode(both).alias("_i")).select(*SERIES, "time", "value", "_i.*")
    return dedup.one_per_minute(rows, ("z_score", "jump_detection"))


def incident_report(df: DataFrame, anomaly_counts: DataFrame, equipment: DataFrame, *, hours_back: float = 24, top: int = 10, as_of=None) -> DataFrame:
    """For the most anomalous tags of every unit: equipment, type, incidents, action.

    ``anomaly_counts``: a detector's per-tag table with ``count``.
    """
    recent = df.where(F.col("time") >= moment(df, as_of) - hours(hours_back))
    counts = anomaly_counts.where(F.col("count") > 0).select(*SERIES, F.col("count").alias("total_anomalies"))
    chosen = cut_lineage(windows.top_per_unit(counts, "total_anomalies", top))  # at most ``top`` rows a unit, read often below
    # Only the chosen tags' readings are searched.
    recent = recent.join(chosen.select(*SERIES), list(SERIES), "left_semi")
    present = recent.select(*SERIES).distinct()
    found = incidents(recent).groupBy(*SERIES).agg(
        F.count("*").alias("_i"), F.max("time").alias("last_incident"), F.count_if(F.col("severity") == "HIGH").alias("_h")
    )
    rows = chosen.join(present, list(SERIES), "left_semi").join(found, list(SERIES), "left").join(equipment, ["unit"], "left")
    parts, kind = tags.tag_parts(F.col("tag")), tags.indicator(F.col("tag"))
    name = F.coalesce("equipment_name", F.lit("Equipment Unknown"))
    number = F.coalesce("_i", F.lit(0))
    return rows.select(
        *SERIES, "rank", "total_anomalies", name.alias("equipment"), F.coalesce("area", F.lit("Unknown Area")).alias("area"),
        F.coalesce("system", F.lit("Unknown System")).alias("system"), F.coalesce("criticality", F.lit("Unknown")).alias("criticality"),
        parts["tag_id"].alias("tag_id"), kind["tag_type"].alias("tag_type"), kind["description"].alias("description"),
        number.alias("incidents"), F.coalesce("_h", F.lit(0)).alias("high_incidents"), "last_incident",
        scoring.recommended_action(kind["tag_type"], name, number).alias("action"),
    )


def incident_summary(report: DataFrame) -> DataFrame:
    """Tags with incidents and incidents per unit."""
    return report.groupBy(*UNIT).agg(F.count_if(F.col("incidents") > 0).alias("anomalous_tags"), F.sum("incidents").alias("incidents"))
