"""Levels, scores, limits and gates: threshold ladders as column expressions.

The numbers in this module are fixed values of the product: they decide results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantspark.schema import ratio


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str, *, strict: bool = False) -> Column:
    """First label whose bound is not exceeded (``strict``: value below the bound)."""
    out = F.lit(otherwise)
    for bound, label in reversed(steps):
        out = F.when(value < bound if strict else value <= bound, label).otherwise(out)
    return out


# -- staleness -------------------------------------------------------------------------

def staleness(age_hours: Column, fresh_hours: float = 24.0) -> Column:
    return ladder(age_hours, ((fresh_hours, "FRESH"), (48, "MILDLY_STALE"), (168, "STALE")), "SEVERELY_STALE")


FINE_STALENESS = ((1, "FRESH", "none"), (6, "MILDLY_STALE", "low"), (24, "STALE", "medium"), (168, "VERY_STALE", "high"))


def fine_staleness(age_hours: Column) -> Column:
    return ladder(age_hours, [(b, level) for b, level, _ in FINE_STALENESS], "EXTREMELY_STALE")


def fine_severity(age_hours: Column) -> Column:
    return ladder(age_hours, [(b, severity) for b, _, severity in FINE_STALENESS], "critical")


def gap_diagnosis(gap_hours: Column) -> Column:
    return F.when(gap_hours > 24, "SHUTDOWN").when(gap_hours > 4, "DATA_INTERRUPTION").otherwise("MINOR")


# -- recency, priority, confidence -----------------------------------------------------

def decayed(age_days: Column, half_life_days: float = 7.0) -> Column:
    """Weight of one event: halves every ``half_life_days``."""
    return F.exp(-F.log(F.lit(2.0)) / half_life_days * F.greatest(F.lit(0.0), age_days))


def recency_counts(age_hours: Column, counted: Column) -> dict[str, Column]:
    """Aggregates: how many counted events fall into each exclusive age bucket."""
    bounds = {"last_24h": (None, 24), "last_7d": (24, 168), "last_30d": (168, 720), "older": (720, None)}
    out = {}
    for name, (above, upto) in bounds.items():
        hit = counted
        if above is not None:
            hit = hit & (age_hours > above)
        if upto is not None:
            hit = hit & (age_hours <= upto)
        out[name] = F.count_if(hit)
    return out


def priority(last_24h: Column, last_7d: Column, last_30d: Column, weighted: Column) -> Column:
    return (
        F.when(last_24h > 0, "CRITICAL")
        .when((last_7d > 5) | (weighted > 10), "HIGH")
        .when((last_30d > 10) | (weighted > 5), "MEDIUM")
        .otherwise("LOW")
    )


def confidence_score(sigma: Column, autoencoder: Column, limits: Column, forest: Column) -> Column:
    """0 to 100: two primary detectors up to 40 and 30, two verifiers up to 20 and 10."""
    parts = ((sigma, 4.0, 40.0), (autoencoder, 3.0, 30.0), (limits, 2.0, 20.0), (forest, 1.0, 10.0))
    total = F.lit(0.0)
    for count, weight, top in parts:
        total = total + F.least(F.lit(top), F.greatest(F.lit(0.0), count * F.lit(weight)))
    return total


def confidence_level(score: Column) -> Column:
    return F.when(score >= 80, "VERY_HIGH").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def dynamic_confidence(recent: Column, run: Column, rate: Column) -> Column:
    raw = (
        F.lit(20.0)
        + F.least(F.lit(35.0), recent * 2.5)
        + F.least(F.lit(30.0), run * 3.0)
        + F.least(F.lit(15.0), rate * 100.0)
    )
    return F.least(F.lit(100), F.greatest(F.lit(20), F.floor(raw)))


def dynamic_level(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


def deviation_percent(current: Column, baseline: Column) -> Column:
    """Distance from the baseline mean in percent, clamped to 0..300, 0 for baseline 0."""
    raw = F.coalesce(F.abs(ratio(current - baseline, baseline)) * 100.0, F.lit(0.0))
    return F.least(F.lit(300.0), F.greatest(F.lit(0.0), raw))


ALERT_SCORE_BY_PRIORITY = {"CRITICAL": 50, "HIGH": 60, "MEDIUM": 70, "LOW": 80}


def alert_gate(priority_: Column, last_24h: Column, score: Column, sigma: Column, autoencoder: Column, limits: Column, forest: Column) -> Column:
    """Alert only for fresh, urgent, confirmed anomalies with the score their priority asks for."""
    needed = F.lit(ALERT_SCORE_BY_PRIORITY["LOW"])
    for name, bound in ALERT_SCORE_BY_PRIORITY.items():
        needed = F.when(priority_ == name, bound).otherwise(needed)
    return (
        priority_.isin("CRITICAL", "HIGH")
        & (last_24h > 0)
        & (score >= needed)
        & ((sigma > 0) | (autoencoder > 0))
        & ((limits > 0) | (forest > 0))
    )


def verified_gate(sigma: Column, autoencoder: Column, limits: Column, forest: Column, level: Column) -> Column:
    """Older gate: HIGH or MEDIUM confidence only, so VERY_HIGH does not pass (kept as is)."""
    return ((sigma > 0) | (autoencoder > 0)) & ((limits > 0) | (forest > 0)) & level.isin("HIGH", "MEDIUM")


def plot_score(count: Column, rate: Column, confidence: Column) -> Column:
    factor = F.when(confidence == "HIGH", 1.5).when(confidence == "MEDIUM", 1.2).otherwise(1.0)
    return (count * 10.0 + rate * 1000.0) * factor


# -- limits and classes ----------------------------------------------------------------

def stability(cv_percent: Column) -> Column:
    return ladder(cv_percent, ((2, "VERY_STABLE"), (5, "STABLE"), (10, "MODERATELY_STABLE")), "VARIABLE", strict=True)


def sigma_of_stability(label: Column) -> Column:
    return F.when(label == "VERY_STABLE", 4.0).when(label == "STABLE", 3.5).when(label == "MODERATELY_STABLE", 3.0).otherwise(2.5)


def sensitivity(label: Column, outlier_percent: Column) -> Column:
    return (
        F.when(label.isin("VERY_STABLE", "STABLE") & (outlier_percent < 2), "LOW_SENSITIVITY")
        .when((label == "MODERATELY_STABLE") & (outlier_percent < 3), "MEDIUM_SENSITIVITY")
        .otherwise("HIGH_SENSITIVITY")
    )


INFINITY = float("inf")
# type: physical low/high, floor of the low limit, share of range below, ceiling, share above
ENGINEERING_LIMITS = {
    "TEMPERATURE": (-273.0, 2000.0, -50.0, 0.5, 500.0, 0.5),
    "PRESSURE": (0.0, 1000.0, 0.0, 0.3, 200.0, 0.5),
    "FLOW": (0.0, 50000.0, 0.0, 0.2, None, 0.8),
    "SPEED": (0.0, 20000.0, 0.0, 0.3, None, 0.5),
}
LEVEL_LIMITS = (0.0, 100.0, 5.0)
GENERIC_RANGE_SHARE = 0.5


def engineering_limits(kind: Column, lowest: Column, highest: Column) -> dict[str, Column]:
    """Physical limits (null where unbounded) and reasonable limits by tag type."""
    span = highest - lowest
    low_ok = lowest - span * GENERIC_RANGE_SHARE
    high_ok = highest + span * GENERIC_RANGE_SHARE
    low_phys = high_phys = F.lit(None).cast("double")
    for name, (p_low, p_high, floor, below, ceiling, above) in ENGINEERING_LIMITS.items():
        is_kind = kind == name
        top = highest + span * above
        low_phys = F.when(is_kind, p_low).otherwise(low_phys)
        high_phys = F.when(is_kind, p_high).otherwise(high_phys)
        low_ok = F.when(is_kind, F.greatest(F.lit(floor), lowest - span * below)).otherwise(low_ok)
        high_ok = F.when(is_kind, top if ceiling is None else F.least(F.lit(ceiling), top)).otherwise(high_ok)
    p_low, p_high, margin = LEVEL_LIMITS
    is_level = kind == "LEVEL"
    return {
        "min_physical": F.when(is_level, p_low).otherwise(low_phys),
        "max_physical": F.when(is_level, p_high).otherwise(high_phys),
        "min_reasonable": F.when(is_level, F.greatest(F.lit(p_low), lowest - margin)).otherwise(low_ok),
        "max_reasonable": F.when(is_level, F.least(F.lit(p_high), highest + margin)).otherwise(high_ok),
    }


def suitability(n: Column, mean: Column, std: Column, lowest: Column, highest: Column) -> Column:
    """Fitness of a speed tag for compensation; a zero mean counts as endless variation."""
    cv = F.coalesce(ratio(std, mean), F.lit(INFINITY))
    return (
        F.when(n < 10, "insufficient_data")
        .when(cv < 0.05, "low_variability")
        .when(cv > 2.0, "high_variability")
        .when(lowest < 0, "invalid_range")
        .when(highest == 0, "zero_speed")
        .otherwise("excellent")
    )


def tau_critical(n: Column) -> Column:
    return F.when(n <= 10, 1.15).when(n <= 50, 1.4).otherwise(1.5)


def adaptive_sigma(base: Column, speed_cv: Column) -> Column:
    """Looser when the speed is steady, tighter when it swings; unchanged without speed data."""
    return (
        F.when(speed_cv > 0.2, F.greatest(F.lit(2.0), base - 0.3))
        .when(speed_cv < 0.05, F.least(F.lit(3.0), base + 0.2))
        .otherwise(base)
    )


# -- wording ---------------------------------------------------------------------------

ACTIONS = (
    ("Temperature", "URGENT: Check thermal conditions on %s - %d temperature anomalies detected. Verify cooling/heating systems."),
    ("Pressure", "URGENT: Investigate pressure system on %s - %d pressure anomalies. Check for leaks, blockages, or control issues."),
    ("Level", "CHECK: Verify level control on %s - %d level anomalies. Inspect level transmitter and control valve."),
    ("Flow", "CHECK: Investigate flow conditions on %s - %d flow anomalies. Verify flow elements and control."),
    ("Speed", "URGENT: Check rotational equipment on %s - %d speed anomalies. Inspect coupling, bearings, drive system."),
    ("Vibration", "URGENT: Mechanical inspection required on %s - %d vibration anomalies. Check alignment, balance, bearings."),
    ("Position", "CHECK: Verify actuator/valve on %s - %d position anomalies. Inspect control valve and positioner."),
    ("Performance", "ANALYZE: Performance degradation on %s - %d performance anomalies. Review operational parameters."),
)


def recommended_action(kind: Column, equipment: Column, incidents: Column) -> Column:
    out = F.format_string("INVESTIGATE: %2$d anomalies detected on %1$s. Detailed analysis required.", equipment, incidents)
    for word, template in reversed(ACTIONS):
        out = F.when(kind.contains(word), F.format_string(template, equipment, incidents)).otherwise(out)
    quiet = F.concat(F.lit("Monitor "), F.lower(kind), F.lit(" on "), equipment, F.lit(" - no recent incidents"))
    return F.when(incidents == 0, quiet).otherwise(out)
