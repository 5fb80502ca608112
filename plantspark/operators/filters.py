"""Row filters (F1 to F15). Comparisons stay on bare columns so that they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantspark.functions import tags
from plantspark.schema import as_of as as_of_column
from plantspark.schema import days, hours

# Units that come first in a limited selection.
PRIORITY_UNITS = ("K-31-01", "K-19-01", "K-16-01", "K-12-01")


def select_readings(df, *, plant=None, unit=None, tag=None, start=None, end=None) -> DataFrame:
    """F1 + F2: any subset of equality filters and an inclusive time range."""
    for name, wanted in (("plant", plant), ("unit", unit), ("tag", tag)):
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    if start is not None:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("time") <= F.lit(end).cast("timestamp"))
    return df


def trailing(df: DataFrame, *, hours_back: float | None = None, days_back: float | None = None, as_of=None) -> DataFrame:
    """The last N hours or days before ``as_of`` (default: the data's own end)."""
    width = hours(hours_back) if hours_back is not None else days(days_back)
    return df.where(F.col("time") >= as_of_column(df, as_of) - width)


def plausible_dates(df: DataFrame, first_year: int = 2020) -> DataFrame:
    """drop readings before ``first_year``; a plain time bound, so it prunes."""
    return df.where(F.col("time") >= F.make_timestamp(*[F.lit(v) for v in (first_year, 1, 1, 0, 0, 0)]))


def epoch_dates(df: DataFrame) -> DataFrame:
    """per unit, does the data start in 1970 (a failed time conversion)?"""
    return df.groupBy("plant", "unit").agg((F.year(F.min("time")) == 1970).alias("has_epoch_dates"))


def retained(df: DataFrame, keep_days: float, as_of=None) -> DataFrame:
    """what stays after deleting readings older than ``keep_days``."""
    return df.where(F.col("time") >= as_of_column(df, as_of) - days(keep_days))


def known_units(df: DataFrame, units: Sequence[str]) -> DataFrame:
    """F8: listed units only; hash-like names (long, with dashes) never pass."""
    hash_like = (F.length("unit") > 20) & F.col("unit").contains("-")
    return df.where(F.col("unit").isin(*units) & ~hash_like)


def rename_unit(df: DataFrame, alias: str, canonical: str) -> DataFrame:
    """three spellings of an alias become the canonical unit."""
    spellings = {alias, alias.replace("/", "-"), alias.replace("/", "_")}
    return df.withColumn("unit", F.when(F.col("unit").isin(*spellings), canonical).otherwise(F.col("unit")))


def speed_sensors(df: DataFrame) -> DataFrame:
    """tags named like speed sensors, other quantities excluded."""
    return df.where(tags.is_speed_sensor(F.col("tag")))


def tag_matches(df: DataFrame, pattern: str = "SI-|KI-|SPEED|RPM") -> DataFrame:
    """regular expression on the tag."""
    return df.where(F.col("tag").rlike(pattern))


def named_for_unit(df: DataFrame, plant: str, unit: str) -> DataFrame:
    """tags named ``plant_unit_…`` or ``plant.unit.…``, any case, names taken literally."""
    lower, p, u = F.lower("tag"), plant.lower(), unit.lower()
    return df.where(lower.contains(f"{p}_{u}_") | lower.contains(f"{p}.{u}."))


def unit_list(df: DataFrame) -> DataFrame:
    return df.select("unit").distinct()


def scope_units(units: DataFrame, scope: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """all units, ``PLANT=<name>`` or ``UNITS=a,b``, minus an exclusion list."""
    kind, _, rest = scope.strip().partition("=")
    if kind.upper() == "PLANT" and rest:
        units = units.where(F.upper(tags.plant_of_unit(F.col("unit"))) == rest.strip().upper())
    elif kind.upper() == "UNITS" and rest:
        units = units.where(F.col("unit").isin(*[u.strip() for u in rest.split(",") if u.strip()]))
    deny = [u.strip().upper() for u in exclude if u.strip()]
    return units.where(~F.upper(F.trim("unit")).isin(*deny)) if deny else units


def shard_units(units: DataFrame, index: int, total: int) -> DataFrame:
    """shard ``index`` of ``total`` over the sorted unit names (a small dimension)."""
    numbered = units.withColumn("_n", F.row_number().over(Window.orderBy("unit")) - 1)
    return numbered.where(F.pmod("_n", F.lit(total)) == index % total).drop("_n")


def prioritised_units(units: DataFrame, limit: int = 8, first: Sequence[str] = PRIORITY_UNITS) -> DataFrame:
    """the priority units present, then others in name order up to the limit."""
    rank: Column = F.lit(len(first))
    for i, unit in enumerate(first):
        rank = F.when(F.col("unit") == unit, i).otherwise(rank)
    return units.withColumn("unit_rank", rank).orderBy("unit_rank", "unit").limit(limit)


def numeric_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """value as a number; rows without time or number go."""
    return df.withColumn("value", F.col(value).try_cast("double")).where(F.col("time").isNotNull() & F.col("value").isNotNull())


def replaced(column: str, mapping: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))
