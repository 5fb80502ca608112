"""The reading: one row per (plant, unit, tag, time), and the rules every operator shares.

Null, NaN and time rules are decided here once:

* a NaN value is read as null, so averages and quantiles skip it;
* "now" never comes from the wall clock: every operator takes ``as_of`` and falls
  back to the newest time of its input;
* times are session-zone timestamps, the session runs in UTC.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("plant", "unit", "tag")
UNIT = ("plant", "unit")
NATURAL_KEY = (*SERIES, "time")

READING = T.StructType(
    [
        T.StructField("plant", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Column names under which exports carry the time.
TIME_ALIASES = ("time", "timestamp", "index", "__index_level_0__", "TIME")

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def normalise(df: DataFrame) -> DataFrame:
    """Bring any readings-like frame to the canonical columns; bad cells become null.

    The first time alias present becomes ``time``; missing text columns become null;
    unparseable times and numbers become null instead of raising.
    """
    source = next((c for c in TIME_ALIASES if c in df.columns), None)
    if source is None:
        raise ValueError(f"no time column among {df.columns}")
    types = dict(df.dtypes)
    time = F.col(f"`{source}`")
    time = F.try_to_timestamp(time) if types[source] == "string" else time.cast("timestamp")
    value = F.col("value").try_cast("double")
    cols = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SERIES]
    extra = [c for c in df.columns if c not in {*SERIES, source, "value"}]
    return df.select(*cols, time.alias("time"), F.nanvl(value, F.lit(None)).alias("value"), *extra)


def valid(df: DataFrame) -> DataFrame:
    """Rows with both a time and a numeric value."""
    return df.where(F.col("time").isNotNull() & F.col("value").isNotNull())


def as_of(df: DataFrame, moment: Column | datetime | str | None) -> Column:
    """The reference time: given, or the newest reading as a scalar subquery."""
    if isinstance(moment, Column):
        return moment
    if moment is not None:
        return F.lit(moment).cast("timestamp")
    return df.select(F.max("time")).scalar()


def moment(df: DataFrame, at: Column | datetime | str | None) -> Column:
    """The reference time as a literal, so that filters by it reach the scan; asks the data at once when not given."""
    if at is not None:
        return as_of(df, at)
    newest = df.agg(F.max(F.unix_micros("time"))).first()[0]
    return F.timestamp_micros(F.lit(newest).cast("long"))


def micros(column: str | Column = "time") -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_HOUR))


def days(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * 86400.0).cast("decimal(18,6)"))


def hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * 3600.0).cast("decimal(18,6)"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def any_of(column: Column, needles: tuple[str, ...] | list[str]) -> Column:
    """True where the text contains one of the needles."""
    out = F.lit(False)
    for needle in needles:
        out = out | column.contains(needle)
    return out
