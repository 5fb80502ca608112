"""Time expressions: relative offsets, fetch windows, spreadsheet day numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIVE = r"^-\s*(\d*\.?\d+)([ydhmYDHM])$"
STEP = r"^-\s*(\d*\.?\d+)([hmHM])$"
# Minutes per unit letter, default step, bounds of the row estimate.
MINUTES = {"y": 525600.0, "d": 1440.0, "h": 60.0, "m": 1.0}
DEFAULT_STEP_MINUTES = 6.0
ROW_BOUNDS = (2_000, 100_000)
# Day number of 1970-01-01 in spreadsheets, share that prefers day numbers.
EPOCH_DAY_NUMBER = 25_569
SERIAL_SHARE = 0.9


def _minutes(text: Column, pattern: str) -> Column:
    compact = F.regexp_replace(F.trim(text), " ", "")
    letter = F.lower(F.regexp_extract(compact, pattern, 2))
    factor = F.lit(None).cast("double")
    for name, minutes in MINUTES.items():
        factor = F.when(letter == name, minutes).otherwise(factor)
    return F.when(compact.rlike(pattern), F.regexp_extract(compact, pattern, 1).try_cast("double") * factor)


def relative_minutes(text: Column) -> Column:
    """``-4h``, ``-1y``, ``-0.1h``, ``-30m`` as minutes back; null when not relative."""
    return _minutes(text, RELATIVE)


def step_minutes(text: Column) -> Column:
    return F.coalesce(_minutes(text, STEP), F.lit(DEFAULT_STEP_MINUTES))


def estimated_rows(start: Column, step: Column, end: Column) -> Column:
    """Rows a fetch from ``start`` (relative or absolute) to ``end`` will bring, clamped."""
    absolute = (F.unix_micros(end) - F.unix_micros(F.try_to_timestamp(start))) / 60e6
    back = F.greatest(F.lit(1.0), F.coalesce(relative_minutes(start), absolute, F.lit(MINUTES["y"])))
    rows = F.floor(back / F.greatest(F.lit(0.1), step_minutes(step)) + 10)
    return F.greatest(F.lit(ROW_BOUNDS[0]), F.least(rows, F.lit(ROW_BOUNDS[1])))


def interval_text(step: Column) -> Column:
    """A step as the whole-minute interval a service expects: ``-0.1h`` -> ``6m``."""
    minutes = _minutes(step, STEP)
    return F.concat(F.coalesce(F.bround(minutes, 0).cast("bigint"), F.lit(int(DEFAULT_STEP_MINUTES))).cast("string"), F.lit("m"))


def fetch_hours(gap_hours: Column, cap: int = 720) -> Column:
    """Whole hours to fetch for a gap: ten percent more, one extra, capped."""
    return F.least(F.floor(gap_hours * 1.1) + 1, F.lit(cap))


def from_day_number(days: Column) -> Column:
    return F.timestamp_micros(F.round((days - EPOCH_DAY_NUMBER) * 86400e6).cast("bigint"))


def to_day_number(time: Column) -> Column:
    return F.unix_micros(time) / 86400e6 + EPOCH_DAY_NUMBER


def prefer_day_numbers(serial_count: Column, text_count: Column) -> Column:
    """Use day numbers when they parse at least 90 % as often as texts do."""
    return (serial_count > 0) & (serial_count >= F.greatest(F.lit(1), F.floor(text_count * SERIAL_SHARE)))
