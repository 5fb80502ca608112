"""Ordered operators equal pandas, whether or not a series is cut into pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantspark.operators import detectors, sequence, windows

KEYS = ["plant", "unit", "tag"]


def ordered(df):
    return sequence.strip(df).toPandas().sort_values([*KEYS, "time"]).reset_index(drop=True)


def same(left, right):
    np.testing.assert_allclose(left.to_numpy(dtype=float), right.to_numpy(dtype=float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_every_series_is_really_cut(readings, layout):
    pieces = sequence.lay_out(readings).groupBy(*KEYS).agg(F.count_distinct("_piece").alias("n")).toPandas()["n"]
    assert (pieces == 1).all() if layout == "whole" else (pieces >= 3).all()


def test_row_frames(readings, frame, layout):
    out = ordered(windows.rolling_stats(windows.lags(readings), 5, 1))
    groups = frame.groupby(KEYS)["value"]
    for i in (1, 2, 3):
        same(out[f"lag{i}"], groups.shift(i))
    same(out["mean5"], groups.rolling(5, min_periods=1).mean().reset_index(drop=True))
    same(out["std5"], groups.rolling(5, min_periods=1).std().reset_index(drop=True))


def test_trailing_days(readings, frame, layout):
    out = ordered(windows.rolling_days(readings, 7, 3))
    rolled = frame.set_index("time").groupby(KEYS)["value"].rolling("7D", min_periods=3)
    same(out["roll_mean"], rolled.mean().reset_index(drop=True))
    same(out["roll_std"], rolled.std().reset_index(drop=True))


def test_quantile_bands(readings, frame, layout):
    out = ordered(windows.quantile_bands(readings))
    rolled = frame.groupby(KEYS)["value"].rolling(20, min_periods=10)
    same(out["band_low"], rolled.quantile(0.1).reset_index(drop=True))
    same(out["band_high"], rolled.quantile(0.9).reset_index(drop=True))


def test_fill_and_interpolation(readings, frame, layout):
    holes = readings.withColumn("value", F.when(F.col("seq") % 3 == 0, F.col("value")))
    gaps = frame.assign(value=frame["value"].where(frame["seq"] % 3 == 0))
    groups = gaps.groupby(KEYS)["value"]
    filled = ordered(windows.fill(holes, default=0.0))["value"]
    same(filled, groups.ffill().fillna(groups.bfill()).fillna(0))
    known = gaps["value"].notna()
    assert (filled[known] == gaps["value"][known]).all()
    wanted = gaps.set_index("time").groupby(KEYS)["value"].apply(lambda s: s.interpolate("time", limit_direction="both"))
    same(ordered(windows.interpolate(holes))["interpolated"], wanted.reset_index(drop=True))


def longest(flags):
    best = run = 0
    for flag in flags:
        run = run + 1 if flag else 0
        best = max(best, run)
    return best


def test_runs(readings, frame, layout):
    wanted = frame.assign(f=frame["value"] > 40).groupby(KEYS)["f"].apply(longest).reset_index(drop=True)
    flag = F.col("value") > 40
    by_ids = windows.longest_run(readings, flag).toPandas().sort_values(KEYS)["longest_run"].reset_index(drop=True)
    by_pieces = sequence.run_summary(readings, flag).toPandas().sort_values(KEYS)["longest_run"].reset_index(drop=True)
    assert (by_ids == wanted).all() and (by_pieces == wanted).all()


def events(flags, cooldown):
    count, free = 0, 0
    for at, flag in enumerate(flags):
        if flag and at >= free:
            count, free = count + 1, at + cooldown
    return count


@pytest.mark.parametrize("cooldown", [1, 5, 9])
def test_cooldown(readings, frame, layout, cooldown):
    wanted = frame.assign(f=frame["value"] > 30).groupby(KEYS)["f"].apply(lambda f: events(f, cooldown)).reset_index(drop=True)
    out = windows.cooldown_counts(readings, F.col("value") > 30, cooldown).toPandas().sort_values(KEYS)["events"].reset_index(drop=True)
    assert (out == wanted).all()


def test_default_detector(readings, frame, layout):
    """Counts, runs and the gate against a pandas loop over the series."""
    out = detectors.sigma_runs(readings, z=1.5, width_days=10, min_points=5, recent_hours=240, gate=False).toPandas().sort_values(KEYS).reset_index(drop=True)
    end = frame["time"].max()
    for row in out.itertuples():
        series = frame[(frame["unit"] == row.unit) & (frame["tag"] == row.tag)].set_index("time")["value"]
        rolled = series.rolling("10D", min_periods=5)
        flag = ((series - rolled.mean()) / rolled.std()).abs() >= 1.5
        recent = flag[flag.index >= end - np.timedelta64(240, "h")]
        assert (row.count, row.last_24h, row.longest_run) == (flag.sum(), recent.sum(), longest(recent)), row


def test_partitions_do_not_matter(spark, readings):
    one, many = (detectors.sigma_runs(readings.repartition(n), gate=False).toPandas().sort_values(KEYS).reset_index(drop=True) for n in (1, 8))
    assert list(one["count"]) == list(many["count"]) and list(one["confidence"]) == list(many["confidence"])
