"""Series as runs: a stray reading far away costs rows by the readings, not by the time between."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantspark.operators import aggregates, detectors, multivariate, quantiles

KEYS = ["plant", "unit", "tag"]
SCHEMA = "plant string, unit string, tag string, time timestamp, value double"


@pytest.fixture(scope="module")
def gappy(spark):
    """Two units with hours missing, one pause of 300 hours, and one reading of 1970 in the second."""
    rng = np.random.default_rng(8)
    start, rows = datetime(2024, 1, 1), []
    for unit in ("A", "B"):
        for tag, level in (("S-SPEED", 50.0), ("T1", 10.0), ("T2", 200.0)):
            for hour in range(500):
                if 120 <= hour < 420 or rng.random() < 0.3:
                    continue
                rows.append(("P", unit, tag, start + timedelta(hours=hour, minutes=int(rng.integers(0, 60))), float(level + rng.normal() * 5 + 30 * (rng.random() < 0.05))))
    rows.append(("P", "B", "T1", datetime(1970, 1, 1, 5), 11.0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_rows_follow_the_readings(gappy):
    grid = detectors.on_grid(gappy, 60)
    n = grid.count()
    steps = gappy.select("unit", aggregates.bucket(60).alias("b")).distinct().count()
    assert n == 3 * steps
    total = grid.where("unit = 'B'").groupBy("tag").agg(F.sum("buckets").alias("n")).collect()
    assert {r.n for r in total} == {int((datetime(2024, 1, 21, 19) - datetime(1970, 1, 1, 5)).total_seconds() // 3600) + 1}
    assert detectors.on_grid(gappy, 60, longest=28).count() <= 28 * n
    assert aggregates.resample_runs(gappy, 60).count() == aggregates.resample(gappy, 60).count()


def test_filled_resample_equals_pandas(gappy):
    df = gappy.where("unit = 'A'")
    out = aggregates.resample_filled(df, 60).toPandas().sort_values([*KEYS, "bucket"]).reset_index(drop=True)
    frame = df.toPandas().set_index("time")
    want = pd.concat({k: g["value"].resample("1h").mean().ffill() for k, g in frame.groupby(KEYS)}, names=KEYS).reset_index()
    assert list(out["bucket"]) == list(want["time"])
    np.testing.assert_allclose(out["value"], want["value"], rtol=1e-12)


def filled(df, unit):
    frame = df.where(F.col("unit") == unit).toPandas()
    frame["time"] = frame["time"].dt.floor("1h")
    wide = frame.pivot_table(index="time", columns="tag", values="value", aggfunc="mean").asfreq("1h")
    return wide.ffill()


def test_trends_equal_the_whole_grid(gappy):
    out = multivariate.trends(gappy).where("unit = 'A'").toPandas().set_index("tag")
    wide = filled(gappy, "A").bfill()
    for tag in wide.columns:
        v = wide[tag].to_numpy()
        want = [len(v), v.mean(), v.std(ddof=1), v.min(), v.max(), np.polyfit(np.arange(len(v)), v, 1)[0], v.std(), *np.quantile(v, [0.25, 0.75])]
        np.testing.assert_allclose(out.loc[tag, ["n", "mean", "std", "min", "max", "slope", "volatility", "q25", "q75"]].to_numpy(dtype=float), want, rtol=1e-9)


def test_trends_with_a_reading_of_1970(gappy):
    out = multivariate.trends(gappy).where("unit = 'B'").toPandas().set_index("tag")
    assert (out["n"] > 400_000).all() and out.loc["T1", "q25"] == 11.0 and abs(out.loc["T1", "mean"] - 11.0) < 0.1


def test_breakouts_need_a_gap_only_as_long_as_their_frames(gappy, monkeypatch):
    df = gappy.where("unit = 'A' OR time > timestamp '2000-01-01'")
    ranges = df.select("plant", "unit").distinct().withColumns({"speed_low": F.lit(40.0), "speed_high": F.lit(60.0)})
    options = {"rows": 8, "minutes": 60}
    rows = lambda out: sorted(map(tuple, out.collect()))
    since = F.lit(datetime(2024, 1, 5)).cast("timestamp")
    short = [rows(detectors.breakouts(df, "S-SPEED", ranges, **options, **more)) for more in ({}, {"since": since})]
    grid = detectors.on_grid
    monkeypatch.setattr(detectors, "on_grid", lambda *a, longest=1, **k: grid(*a, longest=10**6, **k))
    assert short == [rows(detectors.breakouts(df, "S-SPEED", ranges, **options, **more)) for more in ({}, {"since": since})]
    assert short[0] and short[0] != short[1]


def test_models_on_runs_equal_models_on_buckets(gappy):
    df = gappy.where("time > timestamp '2000-01-01'")
    runs = multivariate.feature_matrix(df)
    every = aggregates.expanded(runs, 60).withColumn("buckets", F.lit(1).cast("long"))
    assert runs.count() < every.count()
    for options in ({}, {"baseline_fraction": 0.5, "quantile": 0.9}, {"robust": True}):
        a, b = (sorted(map(tuple, multivariate.anomaly_rates(multivariate.distance_anomalies(m, **options)).collect())) for m in (runs, every))
        assert a == b
    errors = [multivariate.reconstruction_anomalies(m, 1).agg(F.max("threshold"), F.sum(F.when(F.col("is_anomaly"), F.col("buckets")))).first() for m in (runs, every)]
    assert errors[0][0] == pytest.approx(errors[1][0]) and errors[0][1] == errors[1][1]


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=900).round(2), rng.integers(0, 40, 900)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(v, w, strict=True)] + [("h", 1.0, 10**9), ("h", 2.0, 1)], "g string, v double, w long")
    out = {r.g: r for r in quantiles.grouped_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.999}, weight="w").collect()}
    want = np.quantile(np.repeat(v, w), [0.01, 0.5, 0.999])
    np.testing.assert_allclose([out["g"].a, out["g"].b, out["g"].c], want, rtol=1e-12)
    assert out["g"].n == w.sum() and out["h"].c == 1.0
