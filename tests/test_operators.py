"""Quantiles, time joins, golden scoring cases, forest properties, dedup laws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantspark.functions import scoring
from plantspark.operators import blocks, dedup, detectors, forest, health, multivariate, quantiles

KEYS = ["plant", "unit", "tag"]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(readings, frame, layout, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "GRID", 10)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 4.0 / accuracy)
    wanted = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    out = quantiles.grouped_quantiles(readings, KEYS, "value", wanted).toPandas().sort_values(KEYS).reset_index(drop=True)
    for name, q in wanted.items():
        np.testing.assert_allclose(out[name], frame.groupby(KEYS)["value"].quantile(q).to_numpy(), rtol=1e-12)


def test_quantiles_with_ties(spark):
    df = spark.createDataFrame([("g", float(i % 3)) for i in range(1000)] + [("h", 5.0)], "g string, v double")
    out = {r["g"]: (r["q1"], r["m"]) for r in quantiles.grouped_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5}).collect()}
    assert out == {"g": (0.0, 1.0), "h": (5.0, 5.0)}


def test_nearest_in_time_equals_pandas(readings, frame):
    speed = readings.where("tag = 'click'").select("plant", "unit", "time", "value")
    out = blocks.nearest_in_time(readings.where("tag <> 'click'"), speed, "near", tolerance_micros=3_600_000_000).toPandas()
    for (plant, unit), group in out.groupby(["plant", "unit"]):
        right = frame[(frame["unit"] == unit) & (frame["tag"] == "click")][["time", "value"]].rename(columns={"value": "want"})
        merged = pd.merge_asof(group.sort_values("time"), right.sort_values("time"), on="time", direction="nearest", tolerance=pd.Timedelta("1h"))
        assert merged["near"].equals(merged["want"])


def test_around_equals_brute_force(readings, frame):
    out = blocks.around(readings, readings, "near", reach_micros=12 * 3_600_000_000, keys=KEYS).toPandas()
    assert len(out) == len(frame)
    for row in out.sample(60, random_state=3).itertuples():
        series = frame[(frame["unit"] == row.unit) & (frame["tag"] == row.tag)]
        near = series[(series["time"] - row.time).abs() <= pd.Timedelta("12h")]["value"]
        assert row.near_n == len(near) and row.near_mean == pytest.approx(near.mean())
        assert len(near) < 2 or row.near_std == pytest.approx(near.std(), abs=1e-9)


CONFIDENCE_CASES = [
    (10, 10, 10, 10, "CRITICAL", 100, "VERY_HIGH", True),
    (10, 10, 0, 0, "HIGH", 70, "HIGH", False),
    (5, 0, 5, 0, "CRITICAL", 30, "LOW", False),
    (10, 5, 10, 3, "HIGH", 78, "HIGH", True),
    (2, 0, 1, 1, "CRITICAL", 11, "LOW", False),
    (10, 4, 3, 2, "CRITICAL", 60, "HIGH", True),
]


def test_confidence_cases(spark):
    df = spark.createDataFrame(CONFIDENCE_CASES, "s int, a int, m int, f int, p string, score int, level string, alert boolean")
    counts = [F.col(c) for c in "samf"]
    score = scoring.confidence_score(*counts)
    gate = scoring.alert_gate(F.col("p"), F.lit(1), score, *counts)
    for row in df.withColumns({"_s": score, "_l": scoring.confidence_level(score), "_g": gate}).collect():
        assert (row["_s"], row["_l"], row["_g"]) == (row["score"], row["level"], row["alert"])


RECENCY_CASES = [
    ("CRITICAL", 5, 8, 5, 6, 4, "HIGH", True),
    ("HIGH", 3, 10, 8, 7, 6, "HIGH", True),
    ("MEDIUM", 10, 15, 10, 12, 8, "HIGH", False),
    ("CRITICAL", 0, 35, 30, 25, 20, "HIGH", False),
    ("CRITICAL", 10, 10, 0, 0, 0, "LOW", False),
]


def test_recency_gate_cases(spark):
    df = spark.createDataFrame(RECENCY_CASES, "p string, d int, s int, a int, m int, f int, level string, alert boolean")
    counts = [F.col(c) for c in "samf"]
    gate = scoring.alert_gate(F.col("p"), F.col("d"), scoring.confidence_score(*counts), *counts)
    assert all(r["g"] == r["alert"] for r in df.withColumn("g", gate).collect())


def test_freshness_classes(spark):
    rows = [("A", f"2024-01-31 {22 + i // 60:02d}:{i % 60:02d}:00") for i in range(100)]
    rows += [("B", f"2024-01-28 {i % 24:02d}:00:00") for i in range(24)] + [("C", "2024-01-25 00:00:00")]
    df = spark.createDataFrame(rows, "tag string, time string").select(
        F.lit("P").alias("plant"), F.lit("U").alias("unit"), "tag", F.to_timestamp("time").alias("time"), F.lit(1.0).alias("value")
    )
    levels = {r["tag"]: r["level"] for r in health.tag_freshness(df, as_of="2024-02-01 00:00:00").collect()}
    assert levels == {"A": "FRESH", "B": "STALE", "C": "STALE"}


def test_dedup_laws(readings):
    doubled = readings.unionByName(readings.withColumn("value", F.col("value") + 1).withColumn("seq", F.col("seq") + 1_000_000))
    once = dedup.keep_last(doubled)
    assert once.count() == readings.count() == dedup.keep_last(once).count()
    assert dedup.keep_first(doubled).exceptAll(readings.select(*dedup.keep_first(doubled).columns)).isEmpty()
    assert dedup.insert_or_ignore(readings, doubled).count() == readings.count()
    merged = dedup.merge_new_wins(readings, readings.withColumn("value", F.lit(None).cast("double")))
    assert merged.where("value IS NOT NULL").isEmpty()


def spiky(spark, n=1000):
    """A noisy series with five known spikes."""
    rng = np.random.default_rng(42)
    values = 100 + rng.normal(0, 5, n)
    for at in (100, 250, 400, 600, 800):
        values[at] = 100 + rng.choice([-1, 1]) * rng.uniform(20, 40)
    times = pd.date_range("2024-01-01", periods=n, freq="min")
    frame = pd.DataFrame({"plant": "TEST", "unit": "TEST-01", "tag": "TEST_PROCESS_TAG_PV", "time": times, "value": values})
    return spark.createDataFrame(frame)


def test_forest_properties(spark):
    df = spiky(spark)
    found = forest.outliers(df, contamination=0.02).toPandas().sort_values("time").reset_index(drop=True)
    assert len(found) == 1000 and found["is_outlier"].sum() == 20
    assert all(found["is_outlier"][at] for at in (100, 250, 400, 600, 800))
    again = forest.outliers(df.repartition(5), contamination=0.02).toPandas().sort_values("time").reset_index(drop=True)
    assert found["score"].equals(again["score"])
    scaled = forest.outliers(df.withColumn("value", F.col("value") * 1000 - 7), contamination=0.02).toPandas().sort_values("time").reset_index(drop=True)
    assert (scaled["is_outlier"] == found["is_outlier"]).mean() > 0.995


def test_forest_cut_is_exact_among_ties(spark):
    flat = spark.range(5_003).select(F.lit("P").alias("plant"), F.lit("U").alias("unit"), F.lit("T").alias("tag"), F.timestamp_seconds("id").alias("time"), F.lit(1.0).alias("value"))
    assert forest.outliers(flat, contamination=0.1, trees=20).where("is_outlier").count() == 501


def test_forest_draws_from_the_whole_group(spark):
    n, trees = 100_000, 100
    rows = spark.range(n).withColumn("trees", forest.draws(["id"], F.lit(n), trees, 256, 42)).select("id", F.explode("trees").alias("tree")).toPandas()
    sizes = rows.groupby("tree").size()
    assert len(sizes) == trees and 180 < sizes.min() and sizes.max() < 340
    # Ten equal parts of the group are drawn from alike; a small group goes whole into every tree.
    assert (rows["id"] // (n // 10)).value_counts(normalize=True).between(0.09, 0.11).all()
    few = spark.range(50).withColumn("trees", forest.draws(["id"], F.lit(50), 7, 256, 42)).select(F.size("trees").alias("n"))
    assert {r.n for r in few.collect()} == {7}


def test_forest_shares_agree(spark, monkeypatch):
    df = spiky(spark)
    whole = forest.forest_scores(df, ["value"], trees=20).toPandas().sort_values("time")["score"].to_numpy()
    monkeypatch.setattr(forest, "ROWS_PER_SHARE", 90)
    shared = forest.forest_scores(df, ["value"], trees=20).toPandas().sort_values("time")["score"].to_numpy()
    assert (whole == shared).all()


def test_three_stages_shrink(spark):
    stages = detectors.three_stage(spiky(spark), trees=50).toPandas()
    assert len(stages) >= 5 and set(stages["stage"]) <= {"primary", "primary+mtd", "primary+mtd+isolation_forest"}
    assert (stages["stage"] == "primary+mtd+isolation_forest").sum() >= 3


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.2]])
    rows = [("P", "U", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), [float(x) for x in row]) for i, row in enumerate(data)]
    matrix = spark.createDataFrame(rows, "plant string, unit string, time timestamp, features array<double>")
    out = multivariate.distance_anomalies(matrix, baseline_fraction=0.7).toPandas().sort_values("time")
    base = data[:140]
    d = data - base.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(np.cov(base.T)), d))
    np.testing.assert_allclose(out["distance"], want, rtol=1e-8)
    assert out["threshold"].iloc[0] == pytest.approx(np.quantile(want[:140], 0.99))


def scans(df):
    """File scans in the plan as it is first made, before any exchange is shared."""
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def test_a_sketch_that_misses_is_opened_further(readings, frame, monkeypatch):
    """In hot groups; ``hot`` is said here, as the readings are few."""
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    wanted = {"low": 0.05, "q1": 0.25, "median": 0.5, "top": 0.99}
    monkeypatch.setattr(quantiles, "GRID", 4)
    out = quantiles.grouped_quantiles(readings, KEYS, "value", wanted, hot=True).toPandas().sort_values(KEYS).reset_index(drop=True)
    for name, q in wanted.items():
        np.testing.assert_allclose(out[name], frame.groupby(KEYS)["value"].quantile(q).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("cells", [400, 3])
def test_median_deviation_from_counts(spark, readings, frame, cells):
    rows = readings.select(*KEYS, "value")
    stats, slots = quantiles.distribution(rows, KEYS, "value", {"median": 0.5}, {"mean": F.avg("value")}, cells=cells)
    out = quantiles.deviations(rows, KEYS, "value", stats, slots, counts={"above": F.col("value") > F.col("mean")}).toPandas().sort_values(KEYS).reset_index(drop=True)
    groups = frame.groupby(KEYS)["value"]
    mad = groups.apply(lambda v: (v - v.median()).abs().median())
    np.testing.assert_allclose(out["mad"], mad.to_numpy(), rtol=1e-12)
    far = groups.apply(lambda v: int((0.6745 * (v - v.median()).abs() / (v - v.median()).abs().median() > 3.5).sum()))
    assert list(out["mad_outliers"]) == list(far) and list(out["above"]) == list(groups.apply(lambda v: int((v > v.mean()).sum())))


def test_median_deviation_of_odd_groups(spark):
    groups = {"one": [4.0], "two": [1.0, 9.0], "flat": [3.0] * 50, "ties": [1.0] * 30 + [2.0] * 29 + [50.0], "none": [None, None], "wide": [float(i * i) for i in range(101)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    stats, slots = quantiles.distribution(df, ["g"], "v", {"median": 0.5}, cells=7)
    got = {r.g: (r.median, r.mad) for r in quantiles.deviations(df, ["g"], "v", stats, slots).collect()}
    want = {k: (float(np.median(vs)), float(np.median(np.abs(np.array(vs) - np.median(vs))))) for k, vs in groups.items() if vs[0] is not None}
    assert got == want


def test_statistics_take_few_scans(spark):
    from plantspark.operators import baseline, incidents, validation
    from plantspark.plans.inputs import instruments

    df = instruments(spark, "/root/testdata/sf0.001")
    counts = detectors.candidate_counts(detectors.sigma_candidates(df))
    equipment = spark.createDataFrame([], incidents.EQUIPMENT)
    plans = {
        "T32": validation.statistical_check(df), "T35": validation.combined_verdict(df), "M1": baseline.tune(df),
        "T31": incidents.incident_report(df, counts, equipment, hours_back=24 * 365, top=3),
    }
    for name, plan in plans.items():
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert scans(plan) <= 8, name
        assert "SinglePartition" not in text.replace("SinglePartition, REPARTITION", ""), name


def test_speed_aware_reports_take_few_scans(spark):
    from plantspark.plans import QUERIES

    for name, most in (("T21_speed_aware", 8), ("T22_speed_aware_report", 12)):
        assert scans(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most, name
