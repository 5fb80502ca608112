"""Files and streams: what is written comes back, a stream equals its batch."""

import json

from pyspark.sql import functions as F

from plantspark.operators import aggregates
from plantspark.sources import readers, writers
from plantspark.streaming import pipelines

KEYS = ["plant", "unit", "tag"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_append_aligns_to_the_stored_schema(spark, readings, tmp_path):
    path = str(tmp_path / "store")
    writers.replace(readings.select(*KEYS, "time", "value").withColumn("quality", F.lit("good")), path)
    writers.append(readings.limit(5).withColumn("extra", F.lit(1)), path)
    stored = spark.read.parquet(path)
    assert stored.columns == [*KEYS, "time", "value", "quality"]
    assert stored.where("quality IS NULL").count() == 5


def test_dataset_prunes_partitions(spark, readings, tmp_path):
    path = str(tmp_path / "dataset")
    writers.write_dataset(readings, path, by_tag=True)
    one = spark.read.parquet(path).where("unit = 'U-1' AND tag = 'click'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "unit#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == readings.where("unit = 'U-1' AND tag = 'click'").count()


def test_wide_csv_round_trip(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("TIME,PLANT1 K-31-01 ST_PERFORMANCE,note\n2024-01-01 00:00:00,1.5,x\n2024-01-01 00:06:00,bad,2\nbroken,3,4\n")
    wide = spark.read.csv(str(path), header=True)
    tidy = readers.tidy(readers.resolve_times(wide.withColumnRenamed("TIME", "time"))).orderBy("header", "time").collect()
    assert [(r["plant"], r["unit"], r["tag"], r["value"]) for r in tidy] == [("PLANT1", "K-31-01", "ST_PERFORMANCE", 1.5), (None, None, "note", 2.0)]


def test_marks_and_limits_files(spark, tmp_path):
    (tmp_path / "marks.csv").write_text("timestamp\n2024-01-01 00:00:00\nnot a time\n2024-01-01 00:00:00\n")
    assert readers.marked_times(spark, str(tmp_path / "marks.csv")).count() == 1
    document = {"unit": "U", "tag_configurations": {"a": {"thresholds": {"upper_limit": 2.0, "lower_limit": 1.0}}, "b": {"thresholds": {"upper_limit": 2.0}}}}
    (tmp_path / "limits.json").write_text(json.dumps(document, indent=2))
    assert [tuple(r)[:5] for r in readers.limits_from_json(spark, str(tmp_path / "limits.json")).collect()] == [("U", "a", 1.0, 2.0, 2.5)]


def test_inventory_of_files(spark, readings, tmp_path):
    path = str(tmp_path / "files")
    writers.replace(readings.repartition(3), path)
    files = readers.file_inventory(spark, path).collect()
    assert len(files) == 3 and sum(f["records"] for f in files) == readings.count()


def test_stream_resample_equals_batch(spark, readings, tmp_path):
    source = str(tmp_path / "in")
    readings.select(*KEYS, "time", "value", "seq").repartitionByRange(4, "time").sortWithinPartitions("time").write.parquet(source)
    stream = pipelines.resampled(pipelines.read_stream(spark, source, files_per_batch=1), "1 hour", "40 days")
    target, name = pipelines.scratch(spark, "test-resample")
    pipelines.run_available(stream, target, name)
    # With a watermark longer than the data nothing is closed in append mode ...
    assert spark.read.schema("plant string").parquet(target).count() == 0
    stream = pipelines.resampled(pipelines.read_stream(spark, source), "1 hour", "0 seconds")
    target, name = pipelines.scratch(spark, "test-resample")
    got = spark.read.parquet(pipelines.run_available(stream, target, name)).select(*KEYS, "bucket", F.round("value", 9).alias("value"))
    end = readings.select(F.max("time")).first()[0].replace(minute=0, second=0, microsecond=0)
    want = aggregates.resample(readings, 60).where(F.col("bucket") < F.lit(end)).select(*KEYS, "bucket", F.round("value", 9).alias("value"))
    assert rows(got) == rows(want)


def test_restarted_ingest_reads_only_new_files(spark, readings, tmp_path):
    base = str(tmp_path)
    _, name = pipelines.scratch(spark, "test-ingest")
    r = readings.select(*KEYS, "time", "value", "seq")
    r.where("seq % 2 = 0").write.parquet(f"{base}/in")
    pipelines.ingest_new_files(spark, f"{base}/in", f"{base}/out", name)
    r.where("seq % 2 = 1 OR seq = 0").withColumn("value", F.col("value") + 1).write.mode("append").parquet(f"{base}/in")
    pipelines.ingest_new_files(spark, f"{base}/in", f"{base}/out", name)
    pipelines.ingest_new_files(spark, f"{base}/in", f"{base}/out", name)
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == r.count()
    assert out.where("seq = 0").first()["value"] == r.where("seq = 0").first()["value"] + 1


def test_merge_reads_only_touched_folders(spark, readings, tmp_path):
    path = str(tmp_path / "dataset")
    r = readings.select(*KEYS, "time", "value", "seq")
    months = [r.withColumn("time", F.col("time") + F.make_dt_interval(F.lit(31 * m))).withColumn("seq", F.col("seq") + 1000 * m) for m in range(3)]
    for m in months:
        pipelines.merge_into_dataset(m, path, str(tmp_path / "staging"))
    before = {f.path: f.modificationTime for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime").collect()}
    late = months[1].where("unit = 'U-1'").withColumn("value", F.col("value") + 1)
    folders = pipelines.folders_of(late)
    plan = spark.read.parquet(path).where(writers.in_folders(folders))._jdf.queryExecution().executedPlan().toString()
    assert "concat_ws" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    pipelines.merge_into_dataset(late, path, str(tmp_path / "staging"))
    after = {f.path: f.modificationTime for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime").collect()}
    gone = {p.split("dataset/")[1].rsplit("/", 1)[0] for p in before.keys() - after.keys()}
    assert gone == {f"plant={f.plant}/unit={f.unit}/year={f.year}/month={f.month}" for f in folders}
    stored = spark.read.parquet(path)
    assert stored.count() == sum(m.select(*KEYS, "time").distinct().count() for m in months)
    changed = stored.join(late.select(*KEYS, "time", F.col("value").alias("new")), [*KEYS, "time"])
    assert changed.where("value <> new").count() == 0 and changed.count() > 0


def test_run_counter_agrees_for_any_batches(spark, readings, tmp_path):
    answers = []
    for files in (1, 4):
        source = str(tmp_path / f"in{files}")
        for k in range(files):
            part = readings.where(F.floor((F.unix_timestamp("time") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (86400 * 30 / files)) == k)
            part.select(*KEYS, "time", "value", "seq").coalesce(1).write.mode("append").parquet(source)
        target, name = pipelines.scratch(spark, "test-runs")
        stream = pipelines.run_counter(pipelines.read_stream(spark, source, files_per_batch=1), z=1.0, min_points=5)
        out = spark.read.parquet(pipelines.run_available(stream, target, name))
        answers.append(rows(out.groupBy(*KEYS).agg(F.max_by(F.struct("rows", "flagged", "run", "longest_run"), "rows"))))
    assert answers[0] == answers[1] and max(r[3]["longest_run"] for r in answers[0]) > 1


def test_arrivals_come_in_bounded_files_and_batches(spark, monkeypatch):
    from plantspark.plans import streams

    monkeypatch.setattr(streams, "BATCH_ROWS", 200)
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    before, seen = None, 0
    for folder in streams.arrivals(spark, "/root/testdata/sf0.001", late=False):
        stored = spark.read.parquet(folder)
        new = stored if before is None else stored.where(F.col("time") > before)
        count, low, high = new.agg(F.count("*"), F.min("time"), F.max("time")).first()
        assert 0 < count <= 250 and (before is None or low > before)
        assert stored.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0] <= 50
        before, seen = high, seen + count
    assert seen == stored.count() == streams.readings(spark, "/root/testdata/sf0.001").count()


def test_inventory_writes_many_files_of_a_plant(spark, monkeypatch):
    from plantspark.plans import catalog

    paths, scratch = [], pipelines.scratch
    monkeypatch.setattr(pipelines, "scratch", lambda *a: (paths.append(scratch(*a)), paths[-1])[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on a table that is not tiny
    try:
        made = catalog.inventory(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    records = sum(r.records for r in made)
    stored = spark.read.parquet(paths[0][0])
    per_plant = stored.select("plant", F.input_file_name().alias("name")).distinct().groupBy("plant").agg(F.count("*").alias("n")).collect()
    assert records == stored.count() and min(r.n for r in per_plant) > 1


def test_a_batch_is_bounded_by_default(spark, readings, tmp_path):
    source, sizes = str(tmp_path / "many"), []
    readings.limit(40).repartition(40).write.parquet(source)
    pipelines.each_batch(pipelines.read_stream(spark, source), tmp_path.name, lambda batch, _: sizes.append(batch.count()))
    assert len(sizes) > 1 and sum(sizes) == 40
