"""Daily volumes of a stream are those of the table, once the watermark has passed."""

import datetime

from pyspark.sql import functions as F

from plumbline.streaming import volume

SCHEMA = "at timestamp, kind string, x int"


def events(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def day(n, hour=12):
    return datetime.datetime(2024, 1, n, hour)


def got(spark, path):
    return sorted((r.day.day, r.kind or "", r.rows, r.first_at.hour, r.newest.hour) for r in spark.read.parquet(path).collect())


def test_days_are_written_once_and_late_events_counted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    events(spark, source, [(day(1, 3), "a", 1), (day(1, 9), "a", 1), (day(1), None, 1), (day(2), "a", 1), (None, "a", 1)])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    run = lambda: volume.write_daily_volume(stream(), "at", out, checkpoint, ["kind"], "12 hours")
    assert run().late == 0
    assert got(spark, out) == [(1, "", 1, 12, 12), (1, "a", 2, 3, 9)]
    events(spark, source, [(day(2, 15), "a", 1), (day(4), "b", 1), (day(3), "a", 1)])
    run()
    assert got(spark, out)[2:] == [(2, "a", 2, 12, 15), (3, "a", 1, 12, 12)]
    events(spark, source, [(day(1, 23), "a", 1), (day(6), "a", 1)])
    assert run().late == 1
    want = [(1, "", 1, 12, 12), (1, "a", 2, 3, 9), (2, "a", 2, 12, 15), (3, "a", 1, 12, 12), (4, "b", 1, 12, 12)]
    assert got(spark, out) == want
    run()  # a restart reads nothing twice
    assert got(spark, out) == want


def test_stream_is_batch_below_the_watermark(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "events")
    for low, high in ((1, 9), (9, 10), (10, 40)):  # files arrive in the order of their days
        of = F.date_diff(F.col("ts").cast("date"), F.lit("2023-12-31").cast("date"))
        batch.where((of >= low) & (of < high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    done = volume.write_daily_volume(stream, "ts", out, str(tmp_path / "checkpoint"), ["event_type"], "1 day")
    whole = volume.daily_volume(batch, "ts", ["event_type"])
    assert done.late == 0
    found = spark.read.parquet(out)
    last = found.agg({"day": "max"}).first()[0]
    assert found.exceptAll(whole).isEmpty() and whole.where(whole["day"] <= last).exceptAll(found).isEmpty()
    assert last >= whole.agg({"day": "max"}).first()[0] - datetime.timedelta(days=2)


def test_no_events(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events(spark, source, [])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    done = volume.write_daily_volume(stream, "at", out, str(tmp_path / "checkpoint"))
    assert done.late == 0 and spark.read.schema("day date, rows bigint").parquet(out).count() == 0
