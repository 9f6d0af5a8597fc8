import datetime as dt

import pytest

from sigframe.streaming import jobs

SCHEMA = "file string, ts timestamp, value double"


def event(file, seconds, value):
    return file, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds), value


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return path

    return add


def values(df):
    return sorted(
        ((r["file"], r["window_start"].second + 60 * r["window_start"].minute, r["n"], round(r["mean"], 9)) for r in df.collect()),
        key=str,
    )


def test_append_equals_batch_but_for_open_windows(spark, folder):
    path = folder([event("a" if i % 2 else "b", i / 4, float(i)) for i in range(200)])
    batch = jobs.stream_bucket_features(spark.read.schema(SCHEMA).parquet(path), ["file"], "value")
    stream = jobs.stream_files(spark, path, SCHEMA)
    found = jobs.drained(jobs.stream_bucket_features(stream, ["file"], "value", watermark="0 seconds"), "t")
    want = [v for v in values(batch) if v[1] + 5 <= 199 / 4]
    assert values(found) == want and len(values(batch)) == 20


def test_complete_equals_batch(spark, folder):
    path = folder([event("a", i / 4, float(i)) for i in range(100)])
    batch = jobs.stream_clips(spark.read.schema(SCHEMA).parquet(path), ["file"], "value")
    stream = jobs.stream_clips(jobs.stream_files(spark, path, SCHEMA), ["file"], "value")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("clips_out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("clips_out")) == values(batch)


def test_second_run_reads_new_files_only(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    path = folder([event("a", 1, 1.0), event("a", 2, 2.0)])
    jobs.drain(jobs.stream_files(spark, path, SCHEMA), out, checkpoint)
    jobs.drain(jobs.stream_files(spark, path, SCHEMA), out, checkpoint)
    assert spark.read.parquet(out).count() == 2
    folder([event("b", 3, 3.0)])
    jobs.drain(jobs.stream_files(spark, path, SCHEMA), out, checkpoint)
    assert sorted(r["file"] for r in spark.read.parquet(out).collect()) == ["a", "a", "b"]


def test_late_rows_are_dropped_after_the_watermark(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    path = folder([event("a", 1, 1.0), event("a", 100, 1.0)])

    def run():
        stream = jobs.stream_files(spark, path, SCHEMA)
        jobs.drain(jobs.stream_bucket_features(stream, ["file"], "value", watermark="10 seconds"), out, checkpoint)

    run()
    folder([event("a", 2, 99.0), event("a", 200, 1.0)])
    run()
    found = {r["window_start"].minute * 60 + r["window_start"].second: r["n"] for r in spark.read.parquet(out).collect()}
    assert found == {0: 1, 100: 1}


def test_vector_windows_equal_batch(spark, tmp_path):
    schema = "file string, ts timestamp, mfcc array<double>"
    rows = [event("ab"[i % 2], i / 4, [float(i), float(i * i % 7)]) for i in range(120)]
    rows.append(event("a", 1, None))
    path = str(tmp_path / "vec")
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
    batch = jobs.stream_bucket_features(spark.read.schema(schema).parquet(path), ["file"], "mfcc")
    stream = jobs.stream_bucket_features(
        jobs.stream_files(spark, path, schema), ["file"], "mfcc", watermark="0 seconds"
    )
    found = {(r["file"], r["window_start"]): r for r in jobs.drained(stream, "vec").collect()}
    want = {(r["file"], r["window_start"]): r for r in batch.collect()}
    last = max(k[1] for k in want)
    assert found.keys() == {k for k in want if k[1] < last}
    for k, r in found.items():
        assert r["n"] == want[k]["n"] and r["stats"] == pytest.approx(want[k]["stats"])


@pytest.mark.parametrize("per_batch", [1, 100])
def test_no_row_is_lost_whatever_the_batches(spark, tmp_path, per_batch):
    """Four hourly files, the oldest hour last; the last windows are still open."""
    path = str(tmp_path / "hours")
    for hour in (1, 2, 3, 0):
        rows = [event("ab"[i % 2], 3600 * hour + 60 * i, float(i * i % 17)) for i in range(50)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_files(spark, path, SCHEMA, files_per_trigger=per_batch)
    window = jobs.window_of("ts", 3600, 1800)
    found = jobs.windows_so_far(stream, ["file"], window, "value", "hours").collect()
    batch = jobs.stream_clips(spark.read.schema(SCHEMA).parquet(path), ["file"], "value", length=3600, step=1800)
    want = {(r["file"], r["window_start"]): r for r in batch.collect()}
    assert sum(r["n"] for r in found) == 2 * 200 and len(found) == len(want)
    for r in found:
        w = want[r["file"], r["window_start"]]
        assert (r["n"], r["low"], r["high"]) == (w["n"], w["low"], w["high"])
        assert r["mean"][0] == pytest.approx(w["mean"]) and r["std"][0] == pytest.approx(w["std"])


def test_vector_windows_of_many_batches(spark, tmp_path):
    schema = "file string, ts timestamp, mfcc array<double>"
    path = str(tmp_path / "vec")
    for k in range(3):
        rows = [event("a", i, [float(i * k), float(i + k)]) for i in range(30)] + [event(None, 1, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_files(spark, path, schema, files_per_trigger=1)
    found = jobs.windows_so_far(stream, ["file"], jobs.window_of("ts", 10), "mfcc", "vec").collect()
    batch = jobs.stream_bucket_features(spark.read.schema(schema).parquet(path), ["file"], "mfcc", seconds=10)
    want = {(r["file"], r["window_start"]): r for r in batch.collect()}
    assert len(found) == len(want) == 3
    for r in found:
        assert r["mean"] + r["std"] == pytest.approx(want[r["file"], r["window_start"]]["stats"])
