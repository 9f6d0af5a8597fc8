import json
import os

import pytest
from pyspark.sql import functions as F

from sigframe import catalog
from sigframe.runtime import durable, scratch_path, shared_dir
from sigframe.sources import scans, sinks


@pytest.fixture
def rows(frame):
    return frame([(i, f"f{i % 5}", i % 3, i / 2) for i in range(60)], "id int, file string, part int, v double")


def test_partition_pruning(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_partitioned(rows, path, ["part"], spread=2)
    found = scans.scan_partitioned(spark, path).where("part < 2").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert found.count() == 40
    assert all(len([f for f in os.listdir(f"{path}/part={p}") if f.endswith(".parquet")]) <= 2 for p in range(3))


def test_pushdown_and_pruning_reach_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    found = scans.lookup_by_key(scans.scan_columns(spark, str(tmp_path / "t"), ["file", "v"]), "file", "f1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file,f1)" in plan and "ReadSchema: struct<file:string,v:double>" in plan
    assert found.count() == 12


def test_features_file_count(spark, rows, tmp_path):
    path = str(tmp_path / "f")
    sinks.write_features(rows, path, files=4)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 4
    assert sinks.is_complete(spark, path) and not sinks.is_complete(spark, str(tmp_path / "no"))


def test_submission_is_sorted_csv(spark, frame, tmp_path):
    rows = [("x_5", 0.5), ("x_10", 0.25), ("a_5", 1.0)] + [(f"r_{i}", i / 100) for i in range(200)]
    sinks.write_submission(frame(rows, "row_id string, asbfly double").repartition(4), str(tmp_path / "s"))
    lines = []
    for name in sorted(f for f in os.listdir(tmp_path / "s") if f.endswith(".csv")):
        header, *body = open(tmp_path / "s" / name).read().split()
        assert header == "row_id,asbfly"
        lines += body
    assert lines == [f"{k},{v}" for k, v in sorted(rows)]
    assert scans.scan_csv(spark, str(tmp_path / "s")).count() == len(rows)


def test_csv_is_all_strings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("primary_label,secondary_labels,rating\nasbfly,\"['a', 'b']\",4.5\nx,[],\n")
    df = scans.scan_csv(spark, str(tmp_path / "m.csv"))
    assert {t for _, t in df.dtypes} == {"string"}
    items = [r[0] for r in df.select(scans.parse_list("secondary_labels")).collect()]
    assert items == [["a", "b"], []]


def test_classes_below_a_relative_root(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "1.ogg").write_text("x")
    root = os.path.relpath(tmp_path / "in")
    assert [r["class"] for r in scans.list_files_by_class(spark, root, "*.ogg").collect()] == ["a"]


def test_files_and_classes(spark, tmp_path):
    for name in ("root.ogg", "a/1.ogg", "a/deep/2.ogg", "b/3.ogg", "b/skip.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("xy")
    files = scans.list_files(spark, str(tmp_path), "*.ogg")
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in files.collect()) == ["a/1.ogg", "a/deep/2.ogg", "b/3.ogg", "root.ogg"]
    flat = scans.list_files(spark, str(tmp_path), "*.ogg", recursive=False)
    assert [r["length"] for r in flat.collect()] == [2]
    classes = scans.list_files_by_class(spark, str(tmp_path), "*.ogg")
    assert sorted((r["class"], os.path.basename(r["path"])) for r in classes.collect()) == [("a", "1.ogg"), ("a", "2.ogg"), ("b", "3.ogg")]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_label_map(spark, frame, tmp_path):
    sinks.save_label_map(frame([("b", 1), ("a", 0)], "label string, idx int"), str(tmp_path / "l"))
    want = {"a": 0, "b": 1}
    assert {r["label"]: r["idx"] for r in scans.load_label_map(spark, str(tmp_path / "l")).collect()} == want
    (tmp_path / "one.json").write_text(json.dumps(want, indent=2))
    loaded = scans.load_label_map(spark, str(tmp_path / "one.json"), multiline=True)
    assert {r["label"]: r["idx"] for r in loaded.collect()} == want


def test_metrics_append(spark, frame, tmp_path):
    path = str(tmp_path / "m")
    runs = frame([(0, "a", 1.5, True), (0, "b", 2.0, False), (1, "c", 1.0, True)], "part int, file string, elapsed double, new boolean")
    for _ in range(2):
        sinks.write_metrics(sinks.run_metrics(runs, new="new"), path)
    rows = scans.scan_json_metrics(spark, path).collect()
    assert sorted((r["part_name"], r["num_files"], r["processed"], r["elapsed"]) for r in rows) == [
        ("part_0000", 2, 1, 3.5)] * 2 + [("part_0001", 1, 1, 1.0)] * 2


def test_resume_with_null_keys(frame):
    todo = frame([("a",), ("b",), (None,)], "file string")
    done = frame([("a",), (None,)], "file string")
    assert [r[0] for r in sinks.resume_incremental(todo, done, ["file"]).collect()] == ["b"]
    assert sinks.resume_incremental(todo, done.where("false"), ["file"]).count() == 3


def test_stamped_runs_replace_only_themselves(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    sinks.write_stamped(rows, path, {"tokenizer": "pca", "window": 40})
    sinks.write_stamped(rows.limit(5), path, {"tokenizer": "pca", "window": 80})
    sinks.write_stamped(rows.limit(7), path, {"tokenizer": "pca", "window": 80})
    counts = {r["window"]: r["count"] for r in scans.scan_partitioned(spark, path).groupBy("window").count().collect()}
    assert counts == {40: 60, 80: 7}


def test_write_two(spark, frame, tmp_path):
    df = frame([("f", 0.0, [1.0], [0.5, 0.5])], "file string, start_time double, embedding array<double>, predictions array<double>")
    sinks.write_two(df, str(tmp_path / "e"), str(tmp_path / "p"), ["file", "start_time"])
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["file", "start_time", "embedding"]
    assert spark.read.parquet(str(tmp_path / "p")).first()["predictions"] == [0.5, 0.5]


def test_schema_table(frame):
    df = frame([], "a int, v array<float>, s struct<x: string, m: map<string, int>>")
    names = [r["name"] for r in scans.inspect_schema(df).collect()]
    assert names == ["a", "v", "v.element", "s", "s.x", "s.m", "s.m.key", "s.m.value"]


def test_durable_tables_lie_in_the_shared_folder(spark, rows):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured.rstrip("/")
    kept = durable(rows.withColumn("r", F.rand(1)))
    assert kept.collect() == kept.collect() and configured in kept.inputFiles()[0]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_collect_is_bounded(spark):
    assert [r[0] for r in sinks.collect_bounded(spark.range(5).orderBy("id"), 5)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="more than 4 rows"):
        sinks.collect_bounded(spark.range(5), 4)


def test_writers_follow_the_bytes(spark, tmp_path):
    """Small directories get one file, a directory with most rows several."""
    rows = spark.range(200_000).selectExpr("id AS `odd ``name`", "if(id < 190000, 0, id % 5) AS part", "uuid() AS body")
    rows = rows.repartition(8)
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advised)
    spark.conf.set(advised, "1m")
    try:
        sinks.write_partitioned(rows, str(tmp_path / "parts"), ["part"])
        sinks.write_features(rows, str(tmp_path / "even"))
    finally:
        spark.conf.set(advised, before)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "parts").glob("part=*")}
    assert files.pop("part=0") > 3 and set(files.values()) == {1} and len(files) == 4
    sizes = [f.stat().st_size for f in (tmp_path / "even").glob("*.parquet")]
    assert len(sizes) > 3 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 200_000


def test_features_query_writes_its_files_at_any_size(spark):
    """Twenty, whether the bytes would ask for one file or for hundreds."""
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advised)
    try:
        for size in (before, "1k"):
            spark.conf.set(advised, size)
            found = catalog.queries()["write_features"](spark, "/root/testdata/sf0.001").collect()
            assert {r["files"] for r in found} == {20}
    finally:
        spark.conf.set(advised, before)
