"""Round trips through the sources and sinks, written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.aggregates import REPORT
from sigframe.catalog.projections import CODES, wide_clips
from sigframe.catalog.registry import CLIPS, FRAMES, clips, frames, query, rounded, table
from sigframe.functions import arrays, paths
from sigframe.operators import vectors
from sigframe.plans import classifier, quantizer
from sigframe.runtime import scratch_path
from sigframe.sources import scans, sinks


@query("scan_vectors", f"""WITH {CLIPS}
SELECT file, start_time, end_time, len(embedding)::INTEGER AS size, round(list_sum(embedding), 6) + 0e0 AS total
FROM clips""")
def scan_vectors(spark, sf):
    path = scratch_path(spark, "wide")
    wide_clips(spark, sf).write.parquet(path)
    packed = scans.scan_vectors(spark, path, size=64)
    return packed.select(
        "file", "start_time", "end_time", F.size("embedding").alias("size"),
        rounded(arrays.array_sum("embedding")).alias("total"),
    )


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_parquet(spark, sf):
    return scans.scan_parquet(spark, f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


@query("scan_columns", "SELECT doc_id, lang, n_chars FROM documents")
def scan_columns(spark, sf):
    return scans.scan_columns(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("scan_partitioned", f"""WITH {FRAMES}
SELECT part::INTEGER AS part, count(*) AS n, count(DISTINCT file) AS files FROM frames WHERE part < 80 GROUP BY part""")
def scan_partitioned(spark, sf):
    path = scratch_path(spark, "parts")
    sinks.write_partitioned(frames(spark, sf).select("file", "timestamp", "part"), path, ["part"])
    found = scans.scan_partitioned(spark, path).where("part < 80")
    return found.groupBy("part").agg(
        F.count("*").alias("n"), F.countDistinct("file").alias("files")
    )


@query("lookup_by_key", "SELECT event_id, ts, value FROM events WHERE user_id = 8")
def lookup_by_key(spark, sf):
    found = scans.lookup_by_key(table(spark, sf, "events"), "user_id", 8)
    return found.select("event_id", "ts", "value")


@query("scan_csv", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    chosen = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    chosen.write.option("header", True).csv(path)
    return scans.scan_csv(spark, path)


@query("parse_list", """
SELECT o_orderkey, 2 AS n, o_orderstatus AS first, o_orderpriority AS second FROM orders""")
def parse_list(spark, sf):
    text = F.format_string("['%s', '%s']", "o_orderstatus", "o_orderpriority")
    items = table(spark, sf, "orders").select("o_orderkey", scans.parse_list(text).alias("items"))
    return items.select(
        "o_orderkey", F.size("items").alias("n"),
        F.get("items", F.lit(0)).alias("first"), F.get("items", F.lit(1)).alias("second"),
    )


@query("write_metrics", f"""WITH {FRAMES}
SELECT printf('part_%04d', part) AS part_name, count(DISTINCT file) AS num_files, round(sum(timestamp), 3) AS elapsed,
       count(DISTINCT file) FILTER (WHERE timestamp > 60) AS processed FROM frames GROUP BY part""")
def write_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    runs = frames(spark, sf).select(
        "part", "file", F.col("timestamp").alias("elapsed"), (F.col("timestamp") > 60).alias("new")
    )
    sinks.write_metrics(sinks.run_metrics(runs, new="new"), path)
    schema = "part_name string, num_files bigint, elapsed double, processed bigint"
    found = scans.scan_json_metrics(spark, path, schema)
    return found.withColumn("elapsed", F.round("elapsed", 3))


@query("scan_json_metrics", """
SELECT event_type AS model, count(*) AS n_parts, round(sum(value), 4) AS elapsed FROM events GROUP BY model""")
def scan_json_metrics(spark, sf):
    path = scratch_path(spark, "json")
    runs = table(spark, sf, "events").select(
        F.concat(F.lit("part_"), "event_id").alias("part_name"), F.col("value").alias("elapsed"),
        F.col("event_type").alias("model"),
    )
    runs.write.json(path)
    return scans.scan_json_metrics(spark, path).groupBy("model").agg(
        F.count("*").alias("n_parts"), F.round(F.sum("elapsed"), 4).alias("elapsed")
    )


def _files_by_type(spark, sf):
    root = scratch_path(spark, "tree")
    sinks.write_partitioned(
        table(spark, sf, "events").select("event_id", "event_type"), root, ["event_type"], spread=2
    )
    return root


@query("list_files", "SELECT DISTINCT concat('event_type=', event_type) AS folder, true AS found FROM events")
def list_files(spark, sf):
    files = scans.list_files(spark, _files_by_type(spark, sf), "*.parquet")
    return files.groupBy(paths.parent_name("path").alias("folder")).agg(
        (F.min("length") > 0).alias("found")
    )


@query("list_files_by_class", "SELECT DISTINCT concat('event_type=', event_type) AS class FROM events")
def list_files_by_class(spark, sf):
    files = scans.list_files_by_class(spark, _files_by_type(spark, sf), "*.parquet")
    return files.select("class").distinct()


@query("inspect_schema", """SELECT count(*) AS n_rows, 'embedding' AS name, 'array<float>' AS type FROM embeddings
UNION ALL SELECT count(*), 'embedding.element', 'float' FROM embeddings
UNION ALL SELECT count(*), 'label', 'int' FROM embeddings
UNION ALL SELECT count(*), 'vec_id', 'bigint' FROM embeddings""")
def inspect_schema(spark, sf):
    data = table(spark, sf, "embeddings")
    rows = data.select(F.count("*")).scalar()
    return scans.inspect_schema(data).select(rows.alias("n_rows"), "name", "type")


@query("from_local", """
SELECT event_type, code, count(*) AS n FROM events
JOIN (VALUES ('click', 0), ('view', 1), ('error', 2)) AS v(event_type, code) USING (event_type) GROUP BY ALL""")
def from_local(spark, sf):
    local = spark.createDataFrame([("click", 0), ("view", 1), ("error", 2)], "event_type string, code int")
    joined = table(spark, sf, "events").join(local, "event_type")
    return joined.groupBy("event_type", "code").agg(F.count("*").alias("n"))


@query("load_label_map", """
SELECT key AS label, sum(value)::BIGINT AS total, count(*) AS n FROM
  (SELECT 'k' AS key, (props::JSON ->> 'k')::INTEGER AS value FROM events) GROUP BY key""")
def load_label_map(spark, sf):
    path = scratch_path(spark, "props")
    table(spark, sf, "events").select("props").write.text(path)
    pairs = scans.load_label_map(spark, path)
    return pairs.groupBy("label").agg(F.sum("idx").alias("total"), F.count("*").alias("n"))


@query("save_label_map", """
SELECT p_brand AS label, (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS idx
FROM (SELECT DISTINCT p_brand FROM part)""")
def save_label_map(spark, sf):
    path = scratch_path(spark, "labels")
    index = classifier.label_index(table(spark, sf, "part"), "p_brand")
    sinks.save_label_map(index, path, "p_brand")
    return scans.load_label_map(spark, path)


@query("sql", """SELECT event_type, count(*) AS n, round(sum(value) / 3600, 6) AS hours
FROM events WHERE event_type LIKE '%i%' GROUP BY event_type""")
def sql(spark, sf):
    return scans.sql(
        spark,
        "SELECT event_type, count(*) AS n, round(sum(value) / 3600, 6) AS hours"
        " FROM {events} WHERE event_type LIKE '%i%' GROUP BY event_type",
        events=table(spark, sf, "events"),
    )


@query("write_features", f"""WITH {FRAMES}
SELECT file, count(*) AS n, round(sum(timestamp), 3) AS total, 20 AS files FROM frames GROUP BY file""")
def write_features(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_features(frames(spark, sf), path, files=20)
    count = scans.list_files(spark, path, "*.parquet").agg(F.count("*").cast("int").alias("c"))
    rows = scans.scan_parquet(spark, path).groupBy("file").agg(
        F.count("*").alias("n"), F.round(F.sum("timestamp"), 3).alias("total")
    )
    return rows.withColumn("files", count.scalar())


@query("write_zstd", "SELECT l_suppkey, count(*) AS n, true AS zstd FROM lineitem GROUP BY l_suppkey")
def write_zstd(spark, sf):
    path = scratch_path(spark, "zstd")
    sinks.write_zstd(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), path)
    named = scans.list_files(spark, path, "*.parquet").agg(
        F.bool_and(F.col("path").contains(".zstd.")).alias("z")
    )
    counts = scans.scan_parquet(spark, path).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counts.withColumn("zstd", named.scalar())


@query("write_partitioned", """SELECT l_shipdate, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM lineitem GROUP BY ALL""")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "flags")
    chosen = table(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", "l_quantity")
    sinks.write_partitioned(chosen, path, ["l_returnflag"])
    return scans.scan_partitioned(spark, path).groupBy("l_shipdate", "l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total")
    )


@query("write_two", f"""WITH {CLIPS}
SELECT file, start_time, i::INTEGER AS pos, round(embedding[i + 1], 6) AS e, round(embedding[64 - i], 6) AS p
FROM clips, range(64) AS t(i)""")
def write_two(spark, sf):
    path = scratch_path(spark, "two")
    data = clips(spark, sf).withColumn("predictions", F.reverse("embedding"))
    keys = ["file", "start_time"]
    sinks.write_two(data, f"{path}/embed", f"{path}/predict", keys)
    both = scans.scan_parquet(spark, f"{path}/embed").join(
        scans.scan_parquet(spark, f"{path}/predict"), keys
    )
    long = both.select(*keys, F.posexplode(F.arrays_zip("embedding", "predictions")).alias("pos", "x"))
    places = {"e": "x.embedding", "p": "x.predictions"}
    return long.select(*keys, "pos", *[F.round(F.col(c).cast("double"), 6).alias(n) for n, c in places.items()])


@query("write_submission", "SELECT concat('f', vec_id, '_', (vec_id % 12 + 1) * 5) AS row_id, " + ", ".join(
    f"round(embedding[{i + 1}]::DOUBLE, 6) AS {c}" for c, i in CODES.items()) + " FROM embeddings")
def write_submission(spark, sf):
    path = scratch_path(spark, "submission")
    named = table(spark, sf, "embeddings").withColumn(
        "row_id", F.concat(F.lit("f"), "vec_id", F.lit("_"), (F.col("vec_id") % 12 + 1) * 5)
    ).withColumn("embedding", F.col("embedding").cast("array<double>"))
    wide = vectors.unpack_predictions(named, "embedding", CODES, keep=["row_id"])
    sinks.write_submission(wide, path)
    schema = ", ".join(["row_id string", *[f"{c} double" for c in wide.columns[1:]]])
    found = scans.scan_csv(spark, path, schema)
    return found.select("row_id", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


@query("success_marker", "SELECT count(*) AS n, true AS complete FROM events")
def success_marker(spark, sf):
    path = scratch_path(spark, "marked")
    sinks.write_zstd(table(spark, sf, "events").select("event_id"), path)
    done = sinks.is_complete(spark, path)
    return scans.scan_parquet(spark, path).agg(F.count("*").alias("n"), F.lit(done).alias("complete"))


@query("resume_incremental", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def resume_incremental(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    todo = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sinks.resume_incremental(todo, done.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("write_stamped", """
SELECT event_type, w AS "window", 'plain' AS tokenizer, count(*) AS n
FROM events, (VALUES (40), (80)) AS v(w) WHERE value > w GROUP BY ALL""")
def write_stamped(spark, sf):
    path = scratch_path(spark, "runs")
    for window in (40, 80):
        rows = table(spark, sf, "events").where(F.col("value") > window).select("event_type")
        sinks.write_stamped(rows, path, {"tokenizer": "plain", "window": window})
    found = scans.scan_partitioned(spark, path)
    return found.groupBy("event_type", "window", "tokenizer").agg(F.count("*").alias("n"))


@query("save_model", f"""WITH {FRAMES}
SELECT file, count(*) AS n, count(*) AS n_same FROM frames GROUP BY file""")
def save_model(spark, sf):
    path = scratch_path(spark, "model")
    data = frames(spark, sf).select("file", "mfcc")
    built = quantizer.build_pca_tokenizer(data, "mfcc")
    built.codebook.write.parquet(f"{path}/codebook")
    sinks.save_model(built.rotation, f"{path}/rotation")
    loaded = quantizer.Tokenizer(
        spark.read.parquet(f"{path}/codebook"), sinks.load_model(spark, f"{path}/rotation")
    )
    both = quantizer.tokenize(quantizer.tokenize(data, built, out="one"), loaded, out="two")
    return both.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if(F.col("one") == F.col("two")).alias("n_same")
    )


@query("save_report", f"""WITH guess AS (SELECT quality AS truth, toxic AS pred FROM labels), {REPORT}
SELECT (SELECT round(avg((truth = pred)::INTEGER), 3) FROM guess) AS accuracy, round(avg(precision), 3) AS precision,
       round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1 FROM report""")
def save_report(spark, sf):
    from sigframe.operators.metrics import macro_scores

    path = scratch_path(spark, "report")
    sinks.save_report(macro_scores(table(spark, sf, "labels"), "quality", "toxic"), path)
    return spark.read.json(path).select("accuracy", "precision", "recall", "f1")


@query("bounded_collect", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""")
def bounded_collect(spark, sf):
    # What reaches the driver is the aggregate, not the table, and its size is checked.
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    rows = [tuple(r) for r in sinks.collect_bounded(counts, max_rows=1_000)]
    return spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, n bigint")
