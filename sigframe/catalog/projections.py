"""Projections, filters, sampling, splits, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.catalog.registry import (
    CLIPS, DURATIONS, FRAMES, clips, durations, frames, query, rounded, table,
)
from sigframe.functions import arrays, paths
from sigframe.operators import sampling, vectors

def wide_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Clip keys and one column per element, as a model writes them."""
    return clips(spark, sf).select(
        "file", "start_time", "end_time", *[F.get("embedding", F.lit(i)).alias(str(i)) for i in range(64)]
    )


@query("pack_vector", f"""WITH {CLIPS}
SELECT file, start_time, end_time, len(embedding)::INTEGER AS size,
       round(list_sum(embedding), 6) + 0e0 AS total, round(embedding[64], 6) + 0e0 AS last
FROM clips""")
def pack_vector(spark, sf):
    packed = vectors.pack_vector(wide_clips(spark, sf), size=64)
    return packed.select(
        "file", "start_time", "end_time", F.size("embedding").alias("size"),
        rounded(arrays.array_sum("embedding")).alias("total"),
        rounded(F.get("embedding", F.lit(63)).cast("double")).alias("last"),
    )


# All 64 elements, named so that their order as text is another one.
CODES = {f"code_{i * 37 % 64:02d}": i for i in range(64)}


@query("unpack_predictions", "SELECT vec_id, " + ", ".join(
    f"round(embedding[{i + 1}]::DOUBLE, 6) AS {c}" for c, i in CODES.items()) + " FROM embeddings")
def unpack_predictions(spark, sf):
    wide = vectors.unpack_predictions(table(spark, sf, "embeddings"), "embedding", CODES, keep=["vec_id"])
    return wide.select(
        "vec_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in wide.columns[1:]]
    )


@query("project", "SELECT event_id, user_id, value FROM events")
def project(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value")


@query("derive", "SELECT event_id, value * 2 + 1 AS scaled, value / 60 AS minutes FROM events")
def derive(spark, sf):
    derived = table(spark, sf, "events").withColumn("scaled", F.col("value") * 2 + 1)
    return derived.withColumn("minutes", F.col("value") / 60).select("event_id", "scaled", "minutes")


@query("rename", "SELECT event_id AS id, event_type AS primary_label FROM events")
def rename(spark, sf):
    chosen = table(spark, sf, "events").select("event_id", "event_type")
    return chosen.withColumnsRenamed({"event_id": "id", "event_type": "primary_label"})


@query("constant", "SELECT n_nationkey, n_name, 'prototype' AS class_name, 0 AS is_soundscape FROM nation")
def constant(spark, sf):
    return table(spark, sf, "nation").select(
        "n_nationkey", "n_name", F.lit("prototype").alias("class_name"), F.lit(0).alias("is_soundscape")
    )


@query("filter_compare", """
SELECT event_id, value FROM events WHERE value > 10 AND value < 60 AND event_type = 'click'""")
def filter_compare(spark, sf):
    return (
        table(spark, sf, "events")
        .where((F.col("value") > 10) & (F.col("value") < 60))
        .where("event_type = 'click'")
        .select("event_id", "value")
    )


@query("filter_like", f"""WITH {DURATIONS}
SELECT path, duration FROM durations WHERE path LIKE 'train%' AND path LIKE '%soundscape%'""")
def filter_like(spark, sf):
    found = durations(spark, sf)
    return found.where(F.col("path").like("train%") & F.col("path").like("%soundscape%"))


@query("drop_noise", """
WITH labelled AS (SELECT vec_id, CASE WHEN label < 3 THEN -1 ELSE label END AS cluster FROM embeddings)
SELECT vec_id, cluster FROM labelled WHERE cluster > -1""")
def drop_noise(spark, sf):
    cluster = F.when(F.col("label") < 3, -1).otherwise(F.col("label")).alias("cluster")
    return table(spark, sf, "embeddings").select("vec_id", cluster).where("cluster > -1")


@query("filter_rare_classes", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30)""")
def filter_rare_classes(spark, sf):
    chosen = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sampling.filter_rare_classes(chosen, "l_partkey", 30).select(*chosen.columns)


@query("subset_classes", """
WITH named AS (SELECT p_partkey, concat(p_type, '_', p_size) AS class FROM part),
chosen AS (SELECT DISTINCT class FROM named WHERE regexp_matches(class, '[A-Za-z]') ORDER BY class LIMIT 10)
SELECT p_partkey, class FROM named WHERE class IN (SELECT class FROM chosen)""")
def subset_classes(spark, sf):
    named = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("_", "p_type", "p_size").alias("class")
    )
    return sampling.subset_classes(named, "class", 10).select("p_partkey", "class")


CRC = """list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split({key}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""


@query("hash_sample", f"""WITH keys AS (
  SELECT user_id, xor({CRC.format(key="concat('name_', user_id)")}, 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, concat('name_', user_id) AS name FROM events JOIN keys USING (user_id)
WHERE crc % 10 = 0""")
def hash_sample(spark, sf):
    named = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("name_"), "user_id").alias("name")
    )
    return sampling.hash_sample(named, "name", 10)


@query("assign_round_robin", f"""WITH {DURATIONS}
SELECT path, (row_number() OVER (ORDER BY path) - 1) % 16 AS part FROM durations""")
def assign_round_robin(spark, sf):
    return sampling.assign_round_robin(durations(spark, sf).select("path"), ["path"], 16)


@query("limit_parts", f"""WITH {FRAMES}
SELECT file, timestamp, part FROM frames WHERE part < 10""")
def limit_parts(spark, sf):
    return sampling.limit_parts(frames(spark, sf), 10).select("file", "timestamp", "part")


@query("limit_files", f"""WITH {DURATIONS}
SELECT path, duration FROM durations ORDER BY path LIMIT 100""")
def limit_files(spark, sf):
    return sampling.limit_files(durations(spark, sf), ["path"], 100)


@query("train_holdout_by_part", f"""WITH {FRAMES}
SELECT part < 80 AS is_train, part, count(*) AS n FROM frames GROUP BY part""")
def train_holdout_by_part(spark, sf):
    train, held = sampling.train_holdout_by_part(frames(spark, sf).select("part"))
    both = train.withColumn("is_train", F.lit(True)).unionByName(
        held.withColumn("is_train", F.lit(False))
    )
    return both.groupBy("is_train", "part").agg(F.count("*").alias("n"))


SPREAD = "('0x' || substr(md5({id} || ':' || {seed}), 1, 8))::BIGINT"


@query("stratified_split", f"""WITH ranked AS (
  SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label
           ORDER BY {SPREAD.format(id="vec_id", seed=42)}, vec_id) - 1 AS pos
  FROM embeddings)
SELECT vec_id, label, pos < least(greatest(1, floor(n * 2e-1 + 5e-1)), n - 1) AS is_test FROM ranked""")
def stratified_split(spark, sf):
    data = table(spark, sf, "embeddings").select("vec_id", "label")
    train, test = sampling.stratified_split(data, "label", "vec_id", 0.2, 42)
    return train.withColumn("is_test", F.lit(False)).unionByName(
        test.withColumn("is_test", F.lit(True))
    )


@query("stratified_split_by_group", f"""WITH units AS (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem),
ranked AS (
  SELECT l_orderkey, l_returnflag, count(*) OVER (PARTITION BY l_returnflag) AS n,
         row_number() OVER (PARTITION BY l_returnflag
           ORDER BY {SPREAD.format(id="l_orderkey", seed=7)}, l_orderkey) - 1 AS pos
  FROM units)
SELECT l_returnflag, l_orderkey, count(*) AS n_rows,
       bool_and(pos < least(greatest(1, floor(n * 33e-2 + 5e-1)), n - 1)) AS is_test
FROM lineitem JOIN ranked USING (l_returnflag, l_orderkey) GROUP BY ALL""")
def stratified_split_by_group(spark, sf):
    data = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    flagged = sampling.with_test_flag(
        data, "l_returnflag", "l_linenumber", 0.33, 7, group="l_orderkey"
    )
    return flagged.groupBy("l_returnflag", "l_orderkey").agg(
        F.count("*").alias("n_rows"), F.bool_and("is_test").alias("is_test")
    )


@query("stratified_folds", f"""
SELECT event_id, event_type, ((row_number() OVER (PARTITION BY event_type
  ORDER BY {SPREAD.format(id="event_id", seed=42)}, event_id) - 1) % 5)::INTEGER AS fold
FROM events""")
def stratified_folds(spark, sf):
    data = table(spark, sf, "events").select("event_id", "event_type")
    return sampling.stratified_folds(data, "event_type", "event_id", 5, 42)


@query("shuffle_rows", "SELECT event_id, value FROM events")
def shuffle_rows(spark, sf):
    return sampling.shuffle_rows(table(spark, sf, "events").select("event_id", "value"), 42)


@query("sample_size", """WITH counted AS (
  SELECT event_type, count(*) AS population FROM events GROUP BY event_type)
SELECT event_type, population,
       ceil(n0 / (1 + (n0 - 1) / population))::BIGINT AS sample_size
FROM counted, (SELECT pow(196e-2, 2) * 25e-2 / pow(2e-2, 2) AS n0)""")
def sample_size(spark, sf):
    return sampling.sample_size(table(spark, sf, "events"), ["event_type"], 95, 2.0)


@query("sort_by_keys", f"""WITH {CLIPS}
SELECT file, start_time, vec_id FROM clips ORDER BY file, start_time""")
def sort_by_keys(spark, sf):
    return clips(spark, sf).select("file", "start_time", "vec_id").orderBy("file", "start_time")


@query("top_k", """SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20""")
def top_k(spark, sf):
    chosen = table(spark, sf, "events").select("event_id", "value")
    return chosen.orderBy(F.desc("value"), "event_id").limit(20)


@query("tail_k", """SELECT event_type, count(*) AS count FROM events GROUP BY event_type
ORDER BY count ASC, event_type DESC LIMIT 3""")
def tail_k(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").count()
    return counts.orderBy(F.asc("count"), F.desc("event_type")).limit(3)


@query("first_row", f"""WITH {CLIPS}
SELECT file, start_time, vec_id FROM clips ORDER BY file, start_time LIMIT 1""")
def first_row(spark, sf):
    return clips(spark, sf).select("file", "start_time", "vec_id").orderBy("file", "start_time").limit(1)


@query("head_n", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def head_n(spark, sf):
    chosen = table(spark, sf, "documents").select("doc_id", "n_chars")
    return chosen.orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query("sort_row_id", f"""WITH {CLIPS}
SELECT concat(regexp_replace(string_split(file, '/')[-1], '\\.ogg$', ''), '_', end_time::INTEGER) AS row_id
FROM clips ORDER BY row_id""")
def sort_row_id(spark, sf):
    return clips(spark, sf).select(paths.row_id("file", "end_time").alias("row_id")).orderBy("row_id")
