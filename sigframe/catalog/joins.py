"""Joins, lookups, nearest centroids and the matrix profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import (
    CLIPS, CODEBOOK, FRAMES, PREDICTIONS, clips, codebook, frames, predictions, query, table,
)
from sigframe.operators import joins, matrix_profile as profile
from sigframe.plans.classifier import label_index


@query("join_cluster_labels", f"""WITH {CLIPS},
labels AS (SELECT file, start_time, vec_id % 7 AS cluster FROM clips)
SELECT file, start_time, vec_id, cluster FROM clips JOIN labels USING (file, start_time)""")
def join_cluster_labels(spark, sf):
    data = clips(spark, sf).select("file", "start_time", "vec_id")
    labels = data.select("file", "start_time", (F.col("vec_id") % 7).alias("cluster"))
    return joins.join_cluster_labels(data, labels)


@query("join_dimension", """
SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def join_dimension(spark, sf):
    facts = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return joins.join_dimension(facts, table(spark, sf, "nation"), "c_nationkey", "n_nationkey")


@query("lookup_map", """
SELECT event_id, event_type, idx FROM events JOIN
  (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS idx
   FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)""")
def lookup_map(spark, sf):
    data = table(spark, sf, "events").select("event_id", "event_type")
    return joins.lookup_map(data, "event_type", label_index(data, "event_type"), "idx")


@query("lookup_map_lenient", """
SELECT n_nationkey, n_regionkey, CASE WHEN r_regionkey > 1 THEN r_name END AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def lookup_map_lenient(spark, sf):
    some = table(spark, sf, "region").where("r_regionkey > 1").toDF("n_regionkey", "region")
    return joins.lookup_map(
        table(spark, sf, "nation").select("n_nationkey", "n_regionkey"),
        "n_regionkey", some, "region", strict=False,
    )


@query("lookup_word_vector", """WITH vectors AS (
  SELECT event_type AS token, avg(value) AS v, CASE WHEN event_type <> 'error' THEN 1 END AS known
  FROM events GROUP BY event_type)
SELECT event_id, event_type AS token, CASE WHEN known = 1 THEN round(v, 6) END AS first
FROM events JOIN vectors ON event_type = token""")
def lookup_word_vector(spark, sf):
    data = table(spark, sf, "events")
    vectors = data.groupBy(F.col("event_type").alias("token")).agg(
        F.array(F.avg("value")).alias("word_vector")
    )
    found = joins.lookup_word_vector(
        data.select("event_id", F.col("event_type").alias("token")),
        vectors.where("token <> 'error'"),
    )
    return found.select(
        "event_id", "token", F.round(F.get("word_vector", F.lit(0)), 6).alias("first")
    )


@query("nearest_centroid", f"""WITH {PREDICTIONS}
SELECT vec_id, truth, pred, round(distance, 6) AS distance FROM predictions""")
def nearest_centroid(spark, sf):
    return predictions(spark, sf).withColumn("distance", F.round("distance", 6))


@query("tokenize_fixed", f"""WITH {FRAMES}, {CODEBOOK},
points AS (SELECT DISTINCT mfcc FROM frames),
measured AS (
  SELECT mfcc, token, pow(mfcc[1] - centroid[1], 2) + pow(mfcc[2] - centroid[2], 2)
         + pow(mfcc[3] - centroid[3], 2) + pow(mfcc[4] - centroid[4], 2) AS d
  FROM points, codebook),
hits AS (SELECT mfcc, token FROM measured
  QUALIFY row_number() OVER (PARTITION BY mfcc ORDER BY d, token) = 1)
SELECT file, token, count(*) AS n FROM frames JOIN hits USING (mfcc) GROUP BY file, token""")
def tokenize_fixed(spark, sf):
    found = joins.nearest_centroid(
        frames(spark, sf).select("file", "mfcc"), "mfcc", codebook(spark, sf)
    )
    return found.groupBy("file", "token").agg(F.count("*").alias("n"))


@query("first_clip_per_file", f"""WITH {CLIPS}
SELECT file, start_time, vec_id, round(embedding[1], 6) AS first FROM clips
QUALIFY row_number() OVER (PARTITION BY file ORDER BY start_time) = 1""")
def first_clip_per_file(spark, sf):
    data = clips(spark, sf).select("file", "start_time", "vec_id", "embedding")
    first = joins.first_clip_per_file(data)
    return first.select(
        "file", "start_time", "vec_id",
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
    )


@query("with_first_vector", f"""WITH {CLIPS}, firsts AS (
  SELECT file, embedding AS first FROM clips
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY start_time) = 1)
SELECT vec_id, file, i - 1 AS pos, round(first[i], 6) AS value
FROM clips JOIN firsts USING (file), range(1, 65) AS t(i)""")
def with_first_vector(spark, sf):
    data = clips(spark, sf).select("vec_id", "file", "start_time", "embedding")
    found = joins.with_first_vector(data)
    return found.select("vec_id", "file", F.posexplode("first_vector").alias("pos", "value")).select(
        "vec_id", "file", F.col("pos").cast("long").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query("semi_join", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join(spark, sf):
    chosen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(chosen, orders.o_custkey == chosen.c_custkey, "left_semi")


@query("anti_join", """
SELECT c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def anti_join(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").where("o_totalprice > 250000")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti")


@query("missing_classes", """
SELECT DISTINCT p_partkey FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def missing_classes(spark, sf):
    have = table(spark, sf, "lineitem").where("l_quantity > 45")
    return joins.missing_classes(
        have.withColumnRenamed("l_partkey", "p_partkey"), table(spark, sf, "part"), "p_partkey"
    )


@query("time_bucket_join", f"""WITH {FRAMES},
clip AS (SELECT DISTINCT file, (floor(timestamp / 5) * 5)::INTEGER AS start_time FROM frames WHERE part < 50)
SELECT f.file, c.start_time, count(*) AS n, round(sum(f.mfcc[1]), 4) AS total
FROM frames f JOIN clip c ON f.file = c.file AND (floor(f.timestamp / 5) * 5)::INTEGER = c.start_time
GROUP BY ALL""")
def time_bucket_join(spark, sf):
    data = frames(spark, sf)
    starts = (F.floor(F.col("timestamp") / 5) * 5).cast("double").alias("start_time")
    clip = data.where("part < 50").select("file", starts).distinct()
    joined = joins.time_bucket_join(data.select("file", "timestamp", "mfcc"), clip)
    return joined.groupBy("file", "start_time").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.get("mfcc", F.lit(0))), 4).alias("total"),
    )


@query("positional_join", """
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)
SELECT pos, event_id, o_orderkey FROM a JOIN b USING (pos)""")
def positional_join(spark, sf):
    left = table(spark, sf, "events").select("event_id", "ts")
    right = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    joined = joins.positional_join(left, ["ts", "event_id"], right, ["o_totalprice", "o_orderkey"])
    return joined.select("pos", "event_id", "o_orderkey")


@query("matrix_profile", """WITH ranked AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
series AS (SELECT user_id, list(value ORDER BY i) AS v FROM ranked GROUP BY user_id),
subs AS (
  SELECT user_id, pos, v[pos + 1 : pos + 8] AS raw
  FROM series, unnest(range(greatest(len(v) - 7, 0))) AS t(pos)),
scaled AS (
  SELECT user_id, pos, list_avg(raw) AS mu, raw,
         sqrt(list_avg(list_transform(raw, lambda x: pow(x - list_avg(raw), 2)))) AS sd FROM subs),
z AS (SELECT user_id, pos, list_transform(raw, lambda x: (x - mu) / sd) AS z FROM scaled),
pairs AS (
  SELECT a.user_id, a.pos, b.pos AS neighbor,
         sqrt(list_sum(list_transform(range(1, 9), lambda i: pow(a.z[i] - b.z[i], 2)))) AS d
  FROM z a JOIN z b ON a.user_id = b.user_id AND abs(a.pos - b.pos) > 2),
best AS (SELECT user_id, pos, neighbor, d FROM pairs
  QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY d, neighbor) = 1)
SELECT user_id, pos, round(d, 4) AS distance, neighbor FROM z LEFT JOIN best USING (user_id, pos)""")
def matrix_profile(spark, sf):
    found = profile.matrix_profile(
        table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 8, block=32
    )
    return found.withColumn("distance", F.round("distance", 4))
