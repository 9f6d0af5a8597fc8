"""Aggregations, metrics and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import (
    CLIPS, CODEBOOK, DURATIONS, FRAMES, PREDICTIONS, PROTOTYPES, TOKENS,
    clips, codebook, durations, frames, predictions, prototypes, query, rounded, table, tokens,
)
from sigframe.operators import features, metrics, profile, sequence, signal, vectors
from sigframe.plans import classifier


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("total_hours", f"""WITH {DURATIONS}
SELECT 'all' AS part, round(sum(duration) / 3600, 6) AS hours FROM durations UNION ALL
SELECT 'train', round(sum(duration) / 3600, 6) FROM durations WHERE path LIKE 'train%' UNION ALL
SELECT 'soundscape', round(sum(duration) / 3600, 6) FROM durations WHERE path LIKE '%soundscape%'""")
def total_hours(spark, sf):
    files = durations(spark, sf)
    parts = {"all": None, "train": "train%", "soundscape": "%soundscape%"}
    rows = [
        profile.total_hours(files, like).select(
            F.lit(name).alias("part"), F.round("hours", 6).alias("hours")
        )
        for name, like in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("durations_by_dataset", f"""WITH {DURATIONS}
SELECT string_split(path, '/')[1] AS dataset, count(*) AS count,
       round(sum(duration) / 60 / 60, 2) AS duration_hours FROM durations GROUP BY dataset""")
def durations_by_dataset(spark, sf):
    return profile.durations_by_dataset(durations(spark, sf))


@query("durations_by_class", f"""WITH {DURATIONS}
SELECT string_split(path, '/')[2] AS primary_label, count(*) AS count,
       round(sum(duration) / 60, 2) AS duration_minutes
FROM durations WHERE string_split(path, '/')[1] = 'train_audio'
GROUP BY primary_label ORDER BY count DESC, primary_label LIMIT 10""")
def durations_by_class(spark, sf):
    found = profile.durations_by_class(durations(spark, sf))
    return found.orderBy(F.desc("count"), "primary_label").limit(10)


@query("class_volume", f"""WITH {CLIPS}
SELECT class, count(DISTINCT file) AS num_files, count(*) AS num_embeddings,
       round(count(*) * 5 / 60 / 60, 6) AS num_hours FROM clips GROUP BY class""")
def class_volume(spark, sf):
    volume = profile.class_volume(clips(spark, sf).select("class", "file"))
    return volume.withColumn("num_hours", F.round("num_hours", 6))


@query("summarize_timings", """
SELECT event_type AS model, round(sum(value) / 3600, 6) AS total_hours,
       round(avg(value), 6) AS mean_elapsed, count(*) AS n_parts FROM events GROUP BY event_type""")
def summarize_timings(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("elapsed")
    )
    found = profile.summarize_timings(runs, ["model"])
    return found.select(
        "model", F.round("total_hours", 6).alias("total_hours"),
        F.round("mean_elapsed", 6).alias("mean_elapsed"), "n_parts",
    )


@query("group_count", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def group_count(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("value_counts", """
SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, p_brand, p_type""")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("distinct", "SELECT DISTINCT l_partkey FROM lineitem")
def distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey").distinct()


@query("n_unique", f"""WITH {CLIPS}
SELECT count(DISTINCT file) AS files, count(DISTINCT len(embedding)) AS sizes,
       count(DISTINCT class) AS classes FROM clips""")
def n_unique(spark, sf):
    return clips(spark, sf).agg(
        F.countDistinct("file").alias("files"),
        F.countDistinct(F.size("embedding")).alias("sizes"),
        F.countDistinct("class").alias("classes"),
    )


@query("clusters_per_file", """
SELECT user_id, count(DISTINCT event_type) AS n_clusters FROM events GROUP BY user_id""")
def clusters_per_file(spark, sf):
    return profile.clusters_per_file(table(spark, sf, "events"), "user_id", "event_type")


@query("clusters_per_file_summary", """WITH c AS (
  SELECT user_id, count(DISTINCT l_partkey) AS n_clusters
  FROM lineitem JOIN (SELECT l_orderkey AS k, l_suppkey AS user_id FROM lineitem) ON l_orderkey = k
  GROUP BY user_id)
SELECT count(*) AS count, round(avg(n_clusters), 6) AS mean, round(stddev_samp(n_clusters), 6) AS stddev,
       min(n_clusters)::DOUBLE AS min, max(n_clusters)::DOUBLE AS max,
       quantile_disc(n_clusters, 25e-2)::DOUBLE AS p25, quantile_disc(n_clusters, 5e-1)::DOUBLE AS p50,
       quantile_disc(n_clusters, 75e-2)::DOUBLE AS p75 FROM c""")
def clusters_per_file_summary(spark, sf):
    lines = table(spark, sf, "lineitem")
    owners = lines.select(F.col("l_orderkey"), F.col("l_suppkey").alias("user_id"))
    joined = lines.select("l_orderkey", "l_partkey").join(owners, "l_orderkey")
    counts = profile.clusters_per_file(joined, "user_id", "l_partkey")
    found = profile.summary(counts, ["n_clusters"]).drop("column")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("describe_text", """
SELECT 'event_type' AS "column", count(event_type) AS count, count(DISTINCT event_type) AS "distinct",
       min(event_type) AS min, max(event_type) AS max, min(length(event_type)) AS shortest,
       max(length(event_type)) AS longest FROM events
UNION ALL
SELECT 'props', count(props), count(DISTINCT props), min(props), max(props), min(length(props)),
       max(length(props)) FROM events""")
def describe_text(spark, sf):
    return profile.describe_text(table(spark, sf, "events"))


@query("describe", """
SELECT 'value' AS "column", count(value) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM events UNION ALL
SELECT 'user_id', count(user_id), round(avg(user_id), 6), round(stddev_samp(user_id), 6),
       min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events""")
def describe(spark, sf):
    found = profile.describe(table(spark, sf, "events"), ["value", "user_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("summary", """
SELECT 'l_quantity' AS "column", count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
       round(stddev_samp(l_quantity), 6) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max,
       quantile_disc(l_quantity, 25e-2) AS p25, quantile_disc(l_quantity, 5e-1) AS p50,
       quantile_disc(l_quantity, 75e-2) AS p75 FROM lineitem""")
def summary(spark, sf):
    found = profile.summary(table(spark, sf, "lineitem"), ["l_quantity"], accuracy=1_000_000)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


LONG_MEANS = """SELECT {key}, pos::INTEGER AS pos, round(avg(embedding[pos + 1]), 6) + 0e0 AS value, count(*) AS n
FROM clips, unnest(range(64)) AS t(pos) GROUP BY {key}, pos"""


@query("mean_vector", f"WITH {CLIPS} " + LONG_MEANS.format(key="file"))
def mean_vector(spark, sf):
    means = vectors.mean_vector(clips(spark, sf), ["file"])
    return vectors.long_form(means, ["file", "n"], "embedding").withColumn("value", rounded("value"))


@query("class_prototypes", f"WITH {CLIPS} " + LONG_MEANS.format(key="class"))
def class_prototypes(spark, sf):
    means = vectors.class_prototypes(clips(spark, sf), "class")
    return vectors.long_form(means, ["class", "n"], "embedding").withColumn("value", rounded("value"))


@query("missing_vectors", """
SELECT label, count(*) AS n_rows, count(*) FILTER (WHERE vec_id % 3 = 0) AS n_missing
FROM embeddings GROUP BY label""")
def missing_vectors(spark, sf):
    holes = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))
    )
    return vectors.missing_vectors(holes, ["label"])


MEAN_STD = """stats AS (
  SELECT file, avg(mfcc[i]) AS m, stddev_pop(mfcc[i]) AS s, i, count(*) AS n
  FROM frames, unnest(range(1, 5)) AS t(i) GROUP BY file, i)
SELECT file, n, (i - 1)::INTEGER AS pos, round(m, 5) AS value FROM stats UNION ALL
SELECT file, n, (i + 3)::INTEGER AS pos, round(s, 5) AS value FROM stats"""


@query("vector_mean_std", f"WITH {FRAMES}, {MEAN_STD}")
def vector_mean_std(spark, sf):
    stats = vectors.vector_mean_std(frames(spark, sf), ["file"], "mfcc", width=4)
    return vectors.long_form(stats, ["file", "n"], "stats").withColumn("value", rounded("value", 5))


@query("vector_mean_std_wide", f"""WITH {CLIPS},
stats AS (
  SELECT class, avg(embedding[i]) AS m, stddev_pop(embedding[i]) AS s, i, count(*) AS n
  FROM clips, unnest(range(1, 65)) AS t(i) GROUP BY class, i)
SELECT class, n, (i - 1)::INTEGER AS pos, round(m, 5) + 0e0 AS value FROM stats UNION ALL
SELECT class, n, (i + 63)::INTEGER AS pos, round(s, 5) + 0e0 AS value FROM stats""")
def vector_mean_std_wide(spark, sf):
    stats = vectors.vector_mean_std(clips(spark, sf), ["class"])
    return vectors.long_form(stats, ["class", "n"], "stats").withColumn("value", rounded("value", 5))


@query("bucket_features", f"""WITH {FRAMES}, {CODEBOOK}, {PROTOTYPES},
points AS (SELECT DISTINCT mfcc FROM frames),
measured AS (
  SELECT mfcc, token, pow(mfcc[1] - centroid[1], 2) + pow(mfcc[2] - centroid[2], 2)
         + pow(mfcc[3] - centroid[3], 2) + pow(mfcc[4] - centroid[4], 2) AS d
  FROM points, codebook),
hits AS (SELECT mfcc, token FROM measured
  QUALIFY row_number() OVER (PARTITION BY mfcc ORDER BY d, token) = 1),
words AS (SELECT token, pos, value FROM proto_long JOIN (SELECT DISTINCT token FROM prototypes WHERE token <> 2) ON label = token),
bucketed AS (
  SELECT file, CASE WHEN timestamp >= 0 AND timestamp < 100 THEN (floor(timestamp / 5) * 5)::INTEGER
         ELSE -1 END AS start_time, mfcc, token FROM frames JOIN hits USING (mfcc)),
sizes AS (SELECT file, start_time, count(*) AS n, count(*) FILTER (WHERE token = 2) AS n_unknown
  FROM bucketed GROUP BY ALL),
stats AS (SELECT file, start_time, i, avg(mfcc[i]) AS m, stddev_pop(mfcc[i]) AS s
  FROM bucketed, unnest(range(1, 5)) AS t(i) GROUP BY ALL),
counted AS (SELECT file, start_time, token, count(*) AS c FROM bucketed GROUP BY ALL),
means AS (SELECT file, start_time, pos, sum(value * c) / sum(c) AS v
  FROM counted JOIN words USING (token) GROUP BY ALL),
long AS (
  SELECT file, start_time, 'frame' AS kind, (i - 1)::INTEGER AS pos, round(m, 4) + 0e0 AS value FROM stats UNION ALL
  SELECT file, start_time, 'frame', i + 3, round(s, 4) + 0e0 FROM stats UNION ALL
  SELECT file, start_time, 'word', pos, round(v, 4) + 0e0 FROM means)
SELECT file, start_time, kind, pos::INTEGER AS pos, value, n, n_unknown FROM long JOIN sizes USING (file, start_time)""")
def bucket_features(spark, sf):
    words = prototypes(spark, sf).where("token <> 2").withColumnRenamed("centroid", "word_vector")
    found = features.bucket_features(frames(spark, sf), codebook(spark, sf), words)
    keys = ["file", "start_time", "n", "n_unknown"]
    kinds = F.array(
        F.struct(F.lit("frame").alias("kind"), F.col("mfcc_stats").alias("v")),
        F.struct(F.lit("word").alias("kind"), F.col("word_vector").alias("v")),
    )
    parts = found.select(*keys, F.inline(kinds))
    long = vectors.long_form(parts, [*keys, "kind"], "v")
    return long.withColumn("value", rounded("value", 4))


@query("collect_list", """WITH ranked AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_custkey, pos // 8 AS chunk, count(*)::INTEGER AS n, string_agg(o_orderkey, ',' ORDER BY pos) AS keys
FROM ranked GROUP BY o_custkey, chunk""")
def collect_list(spark, sf):
    orders = table(spark, sf, "orders")
    found = sequence.collect_chunks(orders, ["o_custkey"], ["o_orderkey"], "o_orderkey", 8)
    return found.select(
        "o_custkey", "chunk", F.size("items").alias("n"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("keys"),
    )


@query("group_map", """
SELECT user_id, count(*) AS n, round(avg(value * pi()), 6) AS mean, round(stddev_pop(value * pi()), 6) AS std
FROM events GROUP BY user_id""")
def group_map(spark, sf):
    def partial(rows):
        squared = rows.assign(q=rows["value"] ** 2)
        sums = squared.groupby("user_id").agg(n=("value", "size"), s=("value", "sum"), q=("q", "sum"))
        return sums.reset_index()

    def merge(states):
        return states.groupby("user_id", as_index=False).sum()

    def finish(states):
        mean = states["s"] / states["n"]
        std = ((states["q"] / states["n"] - mean * mean).clip(lower=0)) ** 0.5
        return states[["user_id", "n"]].assign(mean=mean, std=std)

    found = signal.group_map(
        table(spark, sf, "events").select("user_id", (F.col("value") * F.pi()).alias("value")),
        ["user_id"], partial, merge, finish,
        "user_id bigint, n bigint, s double, q double",
        "user_id bigint, n bigint, mean double, std double",
    )
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("token_support", f"""WITH {TOKENS}
SELECT token, count(*) AS count FROM tokens GROUP BY token ORDER BY count DESC, token""")
def token_support(spark, sf):
    return profile.token_support(tokens(spark, sf))


HISTOGRAM = """span AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
counted AS (SELECT least(floor((v - lo) / ((hi - lo) / {bins})), {last})::INTEGER AS bin, count(*) AS count
  FROM vals, span GROUP BY bin)
SELECT b::INTEGER AS bin, round(lo + b * (hi - lo) / {bins}, 6) AS edge, coalesce(count, 0) AS count
FROM span, range({bins}) AS t(b) LEFT JOIN counted ON bin = b"""


@query("histogram", "WITH vals AS (SELECT o_totalprice AS v FROM orders), "
       + HISTOGRAM.format(bins=20, last=19))
def histogram(spark, sf):
    found = profile.histogram(table(spark, sf, "orders"), "o_totalprice", 20)
    return found.withColumn("edge", F.round("edge", 6))


@query("support_histogram", "WITH vals AS (SELECT log2(count(*)) AS v FROM lineitem GROUP BY l_partkey), "
       + HISTOGRAM.format(bins=100, last=99))
def support_histogram(spark, sf):
    found = profile.support_histogram(table(spark, sf, "lineitem"), "l_partkey", 100)
    return found.withColumn("edge", F.round("edge", 6))


@query("cluster_objective", f"""WITH {PREDICTIONS}
SELECT round(sum(distance), 6) AS objective FROM predictions""")
def cluster_objective(spark, sf):
    return profile.cluster_objective(predictions(spark, sf)).withColumn(
        "objective", F.round("objective", 6)
    )


@query("cluster_imbalance", """WITH sizes AS (SELECT l_suppkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey)
SELECT round(count(*) * sum(n * n) / pow(sum(n), 2), 9) AS imbalance FROM sizes""")
def cluster_imbalance(spark, sf):
    found = profile.cluster_imbalance(table(spark, sf, "lineitem"), "l_suppkey")
    return found.withColumn("imbalance", F.round("imbalance", 9))


@query("explained_variance", """WITH energy AS (
  SELECT pos::INTEGER AS pos, sum(pow(embedding[pos + 1]::DOUBLE, 2)) AS energy
  FROM embeddings, unnest(range(64)) AS t(pos) GROUP BY pos)
SELECT pos, round(energy, 6) AS energy, round(energy / sum(energy) OVER (), 9) AS share,
       round(sum(energy) OVER (ORDER BY pos) / sum(energy) OVER (), 9) AS cumulative FROM energy""")
def explained_variance(spark, sf):
    found = profile.explained_variance(table(spark, sf, "embeddings"))
    return found.select(
        "pos", F.round("energy", 6).alias("energy"), F.round("share", 9).alias("share"),
        F.round("cumulative", 9).alias("cumulative"),
    )


@query("balanced_weights", """WITH sizes AS (SELECT l_partkey, count(*) AS n_c FROM lineitem GROUP BY l_partkey),
overall AS (SELECT sum(n_c) AS n, count(*) AS c FROM sizes)
SELECT l_orderkey, l_partkey, round(n / c / n_c, 9) AS weight
FROM lineitem JOIN sizes USING (l_partkey), overall""")
def balanced_weights(spark, sf):
    data = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    weighted = classifier.balanced_weights(data, "l_partkey")
    return weighted.select("l_orderkey", "l_partkey", F.round("weight", 9).alias("weight"))


@query("accuracy", f"""WITH {PREDICTIONS}
SELECT round(avg((truth = pred)::INTEGER), 9) AS accuracy FROM predictions""")
def accuracy(spark, sf):
    found = metrics.accuracy(predictions(spark, sf), "truth", "pred")
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query("confusion_counts", f"""WITH {PREDICTIONS}
SELECT truth, pred, count(*) AS n FROM predictions GROUP BY truth, pred""")
def confusion_counts(spark, sf):
    return metrics.confusion_counts(predictions(spark, sf), "truth", "pred")


REPORT = """classes AS (SELECT truth AS label FROM guess UNION SELECT pred FROM guess),
per AS (
  SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp,
         count(*) FILTER (WHERE truth <> label AND pred = label) AS fp,
         count(*) FILTER (WHERE truth = label AND pred <> label) AS fn
  FROM classes, guess GROUP BY label),
report AS (
  SELECT label, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support
  FROM per)"""
GUESS_TYPES = """guess AS (
  SELECT o_orderstatus AS truth, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O'
         ELSE 'X' END AS pred FROM orders)"""


def _status_guess(spark, sf):
    price = F.col("o_totalprice")
    pred = F.when(price > 250000, "F").when(price > 100000, "O").otherwise("X")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("truth"), pred.alias("pred"))


@query("class_report", f"""WITH {GUESS_TYPES}, {REPORT}
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report""")
def class_report(spark, sf):
    found = metrics.class_report(_status_guess(spark, sf), "truth", "pred")
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("macro_scores", f"""WITH {GUESS_TYPES}, {REPORT}
SELECT (SELECT round(avg((truth = pred)::INTEGER), 3) FROM guess) AS accuracy, round(avg(precision), 3) AS precision,
       round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1 FROM report""")
def macro_scores(spark, sf):
    return metrics.macro_scores(_status_guess(spark, sf), "truth", "pred")


@query("binary_report", f"""WITH guess AS (SELECT quality AS truth, toxic AS pred FROM labels), {REPORT}
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report""")
def binary_report(spark, sf):
    found = metrics.class_report(table(spark, sf, "labels"), "quality", "toxic")
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("cross_entropy", """
SELECT round(avg(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - embedding[label + 1]), 6)
       AS cross_entropy FROM embeddings""")
def cross_entropy(spark, sf):
    found = metrics.cross_entropy(table(spark, sf, "embeddings"), "embedding", "label")
    return found.withColumn("cross_entropy", F.round("cross_entropy", 6))


RUNS = """runs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
         value AS val_loss FROM events)"""


def _runs(spark, sf):
    from sigframe.operators.ranking import group_rank

    data = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ranked = group_rank(data, ["user_id"], ["ts", "event_id"], "epoch")
    return ranked.select(F.col("user_id").alias("run"), "epoch", F.col("value").alias("val_loss"))


@query("best_run", f"""WITH {RUNS}
SELECT run, epoch, val_loss FROM runs
QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) = 1""")
def best_run(spark, sf):
    return metrics.best_run(_runs(spark, sf), "val_loss", by=["run"])


@query("best_run_overall", """
SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1""")
def best_run_overall(spark, sf):
    chosen = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return metrics.best_run(chosen, "s_acctbal", "max")


@query("early_stop_epoch", f"""WITH {RUNS},
seen AS (
  SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM runs WHERE epoch < 50),
marked AS (
  SELECT *, max(CASE WHEN before IS NULL OR val_loss < before THEN epoch END)
           OVER (PARTITION BY run ORDER BY epoch) AS top FROM seen),
stops AS (SELECT run, coalesce(min(epoch) FILTER (WHERE epoch - top >= 5), max(epoch)) AS stop_epoch FROM marked GROUP BY run)
SELECT run, stop_epoch, max(top) AS best_epoch, min(val_loss) AS best_loss
FROM marked JOIN stops USING (run) WHERE epoch <= stop_epoch GROUP BY run, stop_epoch""")
def early_stop_epoch(spark, sf):
    return metrics.early_stop_epoch(_runs(spark, sf))


@query("union_tagged", f"""WITH {CLIPS}, tagged AS (
  SELECT file AS id, embedding, 'soundscape' AS class_name, 1 AS is_soundscape FROM clips UNION ALL
  SELECT class, embedding, 'prototype', 0 FROM clips)
SELECT id, class_name, is_soundscape, i::INTEGER AS pos, round(avg(embedding[i + 1]), 6) + 0e0 AS value
FROM tagged, range(64) AS t(i) GROUP BY ALL""")
def union_tagged(spark, sf):
    data = clips(spark, sf)
    both = profile.union_tagged(
        vectors.mean_vector(data, ["file"]), vectors.class_prototypes(data, "class")
    )
    long = vectors.long_form(both, ["id", "class_name", "is_soundscape"], "embedding")
    return long.withColumn("value", rounded("value"))


@query("set_difference", """
SELECT DISTINCT concat('b', o_custkey) AS name FROM orders EXCEPT
SELECT DISTINCT concat('b', c_custkey) FROM customer WHERE c_acctbal > 0""")
def set_difference(spark, sf):
    a = table(spark, sf, "orders").select(F.concat(F.lit("b"), "o_custkey").alias("name"))
    b = table(spark, sf, "customer").where("c_acctbal > 0")
    return profile.set_difference(a, b.select(F.concat(F.lit("b"), "c_custkey").alias("name")), "name")


@query("distinct_sorted", """
SELECT DISTINCT p_name FROM part ORDER BY p_name""")
def distinct_sorted(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().orderBy("p_name")
