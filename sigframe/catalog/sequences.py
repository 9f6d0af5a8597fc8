"""Token sequences, context statistics, label codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import TOKENS, query, table, tokens
from sigframe.operators import ranking, sequence
from sigframe.plans import classifier

RANKED = f"""{TOKENS},
ranked AS (
  SELECT file, token, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) - 1 AS pos FROM tokens)"""


@query("group_rank", f"""WITH {TOKENS}
SELECT file, event_id, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) - 1 AS pos,
       count(*) OVER (PARTITION BY file) AS n FROM tokens""")
def group_rank(spark, sf):
    ranked = ranking.group_rank(tokens(spark, sf), ["file"], ["ts", "event_id"], "pos", "n")
    return ranked.select("file", "event_id", "pos", "n")


@query("token_sequences", f"""WITH {RANKED}
SELECT file, pos // 32 AS chunk, count(*)::INTEGER AS n, string_agg(token, ' ' ORDER BY pos) AS tokens
FROM ranked GROUP BY file, chunk""")
def token_sequences(spark, sf):
    found = sequence.token_sequences(
        tokens(spark, sf), ["file"], ["ts", "event_id"], "token", chunk=32
    )
    return found.select(
        "file", "chunk", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens")
    )


@query("skipgram_pairs", f"""WITH {RANKED}
SELECT a.token AS center, b.token AS context, count(*) AS n
FROM ranked a JOIN ranked b ON a.file = b.file AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5
GROUP BY center, context""")
def skipgram_pairs(spark, sf):
    return sequence.skipgram_pairs(
        tokens(spark, sf), ["file"], ["ts", "event_id"], "token", w=5, block=16
    )


@query("noise_distribution", """WITH counts AS (SELECT l_partkey AS token, count(*) AS n FROM lineitem GROUP BY token)
SELECT token, n, round(pow(n, 75e-2) / (SELECT sum(pow(n, 75e-2)) FROM counts), 9) AS probability FROM counts""")
def noise_distribution(spark, sf):
    data = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("token"))
    return sequence.noise_distribution(data).withColumn("probability", F.round("probability", 9))


@query("subsample_keep_prob", """WITH counts AS (SELECT l_suppkey AS token, count(*) AS n FROM lineitem GROUP BY token),
shares AS (SELECT token, n, n / (SELECT sum(n) FROM counts) AS f FROM counts)
SELECT token, n, round(least(1, sqrt(1e-3 / f) + 1e-3 / f), 9) AS keep_prob FROM shares""")
def subsample_keep_prob(spark, sf):
    data = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("token"))
    return sequence.subsample_keep_prob(data, t=1e-3).withColumn("keep_prob", F.round("keep_prob", 9))


@query("subsample")
def subsample(spark, sf):
    thinned = sequence.subsample(tokens(spark, sf), ["file", "event_id"], t=0.05)
    return thinned.groupBy("token").agg(F.count("*").alias("n"))


@query("label_encode", """WITH classes AS (SELECT DISTINCT concat(p_brand, ' ', p_type) AS class FROM part),
coded AS (SELECT class, (row_number() OVER (ORDER BY class) - 1)::INTEGER AS idx FROM classes)
SELECT p_partkey, class, idx FROM part JOIN coded ON class = concat(p_brand, ' ', p_type)""")
def label_encode(spark, sf):
    named = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("class")
    )
    return classifier.label_encode(named, "class")


@query("label_encode_train_only", """WITH codes AS (
  SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS idx
  FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 10 AND p_type = 'ECONOMY'))
SELECT p_partkey, p_brand, idx FROM part LEFT JOIN codes USING (p_brand)""")
def label_encode_train_only(spark, sf):
    data = table(spark, sf, "part")
    train = data.where("p_size < 10 AND p_type = 'ECONOMY'")
    chosen = data.select("p_partkey", "p_brand")
    return classifier.label_encode(chosen, "p_brand", fit_on=train, strict=False)
