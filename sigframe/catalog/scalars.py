"""Path, array and arithmetic expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import CLIPS, DURATIONS, FRAMES, clips, durations, frames, query, rounded, table
from sigframe.constants import CLASS_CODES, MODELS
from sigframe.functions import arrays, paths
from sigframe.operators import vectors
from sigframe.sources.scans import model_catalogue as catalogue

PATHS = """paths AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat('/', url) END AS path FROM pages),
split AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts
  FROM paths)"""


def _paths(spark, sf):
    url = F.col("url")
    path = F.when(F.col("page_id") % 2 == 0, url).otherwise(F.concat(F.lit("/"), url))
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query("path_part", f"""WITH {PATHS}
SELECT page_id, CASE WHEN starts_with(path, '/') THEN '/' ELSE parts[1] END AS first,
       CASE WHEN starts_with(path, '/') THEN parts[1] ELSE parts[2] END AS second,
       CASE WHEN starts_with(path, '/') THEN parts[9] ELSE parts[10] END AS tenth FROM split""")
def path_part(spark, sf):
    return _paths(spark, sf).select(
        "page_id",
        paths.path_part("path", 0).alias("first"),
        paths.path_part("path", 1).alias("second"),
        paths.path_part("path", 9).alias("tenth"),
    )


@query("parent_name", f"""WITH {PATHS}
SELECT page_id, parts[len(parts) - 1] AS parent FROM split""")
def parent_name(spark, sf):
    return _paths(spark, sf).select("page_id", paths.parent_name("path").alias("parent"))


@query("class_after_marker", f"""WITH {DURATIONS}
SELECT path, CASE WHEN contains(path, 'train_audio/')
  THEN split_part(split_part(path, 'train_audio/', 2), '/', 1) END AS class FROM durations""")
def class_after_marker(spark, sf):
    return durations(spark, sf).select("path", paths.class_after_marker("path").alias("class"))


@query("relative_path", f"""WITH {CLIPS}
SELECT DISTINCT substr(file, 18) AS rel FROM clips""")
def relative_path(spark, sf):
    rel = paths.relative_path("file", "root/train_audio").alias("rel")
    return clips(spark, sf).select(rel).distinct()


@query("concat_path", """
SELECT event_id, concat('root/train_audio/', event_type, '/', event_id) AS path FROM events""")
def concat_path(spark, sf):
    path = paths.concat_path("root/train_audio/", "event_type", F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", path.alias("path"))


@query("stem", f"""WITH {DURATIONS}
SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.ogg$', '') AS stem FROM durations""")
def stem(spark, sf):
    return durations(spark, sf).select("path", paths.stem("path").alias("stem"))


@query("row_id", f"""WITH {CLIPS}
SELECT vec_id, concat(regexp_replace(string_split(file, '/')[-1], '\\.ogg$', ''), '_', end_time::INTEGER) AS row_id
FROM clips""")
def row_id(spark, sf):
    return clips(spark, sf).select("vec_id", paths.row_id("file", "end_time").alias("row_id"))


@query("part_name", f"""WITH {FRAMES}
SELECT part, printf('part_%04d', part) AS part_name, count(*) AS n FROM frames GROUP BY part""")
def part_name(spark, sf):
    counts = frames(spark, sf).groupBy("part").agg(F.count("*").alias("n"))
    return counts.withColumn("part_name", paths.part_name("part"))


@query("has_letter", """SELECT doc_id, regexp_matches(text, '\\pL') AS has_letter FROM documents""")
def has_letter(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", paths.has_letter("text").alias("has_letter")
    )


BUCKET = "CASE WHEN {t} >= 0 AND {t} < 100 AND NOT isnan({t}) THEN (floor({t} / 5) * 5)::INTEGER ELSE -1 END"


@query("time_bucket", f"""WITH {FRAMES}
SELECT {BUCKET.format(t="timestamp")} AS start_time, count(*) AS n FROM frames GROUP BY start_time""")
def time_bucket(spark, sf):
    bucket = arrays.time_bucket("timestamp").alias("start_time")
    return frames(spark, sf).groupBy(bucket).agg(F.count("*").alias("n"))


@query("time_bucket_signed", f"""WITH t AS (SELECT c_custkey, c_acctbal / 50 AS t FROM customer)
SELECT c_custkey, {BUCKET.format(t="t")} AS start_time FROM t""")
def time_bucket_signed(spark, sf):
    bucket = arrays.time_bucket(F.col("c_acctbal") / 50)
    return table(spark, sf, "customer").select("c_custkey", bucket.alias("start_time"))


MODEL_ROWS = ", ".join(f"('{m}', {s!r}::DOUBLE, {w})" for m, s, w in MODELS)
MODEL_CTE = f"models AS (SELECT * FROM (VALUES {MODEL_ROWS}) AS v(model, clip_step, embed_size))"


@query("clip_step_for", f"""WITH {MODEL_CTE}
SELECT event_type, model, CASE WHEN clip_step IN (2, 3) THEN 1e0 ELSE clip_step END AS step,
       sum(greatest(floor(value / (CASE WHEN clip_step IN (2, 3) THEN 1e0 ELSE clip_step END)), 0))::BIGINT AS steps
FROM events, models GROUP BY ALL""")
def clip_step_for(spark, sf):
    # Seven models: every event row is repeated for each, inside its own task.
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("clip_step")) for m, s, _ in MODELS])
    runs = table(spark, sf, "events").select("event_type", "value", F.inline(models))
    step = paths.clip_step_for("clip_step")
    return runs.groupBy("event_type", "model", step.alias("step")).agg(
        F.sum(F.floor(F.col("value") / step)).alias("steps")
    )


@query("model_catalogue", f"""WITH {MODEL_CTE}
SELECT model, clip_step, embed_size, count(vec_id) AS n_wider
FROM models LEFT JOIN embeddings ON len(embedding) * 16 >= embed_size GROUP BY ALL""")
def model_catalogue(spark, sf):
    sizes = table(spark, sf, "embeddings").groupBy(
        (F.size("embedding") * 16).alias("reach")
    ).agg(F.count("*").alias("n"))
    matched = catalogue(spark).join(sizes, F.col("reach") >= F.col("embed_size"), "left")
    return matched.groupBy("model", "clip_step", "embed_size").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_wider")
    )


CODE_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASS_CODES.items())


@query("code_for", f"""WITH named AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'Aves' WHEN 'view' THEN 'Amphibia' WHEN 'error' THEN 'Insecta'
         WHEN 'signup' THEN 'Mammalia' ELSE 'Reptilia' END AS class_name FROM events)
SELECT event_id, class_name, CASE class_name {CODE_CASE} END AS color FROM named""")
def code_for(spark, sf):
    names = {"click": "Aves", "view": "Amphibia", "error": "Insecta", "signup": "Mammalia"}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event_type")), F.lit("Reptilia"))
    named = table(spark, sf, "events").select("event_id", name.alias("class_name"))
    return named.withColumn("color", paths.code_for("class_name"))


@query("crc32", """WITH k AS (SELECT DISTINCT p_name AS name FROM part)
SELECT name, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
  4294967295::BIGINT) AS crc FROM k""")
def crc32(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("crc", F.crc32(F.col("name").cast("binary")))


@query("arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 60 / 60, 6) AS hours,
       ceil(l_extendedprice / 1000)::BIGINT AS thousands, round(log2(l_quantity), 9) AS bits,
       round(pow(l_quantity, 75e-2), 9) AS raised FROM lineitem""")
def arithmetic(spark, sf):
    price, amount = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(price / 60 / 60, 6).alias("hours"), F.ceil(price / 1000).alias("thousands"),
        F.round(F.log2(amount), 9).alias("bits"), F.round(F.pow(amount, F.lit(0.75)), 9).alias("raised"),
    )


@query("cast", """
SELECT event_id, trunc(value)::INTEGER AS whole, event_id::VARCHAR AS text, round(value::FLOAT::DOUBLE, 4) AS single
FROM events""")
def cast(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("value").cast("int").alias("whole"), F.col("event_id").cast("string").alias("text"),
        F.round(F.col("value").cast("float").cast("double"), 4).alias("single"),
    )


@query("size", "SELECT vec_id, len(embedding)::INTEGER AS size FROM embeddings")
def size(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("size"))


@query("l2_distance", """WITH nxt AS (SELECT vec_id - 1 AS vec_id, embedding AS other FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - other[i]::DOUBLE, 2))), 6)
       AS distance FROM embeddings JOIN nxt USING (vec_id)""")
def l2_distance(spark, sf):
    data = table(spark, sf, "embeddings")
    other = data.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = data.join(other, "vec_id")
    return both.select("vec_id", F.round(arrays.l2_distance("embedding", "other"), 6).alias("distance"))


LONG = """SELECT vec_id, i::INTEGER - 1 AS pos, round(v[i], 6) + 0e0 AS value
FROM vals, unnest(range(1, 65)) AS t(i)"""


def _long(df, column):
    out = df.select("vec_id", F.posexplode(column).alias("pos", "value"))
    return out.withColumn("value", rounded(F.col("value").cast("double")))


@query("l2_normalize", """WITH vals AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE /
    sqrt(list_sum(list_transform(embedding, lambda y: pow(y::DOUBLE, 2))))) AS v FROM embeddings)
""" + LONG)
def l2_normalize(spark, sf):
    return _long(table(spark, sf, "embeddings"), arrays.l2_normalize("embedding"))


@query("softmax", """WITH vals AS (
  SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE) /
    list_sum(list_transform(embedding, lambda y: exp(y::DOUBLE)))) AS v FROM embeddings)
""" + LONG)
def softmax(spark, sf):
    return _long(table(spark, sf, "embeddings"), arrays.softmax("embedding"))


@query("argmax", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings""")
def argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", arrays.argmax("embedding").alias("best"))


@query("relu", """WITH vals AS (
  SELECT vec_id, list_transform(embedding, lambda x: greatest(x::DOUBLE, 0)) AS v FROM embeddings)
""" + LONG)
def relu(spark, sf):
    return _long(table(spark, sf, "embeddings"), arrays.relu("embedding"))


@query("linear", """WITH vals AS (
  SELECT vec_id, list_transform(range(4), lambda c: c + list_sum(list_transform(range(64),
    lambda i: embedding[i + 1]::DOUBLE * ((i * 7 + c * 3) % 11 - 5)))) AS v FROM embeddings)
SELECT vec_id, i::INTEGER AS pos, round(v[i + 1], 6) + 0e0 AS value FROM vals, unnest(range(4)) AS t(i)""")
def linear(spark, sf):
    import numpy as np

    weight = (np.arange(64)[:, None] * 7 + np.arange(4)[None, :] * 3) % 11 - 5.0
    scored = vectors.linear(table(spark, sf, "embeddings"), "embedding", weight, np.arange(4.0))
    return _long(scored, "logits")


@query("standardize", f"""WITH {FRAMES},
fit AS (SELECT i, avg(mfcc[i]) AS m, stddev_pop(mfcc[i]) AS s
  FROM frames, unnest(range(1, 5)) AS t(i) WHERE part < 80 GROUP BY i)
SELECT file, i::INTEGER - 1 AS pos, count(*) AS n, round(sum((mfcc[i] - m) / s), 3) + 0e0 AS total
FROM frames, fit GROUP BY file, i""")
def standardize(spark, sf):
    data = frames(spark, sf)
    scaled = vectors.standardize(data, "mfcc", fit_on=data.where("part < 80"))
    long = scaled.select("file", F.posexplode("mfcc").alias("pos", "value"))
    return long.groupBy("file", "pos").agg(
        F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total")
    )
