"""The operators of this folder as queries on the test tables, with SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import (
    byte_bpe, chat, decontaminate, exact_dedup, jaccard_join, language, lattice, mixing, quality,
    substring_dedup, token_counts, variants, whitening,
)
from sigframe.runtime import durable, scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.with_digest(substring_dedup.remove_repeats(table(spark, sf, "documents")))


def op2_chat_rotation(spark: SparkSession, sf: str) -> DataFrame:
    spans = F.transform("mask", lambda x: F.concat_ws("+", x["start"], x["length"]))
    return chat.rotate_speakers(table(spark, sf, "conversations")).withColumn("mask", F.array_join(spans, " "))


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_lattice_score(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf, "documents"))


def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents come in; those of bad quality are then revised (signs that junk
    consists of are taken out), toxic ones deleted, and the last batch is delivered twice.

    Texts are counted as they come and as revised; labels only meet the counts.
    """
    text = F.coalesce("text", F.lit(""))
    revised = F.regexp_replace(text, "[!$%&#*|]+", "")
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "lang", text.alias("before_text"), revised.alias("after_text")
    )
    counts = token_counts.counted(docs, keep=("doc_id", "source", "lang"))
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(
        F.bool_or(F.col("quality") == 0).alias("bad"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    rows = durable(
        counts.join(labels, "doc_id", "left").select(
            "source", "lang", "before_n", "after_n",
            F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        ),
        "counts",
    )
    none = F.lit(None).cast("array<long>")
    last = F.when(F.col("bad"), F.col("after_n")).otherwise(F.col("before_n"))

    def change(some: DataFrame, before: Column, after: Column) -> DataFrame:
        places = [F.col(c).alias(f"{side}_{c}") for side in token_counts.SIDES for c in ("source", "lang")]
        return some.select(before.alias("before_n"), after.alias("after_n"), *places)

    batches = {
        "1-insert": change(rows, none, F.col("before_n")),
        "2-revise": change(rows.filter("bad"), F.col("before_n"), F.col("after_n")),
        "3-delete": change(rows.filter("toxic"), last, none),
    }
    ledger = scratch_path(spark, "ledger")
    for name in (*batches, "3-delete"):
        token_counts.commit(token_counts.signed_sums(batches[name]), ledger, name)
    return token_counts.totals(token_counts.read_ledger(spark, ledger))


def op9_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(table(spark, sf, "documents"))
    return byte_bpe.with_digests(byte_bpe.decode_documents(encoded))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf, "documents"))


# Windows of 20 words are compared as joined strings.
OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
hashed AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS h FROM starts),
ordered AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM hashed),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ordered WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS text,
         coalesce(regexp_replace(replace(role, '<|', '< |'), '[\r\n]', ' ', 'g'), 'unknown') AS role
  FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
seats AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
s AS (
  SELECT r.conv_id, speaker, place, place // 512 AS part, role = speaker AS own, text,
         concat('<|im_start|>', CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                ELSE concat('user name=', role) END, chr(10)) AS lead
  FROM r JOIN seats ON r.conv_id IS NOT DISTINCT FROM seats.conv_id),
p AS (
  SELECT *, concat(lead, text, '<|im_end|>', chr(10)) AS shown,
         coalesce(sum(length(lead) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead_in
  FROM s)
SELECT conv_id, speaker, part::BIGINT AS part, count(*) AS n_turns,
       string_agg(shown, '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN own THEN concat((lead_in + length(lead))::BIGINT, '+', length(text) + 10) END,
                           ' ' ORDER BY place), '') AS mask
FROM p GROUP BY conv_id, speaker, part"""

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP7 = f"""
WITH d AS (SELECT doc_id, sha256({NORMAL}) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)"""

# The common part of mixing: {docs} gives doc_id, source, text.
MIX = r"""
sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(0.1::DOUBLE, 1::DOUBLE - greatest(0::DOUBLE, coalesce(
           length(regexp_replace(text, '[^!-@\[-`{{-~A-Z]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 1::DOUBLE)
           - 0.25::DOUBLE)) AS quality
  FROM {docs}),
named AS (
  SELECT source, source_size, (source_size * 3)::DOUBLE AS cap,
         [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source))),
found AS (
  SELECT level AS share FROM levels WHERE level * weight <= cap
  ORDER BY cap / weight, level LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT share FROM found) * weight), cap) AS target FROM levels),
keyed AS (
  SELECT doc_id, size, s.source, source_size, target,
         -ln((('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '7')), 1, 12))::BIGINT::DOUBLE + 1)
             / 281474976710657) / quality AS key
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS epochs
  FROM keyed),
mixed AS (
  SELECT doc_id, size, source_size, target,
         (epochs * size + greatest(0, least(size,
           floor(target - epochs * source_size + 0.5)::BIGINT - ahead)))::BIGINT AS taken
  FROM placed)"""

OP9 = "WITH " + MIX.format(docs="documents") + "\nSELECT doc_id, size, source_size, target, taken FROM mixed"

# crc32 byte by byte from a table of its steps; near words share a word with one code point less
# or differ at one place of equal length.
OP13 = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]+')) AS run FROM documents),
seen AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(hex(encode(concat(coalesce(doc_id::VARCHAR, ''), ':', run))), '..'),
             lambda b: concat('0x', b)::BIGINT)),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM seen, steps),
changed AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
close AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, (-near_n, encode(near))) AS near
  FROM close GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
         CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN formed ON root = formed.word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_rotation": op2_chat_rotation,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_lattice_score": op5_lattice_score,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_mix_sources": op9_mix_sources,
    "op10_language": op10_language,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL = {
    "op1_substring_dedup": OP1,
    "op2_chat_rotation": OP2,
    "op7_exact_dedup": OP7,
    "op9_mix_sources": OP9,
    "op13_spelling_variants": OP13,
}
