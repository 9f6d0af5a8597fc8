"""Words of a structure that breaks weak hashes, and ids that many texts share."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigframe.llm import jaccard_join, lattice, substring_dedup, text


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 8192])
def test_structured_words_differ(n):
    words = text.words_of(pa.array([f"{thue_morse(n)} {thue_morse(n, 'ba')}"]))
    assert len(np.unique(words.hashes)) == 2


def test_range_hashes_tell_ranges_apart():
    codes = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    starts, ends = np.triu_indices(60, 1)
    hashes = text.range_hashes(codes, starts, ends)
    seen = {}
    for a, b, h in zip(starts, ends, hashes.tolist()):
        assert seen.setdefault(h, codes[a:b].tolist()) == codes[a:b].tolist()
    contents = {tuple(codes[a:b].tolist()) for a, b in zip(starts, ends)}
    assert len(seen) == len(contents)


def test_structured_words_are_not_repeats(spark):
    tail = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{thue_morse(1024)} {tail}"), (2, f"{thue_morse(1024, 'ba')} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.with_digest(substring_dedup.remove_repeats(docs)).collect()
    assert [r.n_removed for r in found] == [0, 0]
    assert {r.text_id for r in jaccard_join.near_duplicates(docs).collect()} == {1, 2}


def test_structured_words_are_not_known(spark):
    trained = [k for k in range(200) if k % 3][:60]
    rows = [(k, thue_morse(1024)) for k in trained] + [(k, thue_morse(1024, "ba")) for k in range(1000, 1040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    train = docs.where("crc32(cast(doc_id AS string)) % 7 <> 2")
    known = {r.text for r in train.select("text").distinct().collect()}
    for r in lattice.score_texts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.n_known == (2 if r.text in known else 1)


@pytest.mark.parametrize("ids", ["null", "one"])
def test_near_copies_without_ids(spark, ids):
    """Bodies fetched grow with the texts, not with texts times rows of an id."""
    n = 1000
    base = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(n):
        words = list(base)
        words[-1] = f"end{k}"
        rows.append((None if ids == "null" else 7, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.near_duplicates(docs).groupBy("class_id", "n_links").count().collect()
    assert [tuple(r) for r in found] == [(None if ids == "null" else 7, n - 1, n)]


def test_texts_that_share_an_id_are_told_apart(spark):
    prose = " ".join(f"word{k}" for k in range(40))
    rows = [(1, prose + " one"), (7, prose + " two"), (7, "an unrelated text of some other words"), (7, prose + " two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect())
    assert found == [(1, 1, 1), (7, 1, 1), (7, 1, 1), (7, 7, 0)]
