"""Queries against their SQL on the small tables, and the pipeline stage by stage."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, connect  # noqa: E402
from sigframe.llm import queries  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_whole_tables(spark, name):
    found = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if "doc_id" in found.columns and name != "op4_decontaminate":
        assert found.count() == n == found.select("doc_id").distinct().count()
    else:
        assert found.count() > 0


def test_token_totals(spark):
    """What is left after all batches, counted anew."""
    from sigframe.llm import token_counts

    found = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op8_token_counts(spark, SF).collect()}
    con = connect(SF)
    rows = con.sql("""
      SELECT source, lang, CASE WHEN bool_or(quality = 0) THEN regexp_replace(text, '[!$%&#*|]+', '', 'g') ELSE text END AS t
      FROM documents d LEFT JOIN labels l USING (doc_id)
      GROUP BY doc_id, source, lang, text HAVING NOT coalesce(bool_or(toxic = 1), FALSE)""").fetchall()
    expected = {}
    for source, lang, text in rows:
        encode = token_counts._encoding(token_counts.BPE, token_counts.TOKENIZERS).encode_ordinary
        for name, n in ((token_counts.BPE, len(encode(text))), (token_counts.WORDS, len(text.encode().split()))):
            d, t = expected.get((source, lang, name), (0, 0))
            expected[source, lang, name] = (d + 1, t + n)
    assert found == expected


def test_stages(spark):
    """Each stage's decisions hold on its own input, and all but the last keep the columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        assert all(before[d] == r for d, r in rows.items())
        kept[name] = (before, rows)
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    before, rows = kept["exact_dedup"]
    texts = {}
    for d in sorted(before):
        texts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[d].text or ""), d)
    assert set(rows) == set(texts.values())
    before, rows = kept["near_dedup"]

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {d: shingles(r.text) for d, r in before.items()}
    for a in rows:
        for b in rows:
            if a < b:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    for gone in set(before) - set(rows):
        assert any(len(sets[gone] & sets[x]) >= 0.8 * len(sets[gone] | sets[x]) for x in before if x != gone)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, rows = kept["decontaminate"]
    assert not any(item in r.text for r in rows.values() for item in items)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert mixed and all(0 < r.taken <= 3 * r.size for r in mixed)


def test_pipeline_with_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count(), name
    once = corpus_pipeline.exact_copies(spark, odd_docs, SF).collect()
    ids = sorted(str(r.doc_id) for r in once)
    # 1 stays once, of the texts of 2 the other one, 3 but not 4, and one row without an id.
    assert ids == sorted(["1", "2", "3", "5", "None", "6", "7", "8", "9"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0


def test_clean_texts_under_a_shared_id_stay(spark, prose):
    """Copies and benchmark passages go alone, whatever else has their id or has none."""
    first, other, clean = (" ".join(prose(k, 60)) for k in (71, 72, 73))
    near = first.split()
    near[30] = "edit"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 40").first().text
    rows = [(1, first), (7, " ".join(near)), (7, other), (None, clean), (None, " ".join(near) + " end"),
            (9, f"{other[:99]} {item}"), (9, clean[:200]), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def left(stage):
        return sorted((str(r.doc_id), r.text) for r in stage(spark, docs, SF).collect())

    assert left(corpus_pipeline.near_copies) == sorted((str(rows[k][0]), rows[k][1]) for k in (0, 2, 3, 5, 6, 7))
    assert left(corpus_pipeline.clean_of_benchmark) == sorted(
        (str(rows[k][0]), rows[k][1]) for k in (0, 1, 2, 3, 4, 6)
    )
