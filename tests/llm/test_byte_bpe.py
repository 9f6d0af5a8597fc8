import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sigframe.llm import byte_bpe, queries

RANKS = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(spark, library, docs, **sizes):
    encoded = byte_bpe.encode_documents(docs, **sizes)
    found = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in byte_bpe.decode_documents(encoded).collect())
    want = [(str(r.doc_id), r.text or "") for r in docs.collect()]
    assert found == sorted((d, library.encode_ordinary(t), t.encode()) for d, t in want)


def test_like_the_library(spark, library, odd_docs):
    check(spark, library, odd_docs)


def test_many_chunks_and_buckets(spark, library, prose):
    texts = [" ".join(prose(k, 40)) + "\n\n  tab\t don't 2024 " + chr(0x4E00 + k) * 3 + "🎉é" for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    check(spark, library, docs, chunk_bytes=300, bucket_bytes=500)


def test_empty(spark, library, no_docs):
    assert byte_bpe.encode_documents(no_docs).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None), (None, "")], "doc_id long, text string")
    check(spark, library, blank)


def test_bytes_that_are_not_utf8(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF62")).cast("string").alias("text"))
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).first().decoded
    assert bytes(decoded).decode() == "a�b"


def test_words_of_every_kind(library):
    words = ["a" * 5000, "ab" * 3000, "lowliness", "Überraschungen", "\x00\x7f", " 　", "é" * 77, "aaaaaaa", "🎉🎉"]
    for word in words:
        assert byte_bpe.merge_bytes(word.encode(), RANKS) == library._encode_single_piece(word.encode())


def test_pattern_for_all_characters(library):
    """The pattern splits around every character as the library's own engine does."""
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)} b"
            assert [i for w in find(text) for i in byte_bpe.merge_bytes(w.encode(), RANKS)] == library.encode_ordinary(text)


def test_a_word_is_merged_once(spark, monkeypatch, tmp_path):
    log = tmp_path / "merged"

    def counted(word, ranks, merge=byte_bpe.merge_bytes):
        with open(log, "ab") as out:
            out.write(word + b"\n")
        return merge(word, ranks)

    monkeypatch.setattr(byte_bpe, "merge_bytes", counted)
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["sigframe.llm.byte_bpe"])
    try:
        docs = spark.createDataFrame([(k, "the same words in all texts") for k in range(50)], "doc_id long, text string").repartition(5)
        assert byte_bpe.encode_documents(docs, chunk_bytes=50, bucket_bytes=200).count() == 50
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["sigframe.llm.byte_bpe"])
    merged = log.read_bytes().split(b"\n")[:-1]
    assert sorted(merged) == sorted([b"the", b" same", b" words", b" in", b" all", b" texts"])


def test_unknown_ids_raise(spark):
    bad = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode_documents(bad).collect()
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode_documents(none).first().decoded) == b""


def test_query_on_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        listed, text = ",".join(map(str, ids)).encode(), (r.text or "").encode()
        want[r.doc_id] = (len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())
    assert found == want
