import functools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigframe.llm import language

PARTS = {
    "en": ["th", "er", "on", "an", "re", "he", "in"],
    "fr": ["le", "eau", "qu", "é", "oi", "ou", "ç"],
    "de": ["sch", "ung", "ein", "ä", "ß", "der", "cht"],
}


def text(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 4))) for _ in range(n))


def tree_of(samples):
    grams, rows = {}, []
    for k, lang in enumerate(samples):
        body = samples[lang].encode()
        for g in language._grams(np.frombuffer(body, np.uint8), np.array([0, len(body)])).tolist():
            grams.setdefault(g, [0] * len(samples))[k] += 1
    keys = sorted(grams)
    counts = np.array([grams[g] for g in keys], float).T
    return language.ContextTree(list(samples), np.array(keys, np.int64), counts)


def brute_bits(train, word):
    """Code length by walking down the contexts, as the method is told."""
    data = b"\0" * 3 + train
    counts = {}
    for i in range(3, len(data)):
        for k in range(4):
            context = counts.setdefault(data[i - k : i], {})
            context[data[i]] = context.get(data[i], 0) + 1

    @functools.cache
    def p(context, byte):
        seen = counts.get(context)
        lower = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        if not seen:
            return lower(byte)
        n, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + kinds)
        rest = sum(lower(b) for b in range(256) if b not in seen)
        return kinds / (n + kinds) * lower(byte) / rest

    data = b"\0" * 3 + word
    return -sum(math.log2(p(data[i - 3 : i], data[i])) for i in range(3, len(data)))


def test_code_lengths_equal_brute_force():
    samples = {lang: text(lang, 12, 1) for lang in PARTS}
    tree = tree_of(samples)
    words = [text("en", 3, 2).encode(), "ça zz7 é".encode(), b"th", b"\xff\x01"]
    body = np.frombuffer(b"".join(words), np.uint8)
    offsets = np.cumsum([0] + [len(w) for w in words])
    found = tree.code_lengths(body, offsets)
    for k, lang in enumerate(samples):
        for j, word in enumerate(words):
            assert found[j, k] == pytest.approx(brute_bits(samples[lang].encode(), word), rel=1e-4)


def test_probabilities_sum_to_one():
    tree = tree_of({"en": text("en", 30, 3)})
    rare = 256 - (tree.size - 1)
    p = np.exp2(-tree.bits[:, :, 0].astype(float))
    assert np.allclose(p[:, :-1].sum(axis=1) + rare * p[:, -1], 1, atol=1e-4)


def test_long_texts_in_parts(monkeypatch):
    tree = tree_of({lang: text(lang, 40, 4) for lang in PARTS})
    texts = pa.array([text("fr", 200, 5), "", text("de", 1, 6), None, text("en", 300, 7)])
    body, offsets = language.column_bytes(texts)
    whole = tree.code_lengths(body, offsets)
    monkeypatch.setattr(language, "_PART", 7)
    assert np.allclose(tree.code_lengths(body, offsets), whole)


def test_held_out_accuracy(frame):
    langs = list(PARTS)
    docs = [(k, text(langs[k % 3], 30, k), langs[k % 3], "s") for k in range(300)]
    found = language.identify(frame(docs, "doc_id long, text string, lang string, source string"), per_language=50)
    rows = found.filter("held_out").collect()
    assert len(rows) > 40
    right = sum(r.lang_pred == langs[r.doc_id % 3] for r in rows)
    assert right >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(frame):
    langs = list(PARTS)
    docs = [(k, text(langs[k % 3], 20, k), langs[k % 3]) for k in range(120)]
    table = frame(docs, "doc_id long, text string, lang string")
    wrong = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang"))
    a, b = (
        sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(t).collect())
        for t in (table, table.withColumn("lang", wrong))
    )
    assert a == b


def test_odd_rows(odd_docs, no_docs):
    found = language.identify(odd_docs, held_out=F.lit(False)).collect()
    assert len(found) == 13
    for r in found:
        none = r.doc_id in (3, 4, 5, 9)
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
    assert {r.lang_pred for r in language.identify(odd_docs, held_out=F.lit(True)).collect()} == {"und"}
    assert language.identify(no_docs).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_samples_are_bounded_without_ids(frame, same):
    """Rows without ids are drawn by text; rows equal in id and text count once."""
    docs = frame([(None, "x" if same else f"text {k}", "en") for k in range(20_000)],
                 "doc_id long, text string, lang string")
    drawn = language.sample_languages(docs, 400).count()
    assert drawn <= 1 if same else 300 < drawn < 500
