import re
from collections import Counter

import pytest

from sigframe.llm import token_counts as tc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "before_text string, before_source string, before_lang string, "
    "after_text string, after_source string, after_lang string, tokens int"
)


def count(name, text):
    if name == tc.WORDS:
        return len(WORD.findall(text))
    return len(tc._encoding(name, tc.TOKENIZERS).encode_ordinary(text))


def brute(changes):
    total = Counter()
    for change in changes:
        for (text, source, lang), sign in ((change[:3], -1), (change[3:6], 1)):
            if text is not None:
                for name in (tc.BPE, tc.WORDS):
                    total[source, lang, name, "documents"] += sign
                    total[source, lang, name, "tokens"] += sign * count(name, text)
    return {k: v for k, v in total.items() if v}


def rows_of(df):
    return {
        (r.source, r.lang, r.tokenizer, kind): r[kind]
        for r in df.collect()
        for kind in ("documents", "tokens")
        if r[kind]
    }


def changes(prose):
    none = (None, None, None)
    texts = [" ".join(prose(k, 3 + k % 40)) for k in range(90)]
    place = lambda k: (["a", "b", None][k % 3], ["en", None][k % 2])
    inserts = [(*none, t, *place(k), 1) for k, t in enumerate(texts)]
    revisions = [(texts[k], *place(k), texts[k][: k * 3], *place(k + 1), 1) for k in range(0, 90, 4)]
    deletes = [(texts[k], *place(k), *none, 1) for k in range(1, 90, 4)]
    odd = [(*none, "", "a", "en", 1), (*none, *none, 1), (*none, " \n", None, None, 1), (*none, "é" * 9000, "z", "fr", 1)] * 2
    return [inserts, revisions, deletes, odd]


def test_deltas_equal_brute_force(frame, prose):
    every = [c for batch in changes(prose) for c in batch]
    assert rows_of(tc.deltas(frame(every, SCHEMA))) == brute(every)


def test_totals_of_retried_batches(spark, frame, prose, tmp_path):
    ledger = str(tmp_path / "ledger")
    batches = changes(prose)
    for k in (0, 1, 0, 2, 2, 3, 1):
        tc.commit(tc.deltas(frame(batches[k], SCHEMA)), ledger, f"b{k}")
    every = [c for batch in batches for c in batch]
    assert rows_of(tc.totals(tc.read_ledger(spark, ledger))) == brute(every)


def test_taking_back_everything_leaves_nothing(spark, frame, prose, tmp_path):
    ledger = str(tmp_path / "ledger")
    inserts = changes(prose)[0]
    undone = [(*c[3:6], *c[:3], 1) for c in inserts]
    tc.commit(tc.deltas(frame(inserts, SCHEMA)), ledger, "in")
    tc.commit(tc.deltas(frame(undone, SCHEMA)), ledger, "out")
    assert tc.totals(tc.read_ledger(spark, ledger)).count() == 0


def test_empty_batch(spark, frame, tmp_path):
    ledger = str(tmp_path / "ledger")
    tc.commit(tc.deltas(frame([], SCHEMA)), ledger, "none")
    assert tc.totals(tc.read_ledger(spark, ledger)).count() == 0


@pytest.mark.parametrize("name", [tc.BPE, "byte_bpe_multi_50k"])
def test_other_tokenizers(frame, name):
    found = tc.deltas(frame([(None, None, None, "some text", "a", "en", 1)], SCHEMA), (name,)).collect()
    assert [(r.tokenizer, r.tokens) for r in found] == [(name, count(name, "some text"))]


def test_batches_larger_than_a_piece(frame):
    """Texts of several megabytes, most of them the same on both sides."""
    texts = [f"é{k} ß" * (1000 + k) for k in range(400)]
    every = [(t, "a", "en", t if k % 3 else t[: k * 7], "a", "en", 1) for k, t in enumerate(texts)]
    assert rows_of(tc.deltas(frame(every, SCHEMA))) == brute(every)
