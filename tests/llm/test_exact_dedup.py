import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.llm import exact_dedup


def digests(n):
    raw = b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(n))
    return np.frombuffer(raw, np.uint8).reshape(-1, 32).copy()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_hash_is_perfect_and_minimal(n):
    keys = digests(n)
    table = exact_dedup.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(n))


def test_unknown_digests_are_told_by_their_bytes():
    keys = digests(3000)
    table = exact_dedup.PerfectHash.build(keys[:1000])
    slots = table.slots(keys[1000:])
    assert ((slots >= -1) & (slots < 1000)).all()
    owners = keys[:1000][np.argsort(table.slots(keys[:1000]))]
    hit = slots >= 0
    assert not (owners[slots[hit]] == keys[1000:][hit]).all(axis=1).any()


def test_equal_digests_are_refused():
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(np.repeat(digests(1), 2, axis=0))


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return sorted(
        (d, min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items()
        for d in g
    )


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id < 700"])
def test_equals_brute_force(frame, history):
    # A third of all rows has one text, which is a hot group.
    rows = [(k, "same \n text" if k % 3 == 0 else f"text  {k % 211}\t{k % 5}") for k in range(1500)]
    seen = F.expr(history) if history else None
    found = exact_dedup.exact_duplicates(frame(rows, "doc_id long, text string"), seen, per_bucket=40)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect())
    assert got == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    found = exact_dedup.exact_duplicates(odd_docs).collect()
    assert len(found) == 13
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert sorted(by_id[1]) == [(1, 3, False), (1, 3, True)]
    assert (1, 3, False) in by_id[2] and (2, 1, True) in by_id[2]
    assert by_id[3] == [(3, 2, True)] and by_id[4] == [(3, 2, False)]
    assert by_id[5] == [(5, 1, True)]  # a text of white space is one space, not empty
    assert sorted(by_id[None]) == [(None, 2, False), (None, 2, True)]
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_very_many_rows_equal_in_id_and_text(frame, monkeypatch):
    """A row's copies are unrolled in runs; every one comes back, one of them kept."""
    monkeypatch.setattr(exact_dedup, "STEP", 100)
    docs = frame([(None, "")] * 3456 + [(1, "a")] * 100 + [(2, "a")] * 101, "doc_id long, text string")
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == 3657 and sum(r.kept for r in rows) == 2
    assert sum(r.doc_id is None and r.group_size == 3456 for r in rows) == 3456
    assert [r.doc_id for r in rows if r.kept and r.doc_id is not None] == [1]
