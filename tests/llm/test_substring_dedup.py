import hashlib
import random
import re

import pytest

from sigframe.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """Expected (n_words, n_removed, kept text) by id."""
    texts = {d: WORD.findall(t or "") for d, t in docs}
    seen, gone = set(), {d: set() for d in texts}
    for d in sorted(texts):
        w = texts[d]
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[d].update(range(s, s + window))
            seen.add(key)
    return {
        d: (len(w), len(gone[d]), " ".join(x for k, x in enumerate(w) if k not in gone[d]))
        for d, w in texts.items()
    }


def corpus(prose, n=60):
    draw = random.Random(4)
    shared = [prose(1000 + k, draw.randint(12, 70)) for k in range(8)]
    docs = []
    for k in range(n):
        words = prose(k, draw.randint(0, 80))
        for passage in draw.sample(shared, draw.randint(0, 2)):
            cut = draw.randint(0, len(words))
            words[cut:cut] = passage
        if k % 9 == 0:
            words = words + words
        docs.append((n - k, " \n".join(words)))
    docs += [(n + 1, docs[0][1]), (n + 2, " ".join(["again"] * 90)), (n + 3, None)]
    return docs


@pytest.mark.parametrize("window, block, chunk_bytes", [(20, 10, 500), (20, 10, 10**6), (20, 7, 300), (6, 6, 200), (5, 1, 400)])
def test_equals_brute_force(frame, prose, window, block, chunk_bytes):
    docs = corpus(prose)
    found = substring_dedup.remove_repeats(
        frame(docs, "doc_id long, text string"), window, block, chunk_bytes, per_bucket=50
    ).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found}
    assert got == brute(docs, window) and len(found) == len(docs)
    for r in found:
        assert sum(s.length for s in r.spans) == r.n_removed


def test_hot_passage(frame, prose):
    passage = " ".join(prose(1, 30))
    docs = [(k, f"p{k} q{k} {passage}") for k in range(300)]
    found = substring_dedup.remove_repeats(frame(docs, "doc_id long, text string"), chunk_bytes=2000).collect()
    assert {r.n_removed for r in found if r.doc_id} == {30}
    assert [r.n_removed for r in found if r.doc_id == 0] == [0]


def test_odd_rows(odd_docs, no_docs):
    found = substring_dedup.with_digest(substring_dedup.remove_repeats(odd_docs, window=4, block=2)).collect()
    assert len(found) == 13
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    # One of three rows of equal words keeps them; of the two with id 1, either.
    assert sorted(r.n_removed for r in by_id[1]) == [0, 6]
    assert sorted(r.n_removed for r in by_id[2]) == [0, 6]
    assert sorted(r.n_removed for r in by_id[None]) == [0, 5]
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_words, r.kept_sha256) for k in (3, 4, 5) for r in by_id[k]] == [(0, empty)] * 3
    assert by_id[6][0].n_words == 60_000 and by_id[6][0].n_removed == 59_999
    assert by_id[7][0].n_words == 30
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_refuses_blocks_that_do_not_fit(odd_docs):
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(odd_docs, window=5, block=6)
