import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.llm import lattice

VOCABULARY = [(b, float(k)) for k, b in enumerate(
    [b" ", b"a", b"b", b"c", b"ab", b" a", b" ab", b"bc", b"abc", b"cab", b" cab", b"\xc3\xa9"]
)]


@pytest.fixture
def small():
    return lattice.Pieces(sorted(VOCABULARY))


def by_surface(pieces):
    table = {}
    for data, rank in sorted(VOCABULARY):
        k = int(np.flatnonzero(pieces.ranks == rank)[0])
        table[data] = k
    return table


def spelled(word, log_p, table):
    """Sum over all segmentations, one by one."""
    text = b" " + word

    def ways(at):
        if at == len(text):
            return [0.0]
        return [
            log_p[table[text[at:end]]] + rest
            for end in range(at + 1, len(text) + 1)
            if text[at:end] in table
            for rest in ways(end)
        ]

    return sum(math.exp(x) for x in ways(0))


def test_forward_sums_all_segmentations(small):
    words = [b"abcab", b"a", b"cab", b"b", b"abcabcabc", b"c\xc3\xa9a"]
    log_p = small.start()
    found = small.lattice(words)
    total = found.forward(log_p[:-1, None])[found.last][:, 0]
    table = by_surface(small)
    for word, value in zip(words, total):
        assert math.exp(value) == pytest.approx(spelled(word, log_p, table), rel=1e-9)


def test_expected_uses(small):
    """Uses are derivatives of the log probability by the pieces' scores."""
    words, log_p = [b"abcab", b"cab", b"abab"], small.start()[:-1, None]
    found = small.lattice(words)
    uses = found.expected(log_p)
    step = 1e-6
    for k in range(len(uses)):
        up, down = log_p.copy(), log_p.copy()
        up[k] += step
        down[k] -= step
        slope = (found.forward(up)[found.last] - found.forward(down)[found.last]).sum() / (2 * step)
        assert uses[k] == pytest.approx(slope, abs=1e-5)


def test_start_is_normalised(small):
    p = np.exp(small.start())
    assert p[:-1][small.opening].sum() == pytest.approx(1)
    assert p[:-1][~small.opening].sum() + p[-1] == pytest.approx(1)


def test_spellings_sum_to_one():
    """All words up to some length have nearly all the probability."""
    pieces = lattice.Pieces([(b" ", 1.0), (b" a", 2.0), (b"a", 9.0), (b"b", 9.0), (b"ab", 20.0)])
    log_p = pieces.normalised(np.ones(5), 6.0)
    words = [b""]
    total = 0.0
    for _ in range(9):
        words = [w + c for w in words for c in (b"a", b"b")]
        found = pieces.lattice(words)
        total += np.exp(found.forward(log_p[:-1, None])[found.last][:, 0] + log_p[-1]).sum()
    # The empty word, a blank alone, has the rest.
    empty = math.exp(log_p[np.flatnonzero(pieces.ranks == 1.0)[0]] + log_p[-1])
    assert total + empty == pytest.approx(1, abs=2e-3)


def tokens(text):
    return (text or "").encode().lower().split()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_base_score_equals_brute_force(frame, prose):
    docs = [(k, " \n".join(prose(k, 5 + k % 90)).title(), "en" if k % 3 else "de") for k in range(150)]
    docs += [(200, "", "en"), (201, None, None)]
    found = lattice.score_texts(
        frame(docs, "doc_id long, text string, lang string"), chunk_bytes=900, per_bucket=60
    ).collect()
    train = [d for d in docs if not held(d[0])]
    counts = Counter(t for d in train for t in tokens(d[1]))
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    assert len(found) == len(docs)
    texts = {d[0]: d[1] for d in docs}
    for r in found:
        words = tokens(texts[r.doc_id])
        each = [counts[w] for w in words] + [len(train)]
        assert r.held_out == held(r.doc_id) and r.train_tokens == total
        assert r.n_tokens == len(words) + 1 and r.n_known == sum(c > 0 for c in each)
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in each)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_score_equals_brute_force(frame, prose, monkeypatch):
    """The whole model by hand: discounted words, spellings, languages."""
    monkeypatch.setattr(lattice, "read_vocabulary", lambda path: sorted(
        [(b" ", 1.0), *[(bytes([b]), 50.0) for b in range(33, 123)], (b"ba", 3.0), (b" ba", 4.0), (b"nd", 5.0)]
    ))
    docs = [(k, " ".join(prose(k, 20)), "en" if k % 3 else None) for k in range(60)]
    docs.append((100, "unseen wordsba", "en"))
    found = lattice.score_texts(
        frame(docs, "doc_id long, text string, lang string"),
        held_out=F.col("doc_id") >= 50, rounds=0, chunk_bytes=400, per_bucket=30,
    ).collect()
    pieces = lattice.Pieces(lattice.read_vocabulary(""))
    log_p = pieces.start()
    def p_word(word, counts, texts):
        once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
        discount = min(0.9, max(0.1, (once + 0.5) / (once + 2 * twice + 1)))
        lat = pieces.lattice([word])
        spell = math.exp(lat.forward(log_p[:-1, None])[lat.last][0, 0] + log_p[-1])
        mass = max(counts[word] - discount, 0) + discount * len(counts) * spell
        return mass / (sum(counts.values()) + texts)
    train = [d for d in docs if d[0] < 50]
    langs = [None, "en"]
    models = [
        (Counter(t for d in train if d[2] == l for t in tokens(d[1])), sum(d[2] == l for d in train))
        for l in langs
    ]
    for r in found:
        text = next(d[1] for d in docs if d[0] == r.doc_id)
        total = 0.0
        for counts, texts in models:
            p = texts / len(train) * texts / (sum(counts.values()) + texts)
            for word in tokens(text):
                p *= p_word(word, counts, texts)
            total += p
        assert r.score == pytest.approx(math.log10(total), rel=1e-5)


def test_fitting_helps(frame, prose):
    docs = [(k, " ".join(w + prose(k + j, 2)[0] for j, w in enumerate(prose(k, 40))), "en") for k in range(80)]
    table = frame(docs, "doc_id long, text string, lang string")
    sums = [
        lattice.score_texts(table, rounds=n).filter("held_out").agg(F.sum("score")).first()[0]
        for n in (0, 2)
    ]
    assert sums[1] > sums[0]


def test_odd_rows(odd_docs, no_docs):
    found = lattice.score_texts(odd_docs).collect()
    assert len(found) == 13
    ends = [r for r in found if r.doc_id in (3, 4, 5)]
    assert {r.n_tokens for r in ends} == {1} and len({r.score for r in ends}) == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert lattice.score_texts(no_docs).count() == 0


def test_nothing_to_learn_from(odd_docs):
    found = lattice.score_texts(odd_docs, held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in found)
