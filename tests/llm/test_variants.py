import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sigframe.llm import variants


def near_pairs(words):
    """All pairs one edit apart, by deleting each code point."""
    pairs = set()
    holes = {}
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest in words:
                pairs.add(frozenset((w, rest)))
            holes.setdefault((i, rest), []).append(w)
    for group in holes.values():
        pairs |= {frozenset((a, b)) for a in group for b in group if a != b}
    return pairs


def brute(docs, min_count=5, drop=199):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    near = {w: [] for w in n}
    for a, b in map(tuple, near_pairs(set(n))):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def misspelt(seed, n=400):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdéÿ") for _ in range(draw.randint(6, 9))) for _ in range(12)]
    docs = []
    for k in range(n):
        words = []
        for _ in range(30):
            w = draw.choice(stems[: draw.randint(1, 12)])
            if draw.random() < 0.3:
                i = draw.randrange(len(w))
                w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abcdé") + w[i:], w[:i] + draw.choice("abcdé") + w[i + 1 :]])
            words.append(w.upper() if draw.random() < 0.1 else w)
        docs.append((k, "12 ".join(words)))
    return docs


@pytest.mark.parametrize("part_words", [20_000, 3])
def test_like_brute_force(spark, part_words):
    docs = misspelt(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = rows_of(variants.spelling_variants(df, part_words=part_words))
    assert found == brute(docs) and any(r[1] for r in found) and any(r[1] and r[2] != r[1] for r in found)


def test_hot_prefixes_and_suffixes_are_cut(spark):
    """A third of the words share a long prefix and suffix; no part keeps them together."""
    draw = random.Random(2)
    hot = {"inter" + "".join(draw.choice("abcd") for _ in range(3)) + "ations" for _ in range(60)}
    words = sorted(hot | {"".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(120)})
    vocabulary = spark.createDataFrame([(w, 5 + k % 7) for k, w in enumerate(words)], "word string, n long")
    keyed = variants.parts(vocabulary, part_words=8).cache()
    sizes = keyed.where("NOT stuck").groupBy(*variants._PART).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 8
    found = {r.word: r.n_near for r in variants.near_words(keyed).collect()}
    want = Counter(w for pair in near_pairs(set(words)) for w in pair)
    assert found == dict(want)


def test_composition_against_brute_force():
    draw = random.Random(3)
    for _ in range(200):
        words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(1, 80))})
        places = draw.choice([1, 2, 3, variants.ANYWHERE])
        blocks = variants.Composition(variants.Acceptor(words)).pairs(places)
        found = [frozenset((words[a + t], words[b + t])) for a, b, n in blocks for t in range(n)]

        def first_difference(pair):
            a, b = sorted(pair, key=len)
            return next((i for i in range(len(a)) if a[i] != b[i]), len(a))

        assert len(found) == len(set(found))
        assert set(found) == {p for p in near_pairs(set(words)) if first_difference(p) < places}


def test_acceptor_is_minimal():
    a = variants.Acceptor(sorted(x + y for x in ("ab", "cd", "ef") for y in ("ing", "ings", "ed")))
    # The start, a state behind each first letter, and six for the endings they share.
    assert len(a.arcs) == 1 + 3 + 6 and a.size[a.start] == 9


def test_best_near_word_and_ties():
    words = ["aaaaaa", "aaaaab", "aaaaac", "aaaaad"]
    n_near, best = variants.near_in_part(words, np.array([5, 30, 30, 10]), variants.ANYWHERE)
    assert n_near.tolist() == [3, 3, 3, 3] and [words[b][-1] for b in best] == ["b", "c", "b", "b"]


def test_very_long_words(spark):
    long = "x" * 30_000
    docs = [(k, f"{long} {long}y {long}") for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.n, r.n_near) for r in variants.spelling_variants(df, drop_every=None).collect()}
    assert found == {(10, 1), (5, 1)}


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()] * 3
    df = odd_docs.unionByName(odd_docs).unionByName(odd_docs)
    assert rows_of(variants.spelling_variants(df)) == brute(docs)
    assert variants.spelling_variants(no_docs).count() == 0


def test_form_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("v", "w3")], "word string, form string")
    assert {(r.word, r.root) for r in variants.last_forms(forms).collect()} == {(w, "w9") for w in [f"w{k}" for k in range(9)] + ["v"]}
