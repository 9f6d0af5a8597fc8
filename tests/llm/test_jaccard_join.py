import random
from collections import defaultdict

import numpy as np
import pytest

from sigframe.llm import forest, jaccard_join
from sigframe.llm.components import connected_components


def brute(docs, threshold, size):
    """Class id and number of linked texts by document."""
    sets = {}
    for d, t in docs:
        w = (t or "").split()
        sets[d] = frozenset(
            tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))
        ) if w else frozenset()
    texts = defaultdict(list)
    for d, s in sets.items():
        texts[s].append(d)
    full = [s for s in texts if s]
    links = {s: [t for t in full if t != s and len(s & t) >= threshold * len(s | t)] for s in full}
    result = {d: (d, d, 0) for d, s in sets.items() if not s}
    done = set()
    for s in full:
        if s in done:
            continue
        group, todo = {s}, [s]
        while todo:
            for t in links[todo.pop()]:
                if t not in group:
                    group.add(t)
                    todo.append(t)
        done |= group
        root = min(min(texts[t]) for t in group)
        for t in group:
            for d in texts[t]:
                result[d] = (root, min(texts[t]), len(links[t]))
    return result


def corpus(prose, draw, copies, words=70):
    docs = []
    for g in range(12):
        base = prose(g, words)
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = f"edit{draw.randrange(10**6)}"
            docs.append(text)
    docs += [prose(99, 3), prose(99, 3), ["word"], [], []]
    draw.shuffle(docs)
    return [(k, "  ".join(t)) for k, t in enumerate(docs)]


@pytest.mark.parametrize("block", [400, 5])
def test_equals_brute_force(frame, prose, block):
    docs = corpus(prose, random.Random(2), 18)
    found = jaccard_join.near_duplicates(
        frame(docs, "doc_id long, text string"), trees=32, recall=0.9999, block=block
    ).collect()
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in found}
    assert got == brute(docs, 0.8, 5) and len(found) == len(docs)


def test_recall_at_the_threshold(frame, prose):
    """Pairs just above the threshold are found as often as promised."""
    docs = []
    for k in range(400):
        base = prose(1000 + k, 100)
        other = list(base)
        other[20] = f"a{k}"
        other[70] = f"b{k}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    found = jaccard_join.near_duplicates(frame(docs, "doc_id long, text string")).collect()
    linked = sum(r.n_links for r in found) / 2
    expected = sum(n for _, _, n in brute(docs, 0.8, 5).values()) / 2
    assert expected >= 390 and linked >= 0.97 * expected


def test_depth_follows_recall():
    assert forest.prefix_depth(0.8, 16, 12, 0.99) == 6
    assert forest.prefix_depth(0.8, 16, 12, 0.9999) < 6
    assert forest.prefix_depth(0.99, 16, 12, 0.99) == 12


def test_prefixes_are_shortened_by_text():
    """The stop of a text follows from the least similarity that its size allows."""
    made = forest.Forest(0.8, 16, 12, 0.99)
    for n in range(1, 60):
        able = [i / u for i in range(1, n + 1) for u in range(n, 2 * n + 2) if 0.8 <= i / u < 1]
        assert forest.least_similarity(n, 0.8) == pytest.approx(min(able)) if able else (
            forest.least_similarity(n, 0.8) is None
        )
    assert made.depths(np.array([0, 1, 3, 4, 6, 7, 90, 10**6])).tolist() == [0, 0, 0, 6, 7, 8, 6, 6]


def _grouped(a_b, nodes):
    roots = {n: n for n in nodes}

    def top(n):
        while roots[n] != n:
            n = roots[n]
        return n

    for a, b in a_b:
        roots[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("tasks", [1, 7])
def test_links_equal_tries(spark, frame, tasks):
    """Links join what shares a prefix as long as the stops of both; deep ones come first."""
    made = forest.Forest(0.8, 3, 12, 0.99)
    made.stops[:] = np.resize([2, 2, 4, 7], len(made.stops))
    draw = np.random.default_rng(5)
    # Few labels, so that runs of every depth occur; a third of the texts have one signature.
    labels = draw.choice(2, (300, 36), p=[0.9, 0.1]).astype(">u2")
    labels[:100] = 7
    stops = [[2, 2, 4, 7][k % 4] for k in range(300)]
    rows = [(int(k * 37 % 301), bytearray(labels[k].tobytes()), stops[k]) for k in range(300)]
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        found = forest.trie_links(frame(rows, "node long, signature binary, stop int"), made).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    wanted = []
    for tree in range(3):
        part = labels[:, tree * 12 : tree * 12 + 12]
        for i in range(300):
            for j in range(i):
                d = max(stops[i], stops[j])
                if (part[i, :d] == part[j, :d]).all():
                    wanted.append((rows[i][0], rows[j][0]))
    nodes = [r[0] for r in rows]
    assert _grouped([(r.a, r.b) for r in found], nodes) == _grouped(wanted, nodes)
    depths = {r.depth for r in found}
    assert 12 in depths and min(depths) == 2 and len(found) < 4 * 300 * 3


def test_near_copies_without_ids(frame, prose):
    """A hot group of near copies with null ids: every text once, each linked to others."""
    docs = []
    for k in range(1500):
        text = prose(5, 60)
        text[k % 50] = f"edit{k}"
        docs.append((None, " ".join(text)))
    docs += [(k, " ".join(prose(500 + k, 60))) for k in range(500)]
    found = jaccard_join.near_duplicates(frame(docs, "doc_id long, text string")).collect()
    assert len(found) == 2000
    assert sum(r.doc_id is None and r.n_links > 0 for r in found) == 1500
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in found if r.doc_id is not None)


def test_odd_rows(odd_docs, no_docs):
    found = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(found) == 13
    rows = sorted(((r.doc_id, r.class_id, r.text_id, r.n_links) for r in found), key=str)
    assert rows.count((1, 1, 1, 0)) == 2 and (2, 1, 1, 0) in rows and (2, 2, 2, 0) in rows
    assert {(3, 3, 3, 0), (4, 4, 4, 0), (5, 5, 5, 0)} <= set(rows)
    assert rows.count((None, None, None, 0)) == 2
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_components(frame):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, k) for k in range(1001, 1200)]
    edges = frame(chain + star + [(5, 5), (3, 2)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1200)}
    assert connected_components(edges.limit(0)).count() == 0
