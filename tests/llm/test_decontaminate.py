import random

import numpy as np
import pyarrow as pa
import pytest

from sigframe.llm import decontaminate


def distance(a, b, most=None):
    """The usual table, row by row; given up once all of a row is above ``most``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def test_edit_distance():
    draw = random.Random(1)
    for _ in range(300):
        a = [draw.randrange(4) for _ in range(draw.randrange(0, 70))]
        b = [draw.randrange(4) for _ in range(draw.randrange(0, 70))]
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontaminate.edit_distance(masks, len(a), b) == distance(a, b)


def edited(words, n, draw):
    words = list(words)
    for _ in range(n):
        k = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[k] = f"new{draw.randrange(999)}"
        elif kind == 1:
            words.insert(k, f"more{draw.randrange(999)}")
        elif len(words) > 1:
            del words[k]
    return words


def corpus(prose, n=120):
    draw = random.Random(3)
    items = [(k, prose(5000 + k, draw.randint(12, 40))) for k in range(8)]
    docs = []
    for k in range(n):
        words = prose(k, draw.randint(0, 40))
        if k % 2:
            at = draw.randint(0, len(words))
            item = items[draw.randrange(len(items))][1]
            words[at:at] = edited(item, draw.randint(0, len(item) // 6), draw)
        docs.append((k, words))
    return items, docs


def brute(items, docs, tolerance):
    found = {}
    for d, w in docs:
        w = [x.strip(",") for x in w]
        for i, t in items:
            t = [x.strip(",") for x in t]
            starts = range(max(1, len(w) - len(t) + 1)) if w else []
            most = int(tolerance * len(t) + 1e-9)
            best = min(((distance(t, w[s : s + len(t)], most), s) for s in starts), default=None)
            if best and best[0] <= int(tolerance * len(t) + 1e-9):
                found[d, i] = best[0]
    return found


@pytest.mark.parametrize("block_bytes", [10**6, 500])
def test_recall_against_brute_force(frame, prose, block_bytes):
    items, docs = corpus(prose)
    rows = decontaminate.find_leaks(
        frame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
        frame([(i, " ".join(t).upper() + ".") for i, t in items], "item_id long, text string"),
        block_bytes=block_bytes,
    ).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    expected = brute(items, docs, 0.2)
    assert len(got) == len(rows) and set(got) <= set(expected) and len(expected) > 50
    assert len(got) >= 0.97 * len(expected)
    assert all(got[k] >= expected[k] for k in got)
    exact = [k for k, d in expected.items() if d == 0]
    assert exact and all(got[k] == 0 for k in exact)


def test_screen_keeps_every_match(prose):
    """The best window of every match is looked at before any hashing."""
    items, docs = corpus(prose, 40)
    block = decontaminate.Items(
        [i for i, _ in items], pa.array([" ".join(t) for _, t in items]), 0.2, decontaminate.Walks()
    )
    for d, w in docs:
        words = decontaminate.plain_words(pa.array([" ".join(w)]))
        looked = set(zip(*(x.tolist() for x in block.windows(words))))
        plain = [x.strip(",") for x in w]
        for i, t in items:
            t = [x.strip(",") for x in t]
            for s in range(max(0, len(plain) - len(t) + 1)):
                most = int(0.2 * len(t) + 1e-9)
                if distance(t, plain[s : s + len(t)], most) <= most:
                    assert (i, s) in looked


def test_walks_of_equal_words_agree():
    walks = decontaminate.Walks()
    words = np.arange(40, dtype=np.uint64)
    both = np.concatenate([words, words])
    keys = walks.keys(both, np.array([0, 40]), np.array([40, 40]), np.array([40, 40]))
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) > 12


def test_odd_rows(odd_docs, no_docs, frame):
    items = frame(
        [(1, "One, two! three four five six"), (2, ""), (None, "no id here at all"), (3, None), (1, "one two three four five six")],
        "item_id long, text string",
    )
    rows = sorted(
        [(r.doc_id, r.item_id, r.start, r.distance) for r in decontaminate.find_leaks(odd_docs, items).collect()],
        key=str,
    )
    assert rows == sorted([(1, 1, 0, 0)] * 4 + [(2, 1, 0, 0)] * 2 + [(None, None, 0, 0)] * 2, key=str)
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).count() == 0
