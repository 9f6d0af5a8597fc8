import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sigframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(5, 2, 1), cap=3):
    """Cut at the cap and share out again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(frame, seed):
    draw = random.Random(seed)
    sizes = {f"s{k}é"[: 1 + k % 4] + str(k): draw.choice([0, 3, 50, 1000, 40_000]) for k in range(draw.randint(1, 9))}
    sizes[None] = draw.randint(0, 500)
    rows = mixing.source_targets(frame(list(sizes.items()), "source string, source_size long")).collect()
    expected = expected_targets(sizes)
    assert {r.source: r.source_size for r in rows} == sizes
    for r in rows:
        assert r.target == pytest.approx(expected[r.source], rel=1e-9, abs=1e-9)


def corpus(n=900):
    draw = random.Random(8)
    names = ["a"] * 12 + ["b", "c", "d", None]
    return [(k, " ".join(["w"] * draw.randint(0, 60)), draw.choice(names)) for k in range(n)]


@pytest.mark.parametrize("per_slice", [2000, 7])
def test_mix(frame, per_slice):
    docs = corpus()
    table = frame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_sources(table, quality=F.lit(0.5), per_slice=per_slice).collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    targets = expected_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(targets[s], abs=1)
        epochs = min(3, math.floor(targets[s] / sizes[s] + 1e-12))
        extra = [r.taken - epochs * r.size for r in own]
        # Whole epochs come first; of the next one documents are whole, none, or the last.
        assert all(0 <= x <= r.size for x, r in zip(extra, own))
        assert sum(0 < x < r.size for x, r in zip(extra, own)) <= 1
    again = mixing.mix_sources(table.repartition(7), quality=F.lit(0.5), per_slice=50).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_quality_draws_more_often(frame):
    docs = [(k, "w " * 10, "a") for k in range(1200)] + [(9000 + k, "w " * 10, "b") for k in range(5000)]
    table = frame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_sources(table, quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)).collect()
    drawn = [r for r in rows if r.source == "b"]
    assert len({r.taken // 10 for r in drawn}) > 1
    even = sum(r.taken for r in drawn if r.doc_id % 2 == 0)
    odd = sum(r.taken for r in drawn if r.doc_id % 2)
    assert even > 1.5 * odd


def test_no_python_in_the_plan(frame):
    plan = mixing.mix_sources(frame(corpus(30), "doc_id long, text string, source string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == 13 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert len({r.source for r in rows}) == 6
    total = sum(r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(total, abs=6)
    assert mixing.mix_sources(no_docs).count() == 0
