import datetime as dt
import os
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigframe.operators.ranking import (
    _with_slice, global_rank, group_rank, spread_key, spread_slice,
)


def expected(rows):
    groups = {}
    for g, t, i in rows:
        groups.setdefault(g, []).append((t is not None, t if t is not None else 0.0, i))
    return {
        (g, i): (pos, len(items))
        for g, items in groups.items()
        for pos, (_, _, i) in enumerate(sorted(items))
    }


def got(df):
    return {(r["g"], r["i"]): (r["pos"], r["n"]) for r in df.collect()}


def test_group_rank_with_hot_key_ties_and_nulls(frame):
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(50)), i) for i in range(900)]
    rows += [(f"g{i % 7}", float(rng.randrange(50)), i) for i in range(900, 1100)]
    rows += [(None, 3.0, 2000), (None, 1.0, 2001), ("hot", None, 2002), ("hot", None, 2003)]
    df = frame(rows, "g string, t double, i int")
    for slices in (1, 4, 37):
        ranked = group_rank(df, ["g"], ["t", "i"], "pos", "n", slices=slices)
        assert got(ranked) == expected(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5, 5)), min_size=1, max_size=40))
def test_group_rank_is_row_number(spark, pairs):
    rows = [(g, float(t), i) for i, (g, t) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "g string, t double, i int")
    assert got(group_rank(df, ["g"], ["t", "i"], "pos", "n", slices=5)) == expected(rows)


def test_group_rank_over_whole_table_and_timestamps(spark, frame):
    start = dt.datetime(2024, 3, 31, 0, 0)
    rows = [(start + dt.timedelta(minutes=7 * i), i) for i in range(60)]
    shuffled = random.Random(2).sample(rows, len(rows))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        # A zone whose clock jumps inside the range must not change the order.
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = frame(shuffled, "ts timestamp_ntz, i int")
        ranked = group_rank(df, [], ["ts"], "pos", slices=9).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert all(r["pos"] == r["i"] for r in ranked) and len(ranked) == 60


def largest_window(df, order, slices):
    sliced = _with_slice(df, order, slices)
    return max(r["count"] for r in sliced.groupBy("_slice", "_sub").count().collect())


def test_slices_bound_the_window(frame):
    df = frame([("hot", float(i), i) for i in range(1000)], "g string, t double, i int")
    assert largest_window(df, ["t"], 20) <= 2 * 1000 / 20


def test_crowded_values_are_cut_further(frame):
    # A third of the rows share one time, another third has none.
    rows = [("hot", {0: 7.0, 1: None, 2: float(i % 20)}[i % 3], i) for i in range(1200)]
    rows += [("cold", -0.0, 5000), ("cold", 0.0, 4999), ("cold", float("nan"), 1), ("cold", float("inf"), 2)]
    random.Random(4).shuffle(rows)
    df = frame(rows, "g string, t double, i int")
    assert largest_window(df, ["t", "i"], 20) <= 3 * 1200 / 20
    ranked = {(r["g"], r["i"]): r["pos"] for r in group_rank(df, ["g"], ["t", "i"], "pos", slices=20).collect()}
    hot = sorted((t is not None, t or 0.0, i) for g, t, i in rows if g == "hot")
    assert [ranked["hot", i] for _, _, i in hot] == list(range(1200))
    assert [ranked["cold", i] for i in (4999, 5000, 2, 1)] == [0, 1, 2, 3]


def test_long_values_beyond_double_precision(frame):
    base = 2**60
    rows = [("a", base + i, -i) for i in range(300)]
    df = frame(random.Random(5).sample(rows, 300), "g string, t long, i int")
    ranked = {r["t"]: r["pos"] for r in group_rank(df, ["g"], ["t", "i"], "pos", slices=10).collect()}
    assert ranked == {base + i: i for i in range(300)}


def test_copies_spread_over_runs(spark):
    df = spark.range(0, 4000, 1, 16).selectExpr("IF(id % 3 = 0, 'same', concat('p', id)) AS path")
    ranked = global_rank(df, ["path"], "pos")
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(4000))
    paths = [r["path"] for r in ranked.orderBy("pos").collect()]
    assert paths == sorted(paths)
    placed = spark.read.parquet(os.path.dirname(ranked.inputFiles()[0])).where("path = 'same'")
    assert placed.select(F.shiftright("_row_id", 33)).distinct().count() > 1


def test_global_rank_of_strings(frame):
    names = [f"file_{i:04d}.ogg" for i in range(500)]
    shuffled = random.Random(3).sample(names, len(names))
    ranked = global_rank(frame([(n,) for n in shuffled], "path string"), ["path"], "pos")
    assert {r["path"]: r["pos"] for r in ranked.collect()} == {n: i for i, n in enumerate(names)}


def test_global_rank_of_nothing(frame):
    assert global_rank(frame([], "path string"), ["path"], "pos").count() == 0


def test_spread_slice_follows_the_key(spark):
    df = spark.range(5000).withColumn("k", spread_key("id", 42))
    df = df.withColumn("s", spread_slice(df, "k"))
    rows = sorted((r["k"], r["s"]) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert len({k for k, _ in rows}) > 4990
    assert max(s for _, s in rows) <= 1023
