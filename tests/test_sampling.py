import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigframe.operators import sampling


def test_filter_rare_classes(frame):
    df = frame([("a",), ("b",), ("b",), ("c",), ("c",), ("c",), (None,)], "label string")
    assert Counter(r[0] for r in sampling.filter_rare_classes(df, "label").collect()) == {"b": 2, "c": 3}


def test_subset_classes(frame):
    df = frame([("123",), ("b1",), ("a",), ("c",), ("a",)], "label string")
    assert sorted(r[0] for r in sampling.subset_classes(df, "label", 2).collect()) == ["a", "a", "b1"]
    assert sorted(r[0] for r in sampling.subset_classes(df, "label", 2, letters_only=False).collect()) == ["123", "a", "a"]


def test_hash_sample_matches_zlib(frame):
    names = [f"soundscape_{i}" for i in range(200)]
    df = frame([(n,) for n in names], "name string")
    kept = {r[0] for r in sampling.hash_sample(df, "name", 10).collect()}
    assert kept == {n for n in names if zlib.crc32(n.encode()) % 10 == 0}


def test_round_robin_and_fewer_files_than_parts(frame):
    df = frame([("c",), ("a",), ("b",)], "path string")
    parts = {r["path"]: r["part"] for r in sampling.assign_round_robin(df, ["path"], 2).collect()}
    assert parts == {"a": 0, "b": 1, "c": 0}
    parts = {r["path"]: r["part"] for r in sampling.assign_round_robin(df, ["path"], 200).collect()}
    assert parts == {"a": 0, "b": 1, "c": 2}


def test_limits(frame):
    df = frame([("c", 0), ("a", 1), ("b", 2)], "path string, part int")
    assert sampling.limit_parts(df, 1).count() == 1
    assert sampling.limit_parts(df, -1).count() == 3
    assert [r["path"] for r in sampling.limit_files(df, ["path"], 2).collect()] == ["a", "b"]
    assert sampling.limit_files(df, ["path"], None).count() == 3


def test_limits_go_by_position(frame):
    df = frame([(f"f{i:03d}",) for i in range(100)], "path string").repartition(7)
    found = sorted(r["path"] for r in sampling.limit_files(df, ["path"], 60).collect())
    assert found == [f"f{i:03d}" for i in range(60)]


def sides(train, test):
    return Counter(r["label"] for r in train.collect()), Counter(r["label"] for r in test.collect())


def test_split_keeps_shares_and_one_row_each_side(frame):
    rows = [("one", 1), *[("two", 10 + i) for i in range(2)], *[("three", 20 + i) for i in range(3)],
            *[("many", 100 + i) for i in range(100)]]
    df = frame(rows, "label string, id long")
    train, test = sides(*sampling.stratified_split(df, "label", "id", 0.2, 1))
    assert test == {"two": 1, "three": 1, "many": 20}
    assert train == {"one": 1, "two": 1, "three": 2, "many": 80}


def test_split_depends_on_seed_only(frame):
    df = frame([("a", f"id{i}") for i in range(50)], "label string, id string")

    def chosen(seed, parts):
        return {r["id"] for r in sampling.stratified_split(df.repartition(parts), "label", "id", 0.2, seed)[1].collect()}

    assert chosen(1, 3) == chosen(1, 7)
    assert chosen(1, 3) != chosen(2, 3)
    assert len(chosen(1, 3)) == 10


@pytest.mark.parametrize("kind", ["long", "string"])
def test_seeds_are_independent(frame, kind):
    df = frame([("a", i if kind == "long" else f"id{i}") for i in range(4000)], f"label string, id {kind}")

    def chosen(seed):
        return {r["id"] for r in sampling.stratified_split(df, "label", "id", 0.2, seed)[1].collect()}

    first = chosen(42)
    for seed in (43, 76):
        assert 0.15 < len(first & chosen(seed)) / len(first) < 0.25


def test_split_by_group_does_not_leak(frame):
    df = frame([("a", i, f"f{i // 4}") for i in range(80)], "label string, id long, file string")
    train, test = sampling.stratified_split(df, "label", "id", 0.25, 3, group="file")
    assert not {r["file"] for r in train.collect()} & {r["file"] for r in test.collect()}
    assert test.count() == 20 and train.count() == 60


def test_folds_are_even(frame):
    df = frame([("a", i) for i in range(23)] + [("b", 100 + i) for i in range(7)], "label string, id long")
    counts = Counter((r["label"], r["fold"]) for r in sampling.stratified_folds(df, "label", "id", 5).collect())
    for label, n in (("a", 23), ("b", 7)):
        assert sorted(counts[label, k] for k in range(5)) == sorted(n // 5 + (k < n % 5) for k in range(5))


def test_sample_size(frame):
    df = frame([(100000,), (1,), (50,)], "n long")
    got = [r[0] for r in df.select(sampling.needed_sample(F.col("n"), 95, 2.0)).collect()]
    assert got == [2345, 1, 49]
    with pytest.raises(ValueError):
        sampling.needed_sample(F.col("n"), 80)


def test_shuffle_keeps_rows(spark):
    assert sorted(r[0] for r in sampling.shuffle_rows(spark.range(100), 1).collect()) == list(range(100))
