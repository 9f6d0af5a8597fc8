import math

import pytest
from pyspark.sql import functions as F

from sigframe.functions import arrays, paths


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    "path, first, second, parent, cls, stem",
    [
        ("train_audio/asbfly/x1.ogg", "train_audio", "asbfly", "asbfly", "asbfly", "x1"),
        ("/data/train_audio/b/2.ogg", "/", "data", "b", "b", "2"),
        ("a/train_audio/c/train_audio/d/f.ogg", "a", "train_audio", "d", "c", "f"),
        ("a//b/./c.ogg", "a", "b", "b", None, "c"),
        ("frogg.ogg", "frogg.ogg", None, None, None, "frogg"),
        ("x/123", "x", "123", "x", None, "123"),
        ("train_audio/train_audio/y.ogg", "train_audio", "train_audio", "train_audio", "", "y"),
    ],
)
def test_path_parts(frame, path, first, second, parent, cls, stem):
    df = frame([(path,)], "p string")
    row = df.select(
        paths.path_part("p", 0), paths.path_part("p", 1), paths.parent_name("p"),
        paths.class_after_marker("p"), paths.stem("p"),
    ).first()
    assert tuple(row) == (first, second, parent, cls, stem)


def test_null_path_stays_null(frame):
    df = frame([(None,)], "p string")
    row = df.select(
        paths.path_part("p", 0), paths.parent_name("p"), paths.class_after_marker("p"),
        paths.stem("p"), paths.row_id("p", F.lit(5.0)),
    ).first()
    assert list(row) == [None] * 5


def test_row_id_cuts_towards_zero(frame):
    df = frame([("a/b_1.ogg", 5.0), ("a/b_1.ogg", 9.96), ("c.ogg", 10.0)], "f string, e double")
    assert one(df, paths.row_id("f", "e")) == ["b_1_5", "b_1_9", "c_10"]


def test_relative_and_concat(frame):
    df = frame([("/root/in/a/b.ogg",), ("/root/inner/a",)], "p string")
    assert one(df, paths.relative_path("p", "/root/in")) == ["a/b.ogg", "/root/inner/a"]
    assert one(df.limit(1), paths.concat_path("/r/", F.lit("train_audio"), F.lit("x"))) == [
        "/r/train_audio/x"
    ]


def test_names(frame):
    df = frame([("asbfly",), ("1139490",), ("é",)], "n string")
    assert one(df, paths.has_letter("n")) == [True, False, True]
    df = frame([(0,), (42,), (12345,)], "n int")
    assert one(df, paths.part_name("n")) == ["part_0000", "part_0042", "part_12345"]


def test_clip_step_and_codes(frame):
    df = frame([(3.0,), (2.0,), (5.0,), (0.96,)], "w double")
    assert one(df, paths.clip_step_for("w")) == [1.0, 1.0, 5.0, 0.96]
    df = frame([("Aves",), ("Mammalia",), ("Reptilia",), (None,)], "c string")
    assert one(df, paths.code_for("c")) == [0, 3, None, None]


def test_time_bucket_edges(frame):
    times = [0.0, 4.999, 5.0, 99.999, 100.0, -0.001, float("nan"), None, float("inf")]
    df = frame([(t,) for t in times], "t double")
    assert one(df, arrays.time_bucket("t")) == [0, 0, 5, 95, -1, -1, -1, -1, -1]
    assert one(df.limit(5), arrays.time_bucket("t", 5, None)) == [0, 0, 5, 95, 100]
    # The last bucket that starts before the limit is whole.
    df = frame([(98.0,), (104.9,), (105.0,)], "t double")
    assert one(df, arrays.time_bucket("t", 7, 100)) == [98, 98, -1]


def test_array_functions(frame):
    df = frame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert one(df, arrays.l2_distance("a", "b")) == [25.0]
    assert one(df, arrays.l2_normalize("a")) == [[0.6, 0.8]]
    assert one(df, arrays.l2_normalize("b")) == [[0.0, 0.0]]
    assert one(df, arrays.relu(F.array(F.lit(-1.0), F.lit(2.0)))) == [[0.0, 2.0]]


def test_distance_of_ragged_vectors_is_null(frame):
    df = frame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert one(df, arrays.l2_distance("a", "b")) == [None]


def test_softmax_is_stable(frame):
    df = frame([([1000.0, 1000.0],), ([-1000.0, 0.0],), (None,)], "v array<double>")
    first, second, third = one(df, arrays.softmax("v"))
    assert first == [0.5, 0.5] and second == [0.0, 1.0] and third is None
    assert math.isclose(one(df, arrays.log_sum_exp("v"))[0], 1000 + math.log(2))


def test_argmax_ties_and_empty(frame):
    df = frame([([1.0, 3.0, 3.0],), ([],), (None,)], "v array<double>")
    assert one(df, arrays.argmax("v")) == [1, None, None]


def test_class_after_marker_can_insist(frame):
    df = frame([("x/train_audio/a/f.ogg",), ("x/other/a/f.ogg",)], "p string")
    good = df.where("p LIKE '%train_audio%'").select(paths.class_after_marker("p", strict=True)).collect()
    assert [r[0] for r in good] == ["a"]
    with pytest.raises(Exception, match="no train_audio/ in x/other"):
        df.select(paths.class_after_marker("p", strict=True)).collect()
