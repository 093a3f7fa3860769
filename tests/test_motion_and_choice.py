import numpy as np
from pyspark.sql import functions as F

from chronospan.operators import motion as P
from chronospan.operators import select as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def path(kick: bool, shift: float = 0.0):
    t = np.arange(90) / 30
    x = 2 * t + np.where(kick & (t > 1.6), -6 * (t - 1.6), 0)
    y = 5 * t - 2 * t * t
    return [("s", float(a + shift), float(b), float(c)) for a, b, c in zip(t, x, y, strict=True)]


def test_an_impulse_is_found_and_an_apex_is_not(spark):
    schema = "k string, t double, x double, y double"
    rule = P.Impulses(jump=2.0, speed=20.0)  # lengths here are far from widths of an image
    assert P.impulses(spark.createDataFrame(path(False), schema), ["k"], "t", "x", "y", rule).count() == 0
    for shift in (0.0, 50.0):
        got = P.impulses(spark.createDataFrame(path(True, shift), schema), ["k"], "t", "x", "y", rule).collect()
        assert len(got) == 1 and abs(got[0].t - shift - 1.6) <= 0.04


def test_followed_path_returns_to_the_center(spark):
    df = spark.createDataFrame([("s", 0.0, 10.0), ("s", 4.0, 10.0)], "k string, t double, x double")
    got = {round(r.t, 3): r.x for r in P.follow_path(df, ["k"], "t", "x", 10.0, 0.0, 0.5, 3).collect()}
    assert got[0.0] == 10.0 and got[2.0] == 0.0 and got[4.0] == 10.0


def test_trusted_gaps_need_two_supports(spark):
    data = [("a", 0.0, 0.0, True), ("a", 0.1, 0.1, False), ("a", 0.2, 0.21, False), ("a", 0.3, 0.3, True), ("a", 0.4, 9.0, False), ("a", 0.5, 0.5, True), ("a", 0.6, 0.6, False)]
    df = spark.createDataFrame(data, "k string, t double, x double, seen boolean")
    assert rows(P.trusted_gaps(df, ["k"], "t", "x", F.col("seen"), 1.0, 0.65), "t") == [(0.1,), (0.2,)]


def test_hint_boxes_gate_on_samples(spark):
    df = spark.createDataFrame([("a", 0.1, 1.0, 2.0), ("a", 0.2, 3.0, 1.0), ("a", 1.9, 5.0, 5.0)], "k string, t double, x double, y double")
    assert rows(P.hint_boxes(df, ["k"], "t", "x", "y", F.lit(0.0), F.lit(2.0), 1.2, 2), "win", "x0", "y0", "x1", "y1", "n") == [(0, 1.0, 1.0, 3.0, 2.0, 2)]


def test_choices(spark):
    df = spark.createDataFrame([(1, 0.0, 9.0, "a", "g"), (1, 0.5, 8.0, "b", "g"), (1, 3.0, 7.0, "a", "h"), (1, 4.0, 6.0, "c", "h"), (1, 9.0, 5.0, "d", "g")], "k int, t double, s double, l string, g string")
    assert rows(S.spaced_choice(df, ["k"], "t", "s", "l", "g", 3, 1, 1.0), "t") == [(0.0,), (4.0,)]
    spans = spark.createDataFrame([(1, 7, 4, 6), (2, 8, 0, 1)], "k int, id int, start long, end long")
    parts = spark.createDataFrame([(1, 0, 3), (1, 5, 9), (1, 8, 12)], "k int, start long, end long")
    assert rows(S.expand_over(spans, parts, ["k"], "id"), "id", "start", "end", "n") == [(7, 4, 12, 2), (8, 0, 1, 0)]
    cues = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0)], "k int, id int, t double")
    frames = spark.createDataFrame([(1, 0.0, False), (1, 0.4, True), (1, 7.0, True)], "k int, ft double, ok boolean")
    assert rows(S.first_passing(cues, frames, ["k"], "id", "t", "ft", 1.0, F.col("ok")), "id", "at") == [(1, 0.4), (2, None)]
    r = spark.createDataFrame([(1, 3, True), (1, 2, False), (2, 3, True), (2, 4, False)], "k int, p int, settled boolean")
    assert rows(S.best_unless_open(r, ["k"], ["p"], "settled"), "k", "p") == [(1, 3)]
