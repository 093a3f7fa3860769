import random

from pyspark.sql import functions as F

from chronospan.operators import joins as J


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_overlap_join_is_the_nested_loop_without_its_plan(spark):
    rng = random.Random(3)
    a = [(k, i, s, s + rng.randint(1, 40)) for i in range(60) for k, s in [(rng.randint(0, 2), rng.randint(0, 200))]]
    b = [(k, i, s, s + rng.randint(1, 40)) for i in range(60) for k, s in [(rng.randint(0, 2), rng.randint(0, 200))]]
    left = spark.createDataFrame(a, "k int, i int, start long, end long")
    right = spark.createDataFrame(b, "k int, j int, other_start long, other_end long")
    got = J.overlap_join(left, right, ["k"], 16.0)
    want = sorted((i, j) for k, i, s, e in a for k2, j, s2, e2 in b if k == k2 and max(s, s2) < min(e, e2))
    assert rows(got, "i", "j") == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_touching_intervals_do_not_overlap_and_points_are_half_open(spark):
    a = spark.createDataFrame([(1, 0, 10)], "k int, start long, end long")
    b = spark.createDataFrame([(1, 10, 20)], "k int, other_start long, other_end long")
    assert J.overlap_join(a, b, ["k"], 7.0).count() == 0
    p = spark.createDataFrame([(1, 0), (1, 9), (1, 10)], "k int, t long")
    assert rows(J.point_join(p, a, ["k"], "t", 7.0), "t") == [(0,), (9,)]


def test_asof_clamps_to_the_last_and_first(spark):
    p = spark.createDataFrame([(1, 0), (1, 5), (1, 6), (1, 99)], "k int, t long")
    d = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "k int, t long, v string")
    assert rows(J.asof(p, d, ["k"], "t", "v"), "t", "matched") == [(0, "a"), (5, "a"), (6, "b"), (99, "b")]
    assert rows(J.asof(p, d, ["k"], "t", "v", following=False), "t", "matched") == [(0, "a"), (5, "a"), (6, "a"), (99, "b")]


def test_one_to_one_matching_beats_greedy_nearest(spark):
    t = spark.createDataFrame([("v", 0.0), ("v", 0.2)], "k string, t double")
    p = spark.createDataFrame([("v", 0.2), ("v", 0.4)], "k string, t double")
    assert rows(J.match_counts(t, p, ["k"], "t", 0.2), "tp", "fp", "fn") == [(2, 0, 0)]


def test_near_any_both_ways(spark):
    a = spark.createDataFrame([(1, 0), (1, 100)], "k int, t long")
    b = spark.createDataFrame([(1, 15)], "k int, o long")
    assert rows(J.near_any(a, b, ["k"], "t", "o", 15.0), "t") == [(0,)]
    assert rows(J.near_any(a, b, ["k"], "t", "o", 15.0, anti=True), "t") == [(100,)]


def test_overlay_takes_the_largest_and_the_background(spark):
    iv = spark.createDataFrame([(1, 0.5, 2.0, 3.0), (1, 1.5, 1.6, 9.0)], "k int, s double, e double, score double")
    bins = spark.createDataFrame([(1, i) for i in range(4)], "k int, bin long")
    assert rows(J.bin_overlay(iv, ["k"], "s", "e", "score", bins, 1.0), "bin", "score") == [(0, 3.0), (1, 9.0), (2, 0.0), (3, 0.0)]


def test_compare_rows_counts_null_as_a_value(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert rows(J.compare_rows(a, b, ["k"], ["v"]), "k", "side", "differing") == [(1, "both", []), (2, "both", ["v"]), (3, "left", []), (4, "right", [])]


def test_greedy_pairs_leave_ambiguous_ones(spark):
    d = spark.createDataFrame([(1, "a", "x", 0.1), (1, "a", "y", 0.15), (1, "b", "y", 0.3)], "f int, l string, r string, d double")
    assert rows(J.greedy_pairs(d, ["f"], "l", "r", "d", 0.8, 0.15), "l", "r") == [("b", "y")]
    assert rows(J.greedy_pairs(d, ["f"], "l", "r", "d", 0.8, 0.01), "l", "r") == [("a", "x"), ("b", "y")]


def test_best_overlap_has_null_without_any(spark):
    a = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 50, 60)], "k int, i int, start long, end long")
    b = spark.createDataFrame([(1, 7, 1, 4), (1, 8, 2, 9)], "k int, j int, other_start long, other_end long")
    assert rows(J.best_overlap(a, b, ["k"], "i", "j", 8.0), "i", "best", "overlap") == [(1, 8, 7), (2, None, None)]
    assert [r.x for r in a.limit(1).select(J.overlap_ratio(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)).alias("x")).collect()] == [1 / 3]
