from pyspark.sql import functions as F

from chronospan.operators import aggregate as A
from chronospan.operators import sequence as Q


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sessions_split_only_beyond_the_gap(spark):
    df = spark.createDataFrame([(1, 0), (1, 10), (1, 21), (1, 31), (2, 5)], "k int, t long")
    got = rows(Q.sessionize(df, ["k"], "t", 10), "k", "t", "session")
    assert got == [(1, 0, 0), (1, 10, 0), (1, 21, 1), (1, 31, 1), (2, 5, 0)]


def test_sessions_do_not_change_with_row_order_or_time_shift(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 3, 9, 30, 31, 60)], "k int, t long")
    base = rows(Q.sessionize(df, ["k"], "t", 5), "t", "session")
    mixed = df.orderBy(F.desc("t")).repartition(3).withColumn("t", F.col("t") + 1000)
    assert [(t - 1000, s) for t, s in rows(Q.sessionize(mixed, ["k"], "t", 5), "t", "session")] == base


def test_runs_and_missing_runs(spark):
    df = spark.createDataFrame([("a", i, i in (2, 3, 5, 6, 7), float(i)) for i in range(10)], "k string, i long, hit boolean, x double")
    assert rows(Q.runs(df, ["k"], "i", F.col("hit"), F.col("x")), "start", "end", "n", "peak") == [(2, 4, 2, 3.0), (5, 8, 3, 7.0)]
    assert rows(Q.missing_runs(df, ["k"], "i", F.col("hit"), 3), "start", "end", "n") == [(4, 5, 1)]


def test_split_at_midpoints_of_cores(spark):
    iv = spark.createDataFrame([(1, 0.0, 20.0)], "k int, start double, end double")
    cores = spark.createDataFrame([(1, 2.0, 5.0), (1, 11.0, 14.0)], "k int, start double, end double")
    assert rows(Q.split_at(iv, cores, ["k"]), "start", "end") == [(0.0, 8.0), (8.0, 20.0)]
    assert rows(Q.split_at(iv, cores.limit(0), ["k"]), "start", "end") == [(0.0, 20.0)]


def test_merge_stops_at_the_cap(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 8, 13), (1, 12, 14)], "k int, start long, end long")
    assert rows(Q.merge_capped(df, ["k"], "start", "end", 12), "start", "end", "n") == [(0, 9, 2), (8, 14, 2)]


def test_suppression_keeps_peaks_farther_than_the_reach(spark):
    df = spark.createDataFrame([("s", 1.0, 0.9), ("s", 1.2, 0.8), ("s", 1.5, 0.7), ("b", 1.2, 0.9)], "k string, t double, p double")
    assert rows(Q.suppress(df, ["k"], "t", "p", 0.24), "k", "t") == [("b", 1.2), ("s", 1.0), ("s", 1.5)]


def test_smoothing_repeats_the_ends(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 0, 0, 6])], "k int, i int, x double")
    assert rows(Q.smooth_edges(df, ["k"], "i", "x", 3), "i", "smooth") == [(0, 2.0), (1, 1.0), (2, 2.0), (3, 4.0)]


def test_windows_cover_and_own_every_time_once(spark):
    df = spark.createDataFrame([(1, 63.0)], "k int, d double")
    w = rows(Q.windows(df, F.lit(0.0), F.col("d"), 24.0, 4.0), "win_start", "win_end")
    assert w == [(0.0, 24.0), (20.0, 44.0), (40.0, 63.0)]
    own = rows(Q.owned_windows(df, ["k"], F.lit(0.0), F.col("d"), 24.0, 4.0), "own_start", "own_end")
    assert own == [(0.0, 22.0), (22.0, 42.0), (42.0, 63.0)]


def test_rolling_buffer_repeats_the_first(spark):
    df = spark.createDataFrame([(1, i) for i in range(4)], "k int, f long")
    assert rows(Q.rolling_buffer(df, ["k"], "f", "f", 3), "f", "buffer") == [(0, [0, 0, 0]), (1, [0, 0, 1]), (2, [0, 1, 2]), (3, [1, 2, 3])]


def test_refractory_and_reversals(spark):
    df = spark.createDataFrame([(1, t, t) for t in (0, 1, 5, 6, 11)], "k int, t long, id long")
    assert [r.t for r in Q.refractory(df, ["k"], "t", 5, "id").orderBy("t").collect()] == [0, 5, 11]
    z = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 9, 0, 9, 0])], "k int, t long, x double")
    assert [r.t for r in Q.reversals(z, ["k"], "t", "x", 1, 5.0, 2).orderBy("t").collect()] == [1, 3]


def test_null_aware_score_ignores_unknown_dimensions(spark):
    df = spark.createDataFrame([({"a": 3.0, "b": None},), ({"a": None, "b": None},)], "m map<string,double>")
    got = [r.s for r in df.select(A.null_aware_score(F.col("m"), {"a": 1.0, "b": 1.0}).alias("s")).collect()]
    assert (got[0].score, got[0].observed_weight, got[0].unknown) == (75.0, 0.5, ["b"])
    assert got[1].score is None and got[1].unknown == ["a", "b"]


def test_robust_z_has_a_floor(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 1.0, 1.0, 7.0)], "k int, x double")
    assert rows(A.robust_z(df, ["k"], "x", 3.0), "x", "z")[-1] == (7.0, 2.0)
