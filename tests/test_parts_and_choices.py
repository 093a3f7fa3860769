"""Keys cut into parts against keys taken whole, and choices against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.functions import rules as R
from chronospan.operators import aggregate as A
from chronospan.operators import choices as H
from chronospan.operators import joins as J
from chronospan.operators import select as S
from chronospan.operators import sequence as Q
from chronospan.operators import signals as G


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def observed(spark):
    r = random.Random(11)
    data = [(k, i, t, float(r.randint(-9, 9)), r.random() < 0.2) for k, n in (("a", 150), ("b", 40), (None, 30), ("one", 1)) for i, t in enumerate(r.sample(range(3000), n))]
    return spark.createDataFrame(data, "k string, id long, t long, x double, mark boolean").repartition(5).cache()


def test_parts_change_nothing(spark, observed):
    d = observed
    for gap in (5, 60):
        assert rows(Q.sessionize(d, ["k"], "t", gap, "id", bucket=64)) == rows(Q.sessionize(d, ["k"], "t", gap, "id"))
    assert rows(J.neighbours(d, ["k"], "t", F.col("mark"), "x", "id", 64)) == rows(J.neighbours(d, ["k"], "t", F.col("mark"), "x", "id"))
    assert rows(Q.kinematics(d, ["k"], "t", "x", "x", 1.0, 2.0, "id", 64)) == rows(Q.kinematics(d, ["k"], "t", "x", "x", 1.0, 2.0, "id"))
    assert rows(A.jumps(d, ["k"], "t", "x", 3.0, "id", 64)) == rows(A.jumps(d, ["k"], "t", "x", 3.0, "id"))
    span = (F.lit(0), F.lit(3000), 90, 3)
    assert rows(R.coverage(d, ["k"], "t", *span, 64)) == rows(R.coverage(d, ["k"], "t", *span))
    assert rows(Q.dilate(d, ["k"], "t", F.col("mark"), 25, parts=2)) == rows(Q.dilate(d, ["k"], "t", F.col("mark"), 25, parts=1000))


def test_asof_in_parts(spark, observed):
    probe, data = observed.where("not mark").select("k", "id", "t"), observed.where("mark").select("k", "t", F.col("x").alias("v"), "id")
    known = {}
    for r in data.collect():
        known.setdefault(r.k, []).append((r.t, r.id, r.v))
    for following in (True, False):
        for clamp in (True, False):
            for strict in (True, False):
                got = {(r.k, r.id): (r.matched_t, r.matched) for r in J.asof(probe, data, ["k"], "t", "v", following, clamp, "id", 64, strict).collect()}
                for r in probe.collect():
                    here = sorted(known.get(r.k, []))
                    ok = [x for x in here if (x[0] > r.t or (x[0] == r.t and not strict) if following else x[0] < r.t or (x[0] == r.t and not strict))]
                    hit = (ok[0] if following else ok[-1]) if ok else (here[-1] if following else here[0]) if here and clamp else None
                    assert got[r.k, r.id] == ((hit[0], hit[2]) if hit else (None, None))


def test_places_in_blocks(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k, i, float(r.randint(0, 9))) for k, n in (("a", 50), ("b", 7), (None, 3)) for i in range(n)], "k string, i long, x double")
    assert rows(Q.smooth_edges(df, ["k"], "i", "x", 5, block=8)) == rows(Q.smooth_edges(df, ["k"], "i", "x", 5))
    assert rows(Q.rolling_buffer(df, ["k"], "i", "x", 4, block=8)) == rows(Q.rolling_buffer(df, ["k"], "i", "x", 4))
    assert rows(Q.reversals(df, ["k"], "i", "x", 2, 3.0, 4, "i", 8)) == rows(Q.reversals(df, ["k"], "i", "x", 2, 3.0, 4))


def test_spans_grow_over_parts(spark):
    r = random.Random(5)
    spans = [(i % 3, i, a, a + r.choice([0, 3, 9, 40])) for i in range(120) for a in [r.randint(0, 400)]]
    parts = [(i % 4, a, a + r.choice([0, 2, 5, 12, 30])) for i in range(160) for a in [r.randint(0, 400)]]
    want = []
    for k, i, a, b in spans:
        n = 0
        for c, d in sorted((c, d) for kk, c, d in parts if kk == k):
            if max(a, c) < min(b, d):
                a, b, n = min(a, c), max(b, d), n + 1
        want.append((k, i, a, b, n))
    s, p = spark.createDataFrame(spans, "k long, id long, start long, end long"), spark.createDataFrame(parts, "k long, start long, end long")
    for bucket in (None, 50):
        assert rows(S.expand_over(s, p, ["k"], "id", bucket=bucket)) == sorted(want, key=str)


def test_a_shortlist_proves_its_picks(spark):
    r = random.Random(7)
    data = [(k, i, r.choice("st"), r.choice("xyz"), a, a + r.choice([5, 40]), float(r.randint(0, 12))) for k, n in ((1, 90), (None, 12)) for i in range(n) for a in [r.randint(0, 300)]]
    df = spark.createDataFrame(data, "k int, id long, source string, kind string, a long, b long, score double")
    few, all_ = (rows(S.diverse_top_k(df, ["k"], "source", "kind", "a", "b", "score", "id", 6, 50.0, shortlist=n)) for n in (2, 10_000))
    assert few == all_ and few
    few, all_ = (rows(S.spaced_choice(df, ["k"], "a", "score", "id", "kind", 5, 2, 30.0, shortlist=n)) for n in (1, 10_000))
    assert few == all_ and few


def test_a_place_is_held_for_another_family(spark):
    data = [(1, 0, 9.0, "hit"), (1, 10, 8.0, "hit"), (1, 11, 7.5, "dig"), (1, 20, 7.0, "hit"), (1, 30, 6.0, "dig"), (1, 40, 5.0, "dig"), (2, 0, 1.0, "hit"), (2, 9, 2.0, "hit")]
    df = spark.createDataFrame(data, "k int, t long, s double, f string")
    pick = lambda most: {(r.k, r.t): r.place for r in H.distinct_candidates(df, ["k"], "t", [F.desc("s"), "t"], F.col("f") == "dig", 8, most).collect()}
    assert pick(3) == {(1, 0): 1, (1, 30): 2, (1, 10): 3, (2, 9): 1, (2, 0): 2}
    assert pick(1) == {(1, 0): 1, (2, 9): 1}


def test_pairs_in_order_of_left(spark):
    r = random.Random(4)
    edges = [(k, a, b, float(r.randint(0, 20)) / 10) for k in (1, 2, None) for a in range(15) for b in r.sample(range(20), 4)]
    want = []
    for k in (1, 2, None):
        used = set()
        for a in range(15):
            near = sorted((d, b) for kk, aa, b, d in edges if kk == k and aa == a and b not in used)
            if near and (len(near) == 1 or near[1][0] - near[0][0] >= 0.3):
                used.add(near[0][1])
                want.append((k, a, near[0][1], near[0][0]))
    got = rows(H.pairs_in_order(spark.createDataFrame(edges, "k int, a long, b long, d double"), ["k"], "a", "b", "d", 0.3))
    assert got == sorted(want, key=str) and H.pairs_in_order(spark.createDataFrame([], "k int, a long, b long, d double"), ["k"], "a", "b", "d", 0.3).count() == 0


def test_farthest_places_by_gaps():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 25)
        times = sorted(float(r.choice([r.randint(0, 12), r.uniform(0, 12)])) for _ in range(n))
        chosen, size = set(r.sample(range(n), r.randint(1, n))), r.randint(1, n)
        want = set(chosen)
        while len(want) < size:
            want.add(max((i for i in range(n) if i not in want), key=lambda i: min(abs(times[i] - times[j]) for j in want)))
        assert H.farthest_filled(times, chosen, size) == want


def test_a_budget_goes_to_long_runs_first():
    times = [float(i) for i in range(30)]
    active = [i in {*range(2, 12), *range(15, 18), 20, 21, *range(24, 30)} for i in range(30)]
    chosen, regions = H.burst_plan(times, active, 6)
    assert [(a, b, s, len(x)) for a, b, s, x in regions] == [(2, 11, "burst", 3), (15, 17, "over_budget", 0), (20, 21, "too_short", 0), (24, 29, "burst", 3)]
    assert len(chosen) == 6 and H.burst_plan(times, [False] * 30, 4) == ([0, 10, 19, 29], []) and H.burst_plan([], [], 4) == ([], [])


def test_best_lag_equals_whole_correlation(spark):
    rng = np.random.default_rng(1)
    signals = {"a": (rng.normal(size=300), 7), "b": (rng.normal(size=90), -4)}
    data = [("flat", i, 1.0, float(i)) for i in range(20)]
    want = {"flat": ("silent_window", 0, None)}
    for k, (x, by) in signals.items():
        y = np.roll(x, by) + 0.1 * rng.normal(size=len(x))
        data += [(k, 1000 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        a, b = x - x.mean(), y - y.mean()
        lags = np.arange(-20, 21)
        sums = [sum(a[i] * b[i + g] for i in range(len(a)) if 0 <= i + g < len(b)) for g in lags]
        i = int(np.argmax(sums))
        want[k] = ("checked", int(lags[i]), sums[i] / (np.linalg.norm(a) * np.linalg.norm(b)))
    df = spark.createDataFrame(data, "k string, p long, x double, y double").repartition(4)
    got = {r.k: (r.status, r.lag, r.correlation) for r in G.best_lag(df, ["k"], "p", "x", "y", 20, 32).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and got["a"][1] == 7 and got["b"][1] == -4
    assert all(abs(got[k][2] - want[k][2]) < 1e-9 for k in signals)
