"""Selection by refined histograms, and orbits over blocks, against plain Python."""

import random
from statistics import median

import numpy as np

from chronospan.operators import sequence as Q
from chronospan.operators.quantiles import exact_quantiles, order_statistics
from chronospan.operators.orbits import block_table, composed, step


def test_exact_quantiles_by_rounds(spark):
    r = random.Random(5)
    values = {
        "wide": [r.uniform(-1, 1) * 10.0 ** r.randint(-12, 12) for _ in range(4000)],
        "ties": [float(r.randint(0, 3)) for _ in range(3000)],
        "same": [7.0] * 500,
        "few": [3.0, 1.0, 2.0],
        None: [r.gauss(0, 1) for _ in range(900)],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("few", None), ("few", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {x.k: x for x in exact_quantiles(df, ["k"], "x", {"p50": 0.5, "p85": 0.85}, bins=16, few=20).collect()}
    assert set(got) == {*values, "empty"} and got["empty"].p50 is None
    for k, vs in values.items():
        assert np.isclose(got[k].p50, median(vs), rtol=1e-12, atol=0) and np.isclose(got[k].p85, np.quantile(vs, 0.85), rtol=1e-9, atol=0)


def test_order_statistics_with_infinite_ends(spark):
    vs = [float("-inf")] * 30 + [float(i) for i in range(50)] + [float("inf")] * 30
    df = spark.createDataFrame([(1, v) for v in vs], "k long, x double")
    ranks = spark.createDataFrame([(1, i) for i in (0, 29, 30, 55, 79, 80, 109)], "k long, rank long")
    got = {x.rank: x.value for x in order_statistics(df, ["k"], "x", ranks, bins=4, few=5).collect()}
    assert got == {i: sorted(vs)[i] for i in got} and len(got) == 7


def kept(times, least):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= least:
            out.append(t)
            last = t
    return out


def test_refractory_over_many_blocks(spark):
    r = random.Random(8)
    dense = r.sample(range(30_000), 2500)  # no pause as long as the rate limit: one island
    sparse = [x * 997 for x in range(60)] + [x * 997 + 3 for x in range(60)]
    df = spark.createDataFrame([("d", t) for t in dense] + [("s", t) for t in sparse] + [("d", None)], "k string, t long")
    got = Q.refractory(df, ["k"], "t", 20, "t").collect()
    assert sorted(x.t for x in got if x.k == "d") == kept(dense, 20) and sorted(x.t for x in got if x.k == "s") == kept(sparse, 20)


def test_one_key_is_many_tasks_work(spark):
    df = spark.createDataFrame([(1, t) for t in range(0, 200_000, 3)], "k long, t long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would meet in one task
    spread = Q.refractory(df, ["k"], "t", 50, "t").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(1 for n in spread if n) > 1 and sum(spread) == len(kept(range(0, 200_000, 3), 50))


def test_merge_capped_over_many_blocks(spark):
    r = random.Random(9)
    spans = sorted((a, a + r.choice([1, 5, 30, 200])) for a in (r.randint(0, 20_000) for _ in range(1500)))
    want, n = [], 0
    for a, b in spans:
        if want and a <= want[-1][1] and max(b, want[-1][1]) - want[-1][0] <= 40:
            want[-1] = (want[-1][0], max(b, want[-1][1]), want[-1][2] + 1)
        else:
            want.append((a, b, 1))
    df = spark.createDataFrame([(1, a, b) for a, b in spans], "k long, start long, end long")
    got = sorted((x.start, x.end, x.n) for x in Q.merge_capped(df, ["k"], "start", "end", 40).collect())
    assert got == sorted(want)


def test_block_tables_compose():
    r = random.Random(3)
    for _ in range(200):
        tables = [[r.randint(0, 4) for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 6))]
        whole = composed(tables)
        for entry in range(len(tables[0]) + 1):
            place = entry
            for t in tables:
                place = step(t, place)
            assert step(whole, entry) == place
    following = lambda i: i + 2
    assert block_table([None] * 7, 5, 2, following) == [1, 0, 1]
