import random

from pyspark.sql import functions as F

from chronospan.operators import islands as I
from chronospan.operators import joins as J
from chronospan.operators import metrics as M
from chronospan.operators import review as V
from chronospan.operators import select as S
from chronospan.operators import sequence as Q


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def points(n=400, seed=3):
    """One hot key with most rows, a null key, ties and pauses of all lengths."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["b", None]), rng.randint(0, 4 * n) * rng.choice([1, 1, 1, 7]), rng.randint(0, 9), i) for i in range(n)]


def test_islands_do_not_depend_on_the_bucket(spark):
    df = spark.createDataFrame([(k, t, t + d, i) for k, t, d, i in points()], "k string, a long, b long, id int")
    one = rows(I.islands(df, ["k"], "a", "b", 6), "id", "island")
    assert all(rows(I.islands(df, ["k"], "a", "b", 6, w), "id", "island") == one for w in (5, 64, 1000))
    want, ends = {}, {}
    for k, t, d, i in sorted(points(), key=lambda r: (r[1], r[1] + r[2])):
        end, head = ends.get(k, (None, None))
        head = t if end is None or t - end > 6 else head
        ends[k] = (t + d if end is None else max(end, t + d), head)
        want[i] = head
    assert dict(one) == want


def test_ranks_of_parts_are_ranks_of_keys(spark):
    df = spark.createDataFrame([(k, t, i) for k, t, _, i in points()], "k string, t long, id int")
    got = {r.id: r.pos for r in I.ranked(df, ["k"], F.floor(F.col("t") / 50), ["t", "id"]).collect()}
    by: dict = {}
    for k, t, _, i in points():
        by.setdefault(k, []).append((t, i))
    assert got == {i: n for x in by.values() for n, (_, i) in enumerate(sorted(x), 1)}


def test_suppression_refractory_and_matching_equal_brute_force(spark):
    data = points(300, 5)
    df = spark.createDataFrame([(k, float(t), float(p), i) for k, t, p, i in data], "k string, t double, p double, id int")
    kept: list = []
    for k, t, _, i in sorted(data, key=lambda r: (-r[2], r[1])):
        if all(k2 != k or abs(t - t2) > 20 + 1e-9 for k2, t2, _ in kept):
            kept.append((k, t, i))
    assert sorted((str(k), t) for k, t, _ in kept) == sorted((str(r.k), r.t) for r in Q.suppress(df, ["k"], "t", "p", 20.0).collect())
    last: dict = {}
    want = []
    for k, t, _, i in sorted(data, key=lambda r: (r[1], r[3])):
        if t - last.get(k, -1e9) >= 15:
            last[k] = t
            want.append(i)
    assert sorted(want) == [i for (i,) in sorted(rows(Q.refractory(df, ["k"], "t", 15, "id"), "id"))]
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = {r.k: (r.tp, r.fp, r.fn) for r in J.match_counts(a, b, ["k"], "t", 9.0).collect()}
    for key in got:
        x, y = (sorted(t for k, t, _, i in data if k == key and i % 2 == side) for side in (0, 1))
        i = j = tp = 0
        while i < len(x) and j < len(y):
            tp, i, j = (tp + 1, i + 1, j + 1) if abs(x[i] - y[j]) <= 9 else (tp, i + (x[i] < y[j]), j + (x[i] >= y[j]))
        assert got[key] == (tp, len(y) - tp, len(x) - tp)


def test_greedy_choice_and_merges_equal_brute_force(spark):
    data = points(250, 9)
    df = spark.createDataFrame([(k, t, t + 3 + d * 4, float(d), i) for k, t, d, i in data], "k string, a long, b long, s double, id int")
    want = set()
    for key in {r[0] for r in data}:
        kept: list = []
        for _, t, d, i in sorted((r for r in data if r[0] == key), key=lambda r: (-r[2], r[1], r[3])):
            if len(kept) < 6 and all(t + 3 + d * 4 <= x or y <= t for x, y, _ in kept):
                kept.append((t, t + 3 + d * 4, i))
        want |= {(i, n) for n, (_, _, i) in enumerate(kept, 1)}
    for bucket in (None, 40.0):
        assert set(rows(S.greedy_non_overlapping(df, ["k"], "a", "b", "s", "id", 6, bucket), "id", "pick")) == want
    peaks = df.withColumn("p", (F.col("a") + F.col("b")) / 2)
    merged: list = []
    for k, a, b, s, i in sorted(((k, t, t + 3 + d * 4, d, i) for k, t, d, i in data), key=lambda r: (r[1], r[2], r[4])):
        for x in reversed(merged):
            meet = min(b, x[2]) - max(a, x[1])
            if x[0] == k and abs((a + b) / 2 - (x[1] + x[2]) / 2) <= 5 and meet / min(b - a, x[2] - x[1]) >= 0.6:
                x[5].add(i)
                if (s, i % 3) > (x[3], x[4] % 3):
                    x[1:5] = [a, b, s, i]
                break
        else:
            merged.append([k, a, b, s, i, {i}])
    ranked = peaks.withColumn("r", F.col("id") % 3)
    got = S.merge_duplicates(ranked, ["k"], "a", "b", "p", ["s", "r"], "id", 5.0, 0.6, 40.0).collect()
    assert sorted((r.id, tuple(r.ids)) for r in got) == sorted((x[4], tuple(sorted(x[5]))) for x in merged)


def test_diverse_choice_takes_ties_by_score_and_source(spark):
    df = spark.createDataFrame([(0, "w", "z", 100, 101, 8.0, 3), (0, "u", "x", 0, 1, 10.0, 1), (0, "u", "y", 90, 91, 9.0, 2), (0, "a", "q", 5, 6, 8.0, 4)], "g int, src string, kind string, a long, b long, s double, id int")
    assert rows(S.diverse_top_k(df, ["g"], "src", "kind", "a", "b", "s", "id", 4, 90.0), "pick", "id") == [(1, 1), (2, 2), (3, 4), (4, 3)]
    try:
        S.diverse_top_k(df, ["g"], "src", "kind", "a", "b", "s", "id", 9, 90.0, strict=True).collect()
        raise AssertionError("a short choice passed")
    except Exception as e:
        assert "4 of 9 picks" in str(e)


def test_contexts_boxes_and_heads(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("c")).first().c
    L = F.lit
    assert tuple(first(V.initial_context(L(10.0), L(None).cast("double"), L(11.0), L(0.0), L(60.0), 30.0))) == (9.0, 15.0)
    assert first(V.initial_context(L(10.0), L(50.0), L(11.0), L(0.0), L(60.0), 30.0)) is None
    assert tuple(first(V.expanded_context(L(9.0), L(15.0), L(True), L(False), L(0.0), L(60.0), 30.0))) == (6.6, 15.0)
    assert first(V.expanded_context(L(0.0), L(15.0), L(True), L(True), L(0.0), L(60.0), 30.0)) is None
    assert [round(x, 6) for x in first(V.padded_box(L(0.9), L(0.5), L(0.95), L(0.55)))] == [0.55, 0.325, 1.0, 0.725]
    people = F.array(*[F.struct(L(c).alias("confidence"), L(a).alias("y0"), L(b).alias("y1")) for c, a, b in ((0.9, 10.0, 30.0), (0.5, 20.0, 40.0), (0.1, 0.0, 9.0))])
    assert tuple(first(V.head_line(people, 100.0))) == (2, 18.0) and tuple(first(V.head_line(F.filter(people, lambda p: p["y0"] < 5), 100.0))) == (0, 40.0)
    pairs = lambda names: F.array(*[F.struct(L(n).alias("name"), L(i).alias("value")) for i, n in enumerate(names)])
    assert first(V.named_once(pairs(["b", "a"]), ["a", "b"])) == {"b": 0, "a": 1}
    assert [first(V.named_once(pairs(x), ["a", "b"])) for x in (["a", "a"], ["a"], ["a", "b", "c"])] == [None] * 3


def test_recall_counts_unknown_as_null(spark):
    schema = "k string, id int, start long, end long, clip_start long, clip_end long, grade int"
    truth = spark.createDataFrame([("a", 1, 0, 10, 0, 10, None), ("a", 2, 50, 60, 50, 60, None), ("c", 3, 0, 10, 0, 10, None)], schema)
    found = spark.createDataFrame([("a", 7, 1, 10, 0, 12, 4), ("a", 8, 80, 90, 80, 90, None), ("b", 9, 0, 5, 0, 5, None)], schema)
    got = {r.k: tuple(r)[1:] for r in M.candidate_recall(truth, found, found, ["k"], "id", 10.0, 0.5, "grade").collect()}
    assert got == {"a": (2, 0.5, 2, 1, 4.0, 1, 1.0), "b": (0, None, 1, 0, None, 0, None), "c": (1, 0.0, 0, 0, None, 0, None)}
