"""Streams against the same operators over tables: final scores for any split of the input, requests served within bounded state."""

import random

import pytest
from pyspark.sql import functions as F

from chronospan.streaming import prefix as P
from chronospan.streaming import streams as T


@pytest.fixture()
def state_store(spark):
    spark.conf.set(*P.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(P.STATE_STORE[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute(values, window, stride, ended):
    """Probability by frame of the final prefix of one key's values."""
    n = len(values)
    whole = max(0, (n - window) // stride + 1)
    spans = [(w * stride, w * stride + window) for w in range(whole)] + ([(whole * stride, n)] if ended and whole * stride < n else [])
    out = {}
    for f in range(n if ended else whole * stride):
        got = [sum(values[a:b]) / (b - a) for a, b in spans if a <= f < b]
        out[f] = P.sigmoid(sum(got) / len(got))
    return out


def data(r, n):
    rows = [(k, p, r.gauss(0, 1)) for k, size in (("a", n), ("b", n // 2), ("short", 5)) for p in range(size)]
    return rows + [("holes", p, float(p)) for p in (*range(14), *range(15, 30))]


def expected(rows, ended=False):
    want = {}
    for k in {x[0] for x in rows}:
        values = [x[2] for x in sorted(x for x in rows if x[0] == k)]
        values = values[:14] if k == "holes" else values
        want |= {(k, f): v for f, v in brute(values, 8, 3, ended).items()}
    return want


def same(got, want):
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("ended", [False, True])
def test_final_scores_of_a_table(spark, ended):
    rows = data(random.Random(2), 40)
    df = spark.createDataFrame(rows, "k string, p long, x double").repartition(3)
    same({(r.k, r.pos): r.probability for r in P.final_scores(df, ["k"], "p", "x", 8, 3, ended).collect()}, expected(rows, ended))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_emits_each_final_frame_once_for_any_split(spark, state_store, tmp_path, seed):
    r = random.Random(seed)
    rows = data(r, 40)
    order = rows[:]
    r.shuffle(order)
    cuts = sorted(r.sample(range(1, len(order)), 3))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)])):
        spark.createDataFrame(order[a:b], "k string, p long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, p long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.collect_stream(P.final_scores_stream(stream, "k", "p", "x", 8, 3), "append", str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert len(got) == len({(x.k, x.pos) for x in got})
    same({(x.k, x.pos): x.probability for x in got}, expected(rows))


def test_a_timer_ends_a_key(spark, state_store, tmp_path):
    rows = [("a", p, float(p % 5), 1_700_000_000 + p) for p in range(20)] + [("b", 0, 1.0, 1_700_001_000), ("b", 1, 1.0, 1_700_001_001)]
    for part in (rows[:12], rows[12:20], rows[20:21], rows[21:]):
        df = spark.createDataFrame(part, "k string, p long, x double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.collect_stream(P.final_scores_stream(stream, "k", "p", "x", 8, 3, "ts", "0 seconds", 60.0), "append", str(tmp_path / "o"), str(tmp_path / "c")).collect()
    same({x.pos: x.probability for x in got if x.k == "a"}, brute([float(p % 5) for p in range(20)], 8, 3, True))
    assert not [x for x in got if x.k == "b"]  # its time has not come


def test_requests_are_served_from_a_stream_within_bounded_state(spark, state_store, tmp_path):
    t0 = 1_700_000_000
    asked = [("u%d" % (i % 3), i, t0 + 60 * i, t0 + 60 * i + 90) for i in range(60)]
    seen = [("u%d" % (i % 3), t0 + 37 * i) for i in range(100) if i % 7]
    requests = spark.createDataFrame(asked, "u string, id long, a long, b long").select("u", "id", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    frames = spark.createDataFrame(seen, "u string, c long").select("u", F.timestamp_seconds("c").alias("t"))
    for name, df, at in (("r", requests, "a"), ("f", frames, "t")):
        rows = df.orderBy(at).collect()
        for i in range(0, len(rows), 6):
            spark.createDataFrame(rows[i : i + 6], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        late = spark.createDataFrame([tuple("zz" if c == "u" else -1 if c == "id" else None for c in df.columns)], df.schema)
        times = {c: F.timestamp_seconds(F.lit(t0 + 100_000)) for c, kind in df.dtypes if kind == "timestamp"}
        late.withColumns(times).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = P.served(read("r", requests), read("f", frames), "u", "id", "a", "b", "t", "2 MINUTES", "1 minute")
    q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).where("id >= 0").select("u", "id", F.unix_seconds("t")).collect()), key=str)
    batch = P.served(requests, frames, "u", "id", "a", "b", "t", "2 MINUTES", "1 minute").select("u", "id", F.unix_seconds("t")).collect()
    assert got == sorted(map(tuple, batch), key=str) and any(x[2] is None for x in got)
    want = {(u, i): sorted(c for v, c in seen if v == u and a <= c < b) or [None] for u, i, a, b in asked}
    assert len(got) == sum(map(len, want.values())) and all(x[2] in want[x[0], x[1]] for x in got)
    assert max(held) < (len(asked) + len(seen)) / 2


def test_a_users_events_are_in_one_file_of_the_stream(spark, state_store):
    from chronospan.plans import tables_io
    from chronospan.session import shared_folder

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        n = tables_io.j12_stream(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset(coalesce)
    scored = spark.read.parquet(f"{shared_folder(spark)}/chronospan/{spark.sparkContext.applicationId}/scored-*").withColumn("file", F.input_file_name())
    files, pairs, users = scored.agg(F.countDistinct("file"), F.countDistinct("file", "user_id"), F.countDistinct("user_id")).first()
    assert n and files > 1 and pairs == users
