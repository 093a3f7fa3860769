import json

import pytest
from pyspark.sql import functions as F

from chronospan.sources import readers as R
from chronospan.streaming import streams as T


def test_strict_and_fenced_json():
    assert R.fenced_json('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', "NaN", "```json\n{}\n``` more", "{} {}"):
        with pytest.raises(ValueError):
            R.fenced_json(bad)


def test_aligned_frames(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"frame": i, "time_s": i / 30, "state": "play", "actions": [], "players": []}) for i in range(3)))
    (tmp_path / "b.csv").write_text("Frame,Visibility,X,Y,Radius\n" + "\n".join(f"{i},1,2.5,3.5,4" for i in range(3)))
    pts = spark.createDataFrame([(i, i / 30 + 0.001) for i in range(3)], "frame int, pts double")
    d, b = R.frames(spark, str(tmp_path / "d.jsonl")), R.ball(spark, str(tmp_path / "b.csv"))
    assert R.aligned(d, b, pts).count() == 3
    with pytest.raises(Exception, match="out of line"):
        R.aligned(d, b, pts.where("frame < 2")).count()
    with pytest.raises(Exception, match="out of line"):
        R.aligned(d, b, pts.withColumn("pts", F.col("pts") + 0.01)).count()


def test_discovery_and_digests(spark, tmp_path):
    for name in ("2026.2.1.2.mp4", "2026.2.1.1.MOV", "notes.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [(str(r.date), r.part) for r in R.discovered(spark, str(tmp_path)).collect()] == [("2026-02-01", 1), ("2026-02-01", 2)]
    have = R.digests(spark, str(tmp_path))
    assert R.verified_cache(have.limit(2), have).count() == 2
    (tmp_path / "2026.02.01.2.mkv").write_bytes(b"x")
    with pytest.raises(ValueError, match="one date and part"):
        R.discovered(spark, str(tmp_path))


def test_buckets_prune_and_json_refuses_nan(spark, tmp_path):
    df = spark.createDataFrame([(float(t),) for t in range(40)], "t double")
    R.write_buckets(df, str(tmp_path / "b"), "t", 10.0)
    got = R.read_buckets(spark, str(tmp_path / "b"), "t", 10.0, 12.0, 21.0)
    assert sorted(r.t for r in got.collect()) == [float(t) for t in range(12, 21)]
    assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="not finite"):
        R.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "j"))


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, pos long, x double")
    source = str(tmp_path / "in")
    df.where("pos < 10").coalesce(1).write.parquet(source)
    stream = lambda: T.sizes_stream(spark.readStream.schema(df.schema).parquet(source), "k", "pos", "x")
    T.collect_stream(stream(), "append", str(tmp_path / "out"), str(tmp_path / "ck"))
    df.where("pos >= 10").coalesce(1).write.mode("append").parquet(source)
    got = T.collect_stream(stream(), "append", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.sizes_batch(df, "k", "pos", "x").collect()))


def test_windowed_streams_emit_closed_windows(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = T.collect_stream(T.tumbling_counts(stream, ["k"], "ts", "10 minutes", "0 seconds"), "append", str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r.n for r in got.collect()} == {5} and got.count() == 18


def test_sizes_follow_trends_and_resist_jumps():
    assert T.sizes([10, 30, 10], None)[0] == [10, 12, 11]
    assert T.sizes([10.0, 20.0, 20.0, 20.0], None)[0] == [10.0, 12, 14, 17]
    assert T.sizes([0, None, 8, 0, -1, 200], None)[0] == [0, 0, 8, 8, 8, 9]
    assert T.sizes([5, 100, 100, 100, 100, 100, 100], None)[0][-1] == 40
    values = [float((i * i * 7 + 3) % 23) for i in range(60)]
    whole = T.sizes(values, None)[0]
    first, state = T.sizes(values[:17], None)
    assert first + T.sizes(values[17:], state)[0] == whole


def test_badly_named_media_and_empty_folders_are_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="no media"):
        R.discovered(spark, str(tmp_path))
    (tmp_path / "a" / "holiday.MP4").write_text("x")
    with pytest.raises(ValueError, match="need names"):
        R.discovered(spark, str(tmp_path))


def test_documents_ledgers_and_dead_letters(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{\n "id": 1,\n "x": 2.5\n}')
    (tmp_path / "d" / "two.json").write_text('[{"id": 2, "x": null}, {"id": 3}]')
    assert sorted(map(tuple, R.json_documents(spark, str(tmp_path / "d"), "id long, x double").collect())) == [(1, 2.5), (2, None), (3, None)]
    (tmp_path / "d" / "bad.json").write_text('{"id": 4, "x": NaN}')
    with pytest.raises(Exception, match="(?i)malformed|NaN"):
        R.json_documents(spark, str(tmp_path / "d"), "id long, x double").collect()
    ledger = str(tmp_path / "ledger")
    rows = lambda ids: spark.createDataFrame([(i, f"token=t{i} ok") for i in ids], "id long, text string")
    R.append_new(rows([1, 2]), ledger, ["id"])
    R.append_new(R.dead_letters(rows([2, 3, 3]), ["text"]), ledger, ["id"])
    assert sorted(map(tuple, spark.read.parquet(ledger).collect())) == [(1, "token=t1 ok"), (2, "token=t2 ok"), (3, "token=[redacted] ok")]


def test_archive_directories_as_rows(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("audio/one.wav", b"x" * 1000)
        z.writestr("audio/", b"")
        z.writestr("../out.txt", b"y")
    (tmp_path / "b.ZIP").write_bytes(b"not an archive")
    (tmp_path / "c.txt").write_text("no archive by name")
    got = {(r.path.rsplit("/", 1)[1], r.name): r for r in R.archive_entries(spark, str(tmp_path)).collect()}
    one = got["a.zip", "audio/one.wav"]
    assert len(got) == 4 and (one.bytes, one.method, one.is_dir, one.problem) == (1000, 8, False, None) and one.packed_bytes < 100
    assert got["a.zip", "audio/"].is_dir and got["a.zip", "../out.txt"].problem == "name leads out" and "zip" in got["b.ZIP", None].problem


def test_frames_written_as_three_tables_read_back(spark, tmp_path):
    df = spark.range(5).select(
        F.col("id").cast("int").alias("frame"), (F.col("id") / 25).alias("time_s"), F.lit("play").alias("state"), F.lit(0.5).alias("state_confidence"),
        F.expr("array(named_struct('class', 'hit', 'confidence', 0.5D, 'xyxy', array(1D, 2D, 3D, 4D)))").alias("actions"), F.expr("array(named_struct('xyxy', array(1D, 2D, 3D, 4D), 'confidence', 0.9D))").alias("players"),
        F.lit(1).alias("Visibility"), F.col("id").cast("double").alias("X"), F.lit(2.0).alias("Y"), F.lit(3).alias("Radius"), (F.col("id") / 25).alias("pts"),
    )
    at = str(tmp_path / "out")
    R.write_frames(df, at)
    back = R.aligned(R.frames(spark, f"{at}/detections"), R.ball(spark, f"{at}/ball"), R.clocks(spark, f"{at}/pts"))
    assert sorted((r.frame, r.X, r.pts, r.actions[0]["class"]) for r in back.collect()) == [(i, float(i), i / 25, "hit") for i in range(5)]
    with pytest.raises(ValueError, match="given twice"):
        R.write_frames(df.union(df), at)


def test_lines_wrap_whole_texts(spark, tmp_path):
    import textwrap

    from chronospan.plans import rules

    texts = [" ".join(f"word{i}" for i in range(40)), "short", "", None, "x" * 90 + " tail\nnext  line"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.lines for r in rules.c21_lines(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else "/".join(textwrap.wrap(" ".join(t.split()), 16, break_long_words=False, break_on_hyphens=False)) for i, t in enumerate(texts)}
