"""Operators on ordered rows: sessions, runs, dilation, peaks, windows and folds.

Every operator is keyed: times of different keys are never compared. Times are
numbers in one unit chosen by the caller (LONG microseconds where a RANGE frame
is used). Row order of the input never matters.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .islands import carried, fold_sorted, haloed, islands, same_key_join
from .orbits import at_least_apart, merged_up_to, orbit


def _by(key: list[str], *order) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def sessionize(df: DataFrame, key: list[str], t: str, gap: float, tie: str | None = None, slack: float = 0, out: str = "session", bucket: float | None = None) -> DataFrame:
    """Number rows by session: a new one starts where the time since the previous row exceeds ``gap + slack``.

    With ``bucket``, a width of time, a key is sorted a bucket at a time, and the last time and the number of sessions of the buckets before carried over.
    """
    if not bucket:
        w = _by(key, t, *([tie] if tie else []))
        new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap + slack).cast("int"), F.lit(0))
        return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rows = carried(df.withColumn("_part", F.floor(F.col(t) / F.lit(bucket))), key, "_part", F.max(t), F.max, "_last")
    w = _by([*key, "_part"], t, *([tie] if tie else []))
    new = F.coalesce((F.col(t) - F.coalesce(F.lag(t).over(w), "_last") > gap + slack).cast("int"), F.lit(0))
    told = carried(rows.withColumn("_new", new), key, "_part", F.sum("_new"), F.sum, "_before")
    number = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    return told.withColumn(out, number).drop("_part", "_last", "_new", "_before")


def bursts(df: DataFrame, key: list[str], t: str, gap: float, least: int = 2, tie: str | None = None, bucket: float | None = None) -> DataFrame:
    """Sessions of at least ``least`` rows: (key, start, end, n)."""
    s = sessionize(df, key, t, gap, tie, bucket=bucket)
    return s.groupBy(*key, "session").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("session")


def runs(df: DataFrame, key: list[str], pos: str, hit: Column, score: Column | None = None, block: int = 1 << 16) -> DataFrame:
    """Runs of hits at consecutive whole positions: (key, start, end exclusive, n, peak). Positions are taken ``block`` at a time."""
    rows = df.where(hit).withColumn("_score", score if score is not None else F.lit(None).cast("double"))
    return islands(rows, key, pos, pos, 1, block).groupBy(*key, "island").agg(
        F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.count(F.lit(1)).alias("n"), F.max("_score").alias("peak")
    ).drop("island")


def missing_runs(df: DataFrame, key: list[str], pos: str, present: Column, longest: int) -> DataFrame:
    """Runs of missing positions between present ones, at most ``longest`` long; runs at either end don't count."""
    span = df.groupBy(*key).agg(F.min(pos).alias("_lo"), (F.max(pos) + 1).alias("_hi"))
    gaps = runs(df, key, pos, ~present).join(span, key)
    return gaps.where((F.col("start") > F.col("_lo")) & (F.col("end") < F.col("_hi")) & (F.col("n") <= longest)).drop("_lo", "_hi", "peak")


def split_at(intervals: DataFrame, cores: DataFrame, key: list[str], start: str = "start", end: str = "end", width: float | None = None) -> DataFrame:
    """Cut intervals midway between successive cores that both lie within them. With ``width``, a typical length, intervals meet only the cores of the buckets that they touch."""
    w = _by(key, "core_start")
    cuts = cores.select(*key, F.col(start).alias("core_start"), F.col(end).alias("core_end")).withColumn("next", F.lead("core_start").over(w))
    cuts = cuts.where("next is not null").select(*key, ((F.col("core_end") + F.col("next")) / 2).alias("cut"), "core_start", "next")
    if width:
        bucket = lambda c: F.floor(F.col(c) / F.lit(width))
        dealt = intervals.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
        near = cuts.withColumn("_b", bucket("core_start"))
        met = same_key_join(dealt, near, [*key, "_b"])
    else:
        met = intervals.join(cuts, key, "left")
    inside = met.withColumn("cut", F.when((F.col("core_start") >= F.col(start)) & (F.col("next") < F.col(end)), F.col("cut")))
    points = inside.groupBy(*key, start, end).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    edges = F.concat(F.array(F.col(start).cast("double")), F.col("cuts"), F.array(F.col(end).cast("double")))
    pieces = points.select(*key, F.explode(F.arrays_zip(F.slice(edges, F.lit(1), F.size(edges) - 1).alias("a"), F.slice(edges, F.lit(2), F.size(edges) - 1).alias("b"))).alias("p"))
    return pieces.select(*key, F.col("p.a").alias(start), F.col("p.b").alias(end))


def dilate(df: DataFrame, key: list[str], t: str, hit: Column, reach: int, out: str = "near_hit", parts: int = 64) -> DataFrame:
    """Whether any hit lies within ``reach`` of a row; ``t`` is a LONG. A key is taken ``parts`` reaches at a time, with the hits on either side."""
    told = haloed(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), key, t, parts * reach, reach, reach).where(F.col("_own") | F.col("_hit"))
    w = Window.partitionBy(*key, "_part").orderBy(t).rangeBetween(-reach, reach)
    return told.withColumn(out, F.max(F.col("_hit").cast("int")).over(w) == 1).where("_own").drop("_part", "_own", "_hit")


def refractory(df: DataFrame, key: list[str], t: str, least: float, tie: str) -> DataFrame:
    """Rows kept when at least ``least`` has passed since the last kept row. A key's rows are walked a block of time at a time, whatever their number."""
    size = len(df.columns)
    return orbit(df, key, [t, tie], least, at_least_apart(df.columns.index(t), least), lambda rows, i, j: rows[i][:size], df.schema)


def reversals(df: DataFrame, key: list[str], t: str, x: str, reach: int, least: float, refract: float, pos: str | None = None, block: int = 1 << 16) -> DataFrame:
    """Times where x turns round within ``reach`` rows by at least ``least`` on both sides, not within ``refract`` of the last.

    With ``pos``, consecutive places of a key's rows by time, they are taken ``block`` at a time.
    """
    near = haloed(df, key, pos, block, reach, reach) if pos else df.withColumn("_part", F.lit(0)).withColumn("_own", F.lit(True))
    w = _by([*key, "_part"], pos or t)
    before, after = F.col(x) - F.lag(x, reach).over(w), F.lead(x, reach).over(w) - F.col(x)
    turns = near.withColumn("_b", before).withColumn("_a", after).where((F.col("_b") * F.col("_a") < 0) & (F.abs("_b") >= least) & (F.abs("_a") >= least) & F.col("_own"))
    return refractory(turns.select(*key, t, x), key, t, refract, x)


def smooth_edges(df: DataFrame, key: list[str], pos: str, x: str, width: int, out: str = "smooth", block: int = 1 << 16) -> DataFrame:
    """Centred moving average over an odd width with the end values repeated beyond the ends.

    ``pos`` are consecutive places; they are taken ``block`` at a time, with half a width on either side.
    """
    half = max(3, width | 1) // 2
    ends = df.groupBy(*key).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.min_by(x, pos).alias("_head"), F.max_by(x, pos).alias("_tail"))
    near = same_key_join(haloed(df, key, pos, block, half, half), ends, key)
    inner = F.sum(x).over(_by([*key, "_part"], pos).rowsBetween(-half, half))
    missing_head, missing_tail = F.greatest(F.lit(half) - (F.col(pos) - F.col("_lo")), F.lit(0)), F.greatest(F.lit(half) - (F.col("_hi") - F.col(pos)), F.lit(0))
    mean = (inner + F.col("_head") * missing_head + F.col("_tail") * missing_tail) / (2 * half + 1)
    return near.withColumn(out, mean).where("_own").drop("_part", "_own", "_lo", "_hi", "_head", "_tail")


def local_peaks(df: DataFrame, key: list[str], t: str, p: str, threshold: float, block: int | None = None) -> DataFrame:
    """Rows at or over the threshold, more than the row before and not less than the one after (plateaus: first row).

    With ``block``, ``t`` are consecutive whole places and are taken that many at a
    time, each block with the row on either side, so a key is many tasks' work.
    """
    keys = [*key, "_block"] if block else key
    if block:
        of = lambda d: F.floor((F.col(t) + d) / block)
        df = df.withColumn("_own", of(0)).withColumn("_block", F.explode(F.array_distinct(F.array(of(-1), of(0), of(1)))))
    w = _by(keys, t)
    left, right = F.coalesce(F.lag(p).over(w), F.lit(-np.inf)), F.coalesce(F.lead(p).over(w), F.lit(-np.inf))
    found = df.withColumn("_l", left).withColumn("_r", right).where((F.col(p) >= threshold) & (F.col(p) > F.col("_l")) & (F.col(p) >= F.col("_r"))).drop("_l", "_r")
    return found.where("_own = _block").drop("_own", "_block") if block else found


def suppress(df: DataFrame, key: list[str], t: str, p: str, reach: float, slack: float = 1e-9) -> DataFrame:
    """Non-maximum suppression: by falling p (earlier first), keep rows farther than ``reach + slack`` from all kept."""
    at = df.columns.index(t)

    def keep(rows: list[tuple]) -> list[tuple]:
        times: list[float] = []
        kept = []
        for row in rows:
            i = bisect_left(times, row[at])
            if all(abs(row[at] - x) > reach + slack for x in times[max(0, i - 1) : i + 1]):
                times.insert(i, row[at])
                kept.append(row)
        return kept

    cut = islands(df, key, t, t, reach + slack, 64 * (reach + slack))
    return fold_sorted(cut, [*key, "island"], [F.desc(p), t], keep).drop("island")


def soft_targets(events: DataFrame, key: list[str], t: str, fps: float, sigma: float, frames: int) -> DataFrame:
    """(key, frame, target): the largest Gaussian of any event within three sigma of a frame."""
    reach = 3 * sigma * fps
    lo, hi = F.greatest(F.ceil(F.col(t) * fps - reach), F.lit(0)), F.least(F.floor(F.col(t) * fps + reach), F.lit(frames - 1))
    near = events.where(lo <= hi).withColumn("frame", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    d = (F.col("frame") / fps - F.col(t)) / sigma
    return near.groupBy(*key, "frame").agg(F.max(F.exp(-0.5 * d * d)).alias("target"))


def windows(df: DataFrame, start: Column, end: Column, length: float, overlap: float) -> DataFrame:
    """One row a window (win, win_start, win_end) of ``length`` every ``length - overlap``, the last cut at ``end``."""
    step = length - overlap
    n = F.greatest(F.lit(1), F.ceil((end - start - overlap) / step)).cast("int")
    rows = df.withColumn("win", F.explode(F.sequence(F.lit(0), n - 1)))
    at = start + F.col("win") * F.lit(step)
    return rows.withColumn("win_start", at).withColumn("win_end", F.least(at + length, end))


def owned_windows(df: DataFrame, key: list[str], start: Column, end: Column, length: float, overlap: float) -> DataFrame:
    """Windows with (own_start, own_end): every time belongs to one window, cut midway through overlaps."""
    w = windows(df, start, end, length, overlap)
    order = _by(key, "win")
    before, after = F.lag("win_end").over(order), F.lead("win_start").over(order)
    return w.withColumn("own_start", F.coalesce((before + F.col("win_start")) / 2, F.col("win_start"))).withColumn("own_end", F.coalesce((F.col("win_end") + after) / 2, F.col("win_end")))


def sample_slots(df: DataFrame, key: list[str], t: str, start: Column, slot: float, tie: str | None = None) -> DataFrame:
    """The first row of each slot of length ``slot`` since ``start``, by time and ``tie``: a rate-limited sample."""
    place = F.floor((F.col(t) - start) / slot + 1e-6)
    first = F.row_number().over(Window.partitionBy(*key, "slot").orderBy(t, *([tie] if tie else [])))
    return df.withColumn("slot", place).withColumn("_r", first).where("_r = 1").drop("_r")


def running_offsets(df: DataFrame, key: list[str], order: list[str], size: str) -> DataFrame:
    """(offset_start, offset_end) of rows laid one after the other."""
    total = F.sum(size).over(_by(key, *order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("offset_end", total).withColumn("offset_start", F.col("offset_end") - F.col(size))


def merge_capped(df: DataFrame, key: list[str], start: str, end: str, longest: float) -> DataFrame:
    """Merge overlapping intervals in order as long as the merged one stays at most ``longest``: (key, start, end, n). Walked a block of time at a time."""
    rows, n = df.select(*key, start, end), len(key)

    def take(rows: list[tuple], i: int, j: int) -> tuple:
        return (*rows[i][: n + 1], max(r[n + 1] for r in rows[i:j]), j - i)

    schema = StructType([*rows.schema, StructField("n", IntegerType())])
    return orbit(rows.where(F.col(end).isNotNull()), key, [start, end], longest, merged_up_to(n, n + 1, longest), take, schema, 16)


def kinematics(df: DataFrame, key: list[str], t: str, x: str, y: str, first_dt: float, width: float = 1.0, tie: str | None = None, bucket: float | None = None) -> DataFrame:
    """dt and speed (in widths a time unit) against the previous row by time and ``tie``; the first row takes ``first_dt``, a row of no time has no speed.

    With ``bucket``, a width of time, a key is sorted a bucket at a time, and the last row of the buckets before carried over.
    """
    order = [t, *([tie] if tie else [])]
    here = F.struct(*order, F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = carried(df.withColumn("_part", F.floor(F.col(t) / F.lit(bucket)) if bucket else F.lit(0).cast("long")), key, "_part", F.max(here), F.max, "_last")
    last = F.coalesce(F.lag(here).over(_by([*key, "_part"], *order)), "_last")
    dt = F.coalesce(F.col(t) - F.col("_before")[t], F.lit(first_dt))
    step = F.hypot(F.coalesce(F.col(x) - F.col("_before._x"), F.lit(0.0)), F.coalesce(F.col(y) - F.col("_before._y"), F.lit(0.0)))
    told = rows.withColumn("_before", last).withColumn("dt", dt).withColumn("speed", F.try_divide(step, F.col("dt") * F.lit(width)))
    return told.drop("_part", "_last", "_before")


def tumbling(df: DataFrame, key: list[str], frame: str, size: int) -> DataFrame:
    """Number fixed blocks of ``size`` frames; a block's label can then be joined back to all its frames."""
    return df.withColumn("block", F.floor(F.col(frame) / F.lit(size)).cast("long"))


def rolling_buffer(df: DataFrame, key: list[str], frame: str, x: str, size: int, out: str = "buffer", block: int = 1 << 16) -> DataFrame:
    """The last ``size`` values up to each row, the first one repeated where there are fewer.

    ``frame`` are consecutive places; they are taken ``block`` at a time, with the rows that the first ones need.
    """
    near = haloed(df, key, frame, block, size - 1, 0)
    w = _by([*key, "_part"], frame)
    have = F.collect_list(x).over(w.rowsBetween(-(size - 1), 0))
    head = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0))  # of the key where the list is short
    full = near.withColumn("_h", have).withColumn(out, F.concat(F.array_repeat(head, F.lit(size) - F.size("_h")), F.col("_h")))
    return full.where("_own").drop("_h", "_part", "_own")
