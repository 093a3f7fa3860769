"""Joins on intervals, times and sets of rows, all with an equi key so that they shuffle and never loop over all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import carried, fold_sorted, islands, same_key_join


def _buckets(a: Column, b: Column, width: float) -> Column:
    return F.sequence(F.floor(a / width), F.floor(b / width))


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: float, l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("other_start", "other_end")) -> DataFrame:
    """Pairs of a key whose intervals overlap strictly (touching ends don't).

    Both sides are dealt into buckets of ``width``; a pair is kept in the bucket
    of its later start only, so no distinct is needed. Choose ``width`` near
    the typical length: an interval is repeated once a bucket it touches.
    """
    a = left.withColumn("_bucket", F.explode(_buckets(F.col(l[0]), F.col(l[1]), width)))
    b = right.withColumn("_bucket", F.explode(_buckets(F.col(r[0]), F.col(r[1]), width)))
    met = a.join(b, [*key, "_bucket"])
    late = F.greatest(F.col(l[0]), F.col(r[0]))
    return met.where((late < F.least(F.col(l[1]), F.col(r[1]))) & (F.col("_bucket") == F.floor(late / width))).drop("_bucket")


def point_join(points: DataFrame, intervals: DataFrame, key: list[str], t: str, width: float, ends: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of a key with start <= t < end."""
    b = intervals.withColumn("_bucket", F.explode(_buckets(F.col(ends[0]), F.col(ends[1]), width)))
    met = points.withColumn("_bucket", F.floor(F.col(t) / width)).join(b, [*key, "_bucket"])
    return met.where((F.col(ends[0]) <= F.col(t)) & (F.col(t) < F.col(ends[1]))).drop("_bucket")


def contained_join(inner: DataFrame, outer: DataFrame, key: list[str], width: float, i: tuple[str, str] = ("start", "end"), o: tuple[str, str] = ("other_start", "other_end")) -> DataFrame:
    """Pairs of a key with outer start <= inner start < inner end <= outer end."""
    met = point_join(inner, outer, key, i[0], width, o)
    return met.where((F.col(i[0]) < F.col(i[1])) & (F.col(i[1]) <= F.col(o[1])))


def near_any(left: DataFrame, right: DataFrame, key: list[str], t: str, other_t: str, reach: float, anti: bool = False) -> DataFrame:
    """Left rows with (``anti``: without) a right row of the key within ``reach``, both ends included."""
    marks = right.select(*key, F.col(other_t).alias("_o")).withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_o") / reach) + d for d in (-1, 0, 1)])))
    a = left.withColumn("_bucket", F.floor(F.col(t) / reach))
    on = [a[k] == marks[k] for k in [*key, "_bucket"]] + [F.abs(a[t] - marks["_o"]) <= reach]
    return a.join(marks, on, "left_anti" if anti else "left_semi").drop("_bucket")


def asof(probe: DataFrame, data: DataFrame, key: list[str], t: str, value: str, following: bool = True, clamp: bool = True, tie: str | None = None, bucket: float | None = None, strict: bool = False) -> DataFrame:
    """Probe rows with the value (and ``matched_t``) of the first row at or after (or last at or before) their time.

    One sort of the union, so linear; with ``clamp``, a probe past the last (first) row takes that row.
    Equal data times: ``tie`` decides. With ``strict``, a row of the probe's own time doesn't count. With ``bucket``, a
    width of time, a key is sorted a bucket at a time, and the nearest row of the buckets beyond carried over.
    """
    part = lambda c: F.floor(F.col(c) / F.lit(bucket)) if bucket else F.lit(0).cast("long")
    hit = F.struct(F.col(t).alias("t"), (F.col(tie) if tie else F.lit(0)).alias("tie"), F.col(value).alias("v"))
    d = data.where(F.col(t).isNotNull()).select(*key, F.col(t).alias("_t"), hit.alias("_d"), F.lit(following != strict).cast("int").alias("_side"))
    p = probe.select(*key, F.col(t).alias("_t"), F.struct(*probe.columns).alias("_p"), F.lit(following == strict).cast("int").alias("_side"))
    both = p.unionByName(d, allowMissingColumns=True).withColumn("_part", part("_t"))
    w = Window.partitionBy(*key, "_part").orderBy("_t", "_side", "_d")
    nearest = F.min if following else F.max
    rows = carried(both, key, "_part", nearest("_d"), nearest, "_beyond", later=following)
    if following:
        near = F.first("_d", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        near = F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("_m", F.coalesce(near, "_beyond")).where("_p is not null")
    if clamp:
        ends = d.groupBy(*key).agg((F.max if following else F.min)("_d").alias("_end"))
        met = same_key_join(met, ends, key).withColumn("_m", F.coalesce("_m", "_end"))
    return met.select("_p.*", F.col("_m.v").alias("matched"), F.col("_m.t").alias("matched_t"))


def snapped_outwards(spans: DataFrame, frames: DataFrame, key: list[str], start: str, end: str, t: str, inner: tuple[str, str], bucket: float | None = None, slack: float = 1e-6) -> DataFrame:
    """Spans whose ends lie on frames: ``start`` on the last frame at or before the time ``inner[0]``, ``end`` on the first at or after ``inner[1]``.

    ``inner`` names columns of the times that a span has to hold. An end without such a frame keeps its place. With ``bucket``, a key is sorted a bucket at a time.
    """
    seen = frames.select(*key, F.col(t).alias("_at"), F.col(t).alias("_frame"))
    low = asof(spans.withColumn("_at", F.col(inner[0]) + slack), seen, key, "_at", "_frame", False, False, None, bucket).withColumn(start, F.coalesce("matched", start)).drop("matched", "matched_t")
    high = asof(low.withColumn("_at", F.col(inner[1]) - slack), seen, key, "_at", "_frame", True, False, None, bucket).withColumn(end, F.coalesce("matched", end))
    return high.select(*spans.columns)


def neighbours(df: DataFrame, key: list[str], t: str, is_anchor: Column, value: str, tie: str | None = None, bucket: float | None = None) -> DataFrame:
    """Each row's previous and next anchor value by time and ``tie``, itself excluded.

    With ``bucket``, a width of time, a key is sorted a bucket at a time, and the nearest anchors of the buckets beyond carried over.
    """
    order = [t, *([tie] if tie else [])]
    rows = df.withColumn("_part", F.floor(F.col(t) / F.lit(bucket)) if bucket else F.lit(0).cast("long"))
    rows = rows.withColumn("_anchor", F.when(is_anchor & F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))
    rows = carried(rows, key, "_part", F.max("_anchor"), F.max, "_earlier")
    rows = carried(rows, key, "_part", F.min("_anchor"), F.min, "_later", later=True)
    w = Window.partitionBy(*key, "_part").orderBy(*order)
    before = F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_anchor", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    told = rows.withColumn("previous", F.coalesce(before, "_earlier")["_v"]).withColumn("following", F.coalesce(after, "_later")["_v"])
    return told.drop("_part", "_anchor", "_earlier", "_later")


def nearest_element(points: Column, x: Column, y: Column) -> Column:
    """Struct (distance, index) of the nearest of an array of (x, y) structs; the first of equally near ones."""
    return F.array_min(F.transform(points, lambda p, i: F.struct(F.hypot(p["x"] - x, p["y"] - y).alias("distance"), i.alias("index"))))


def any_box_contains(boxes: Column, x: Column, y: Column, margin: float) -> Column:
    """Whether any (x0, y0, x1, y1) box, grown by a share of its size on each side, contains the point."""
    def inside(b):
        dx, dy = (b["x1"] - b["x0"]) * margin, (b["y1"] - b["y0"]) * margin
        return x.between(b["x0"] - dx, b["x1"] + dx) & y.between(b["y0"] - dy, b["y1"] + dy)

    return F.exists(boxes, inside)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 when they don't overlap."""
    meet = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(meet, (a1 - a0) + (b1 - b0) - meet), F.lit(0.0))


def best_overlap(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str, width: float, l=("start", "end"), r=("other_start", "other_end")) -> DataFrame:
    """For each left interval the right one of largest overlap (ties: smallest id), null without any."""
    met = overlap_join(left, right, key, width, l, r)
    size = F.least(F.col(l[1]), F.col(r[1])) - F.greatest(F.col(l[0]), F.col(r[0]))
    best = met.groupBy(left_id).agg(F.min(F.struct((-size).alias("less"), F.col(right_id).alias("id"))).alias("b"))
    return left.join(best, left_id, "left").select(*left.columns, F.col("b.id").alias("best"), (-F.col("b.less")).alias("overlap"))


def compare_rows(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """One row a key of either side: which side has it and which columns differ (null equals null)."""
    a, b = left.select(*on, F.struct(*columns).alias("_a")), right.select(*on, F.struct(*columns).alias("_b"))
    met = a.join(b, on, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return met.select(*on, side.alias("side"), F.when(side == "both", differ).otherwise(F.array().cast("array<string>")).alias("differing"))


def bin_overlay(intervals: DataFrame, key: list[str], start: str, end: str, score: str, bins: DataFrame, width: float, background: float = 0.0) -> DataFrame:
    """Each bin (key, bin) with the largest score of an interval that overlaps it, else the background."""
    last = F.greatest(F.ceil(F.col(end) / width) - 1, F.floor(F.col(start) / width))
    hit = intervals.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    best = hit.groupBy(*key, "bin").agg(F.max(score).alias("score"))
    return bins.join(best, [*key, "bin"], "left").withColumn("score", F.coalesce("score", F.lit(background)))


def match_counts(truth: DataFrame, predicted: DataFrame, key: list[str], t: str, tolerance: float) -> DataFrame:
    """tp, fp, fn a key by one-to-one matching within ``tolerance``: two pointers reach the largest matching on a line.

    Times with a longer pause between them never match, so each island is matched alone and its counts are added up.
    """
    both = truth.select(*key, F.col(t).alias("_t"), F.lit(True).alias("_true")).unionByName(predicted.select(*key, F.col(t).alias("_t"), F.lit(False).alias("_true")))

    def match(rows: list[tuple]) -> list[tuple]:
        a, b = ([r[-3] for r in rows if r[-2] is side] for side in (True, False))
        i = j = tp = 0
        while i < len(a) and j < len(b):
            if abs(a[i] - b[j]) <= tolerance + 1e-9:
                tp, i, j = tp + 1, i + 1, j + 1
            elif a[i] < b[j]:
                i += 1
            else:
                j += 1
        return [(*rows[0][:-3], tp, len(b) - tp, len(a) - tp)]

    cut = islands(both, key, "_t", "_t", tolerance + 1e-9, 64 * (tolerance + 1e-9))
    counts = fold_sorted(cut, [*key, "island"], ["_t", "_true"], match, key, {"tp": "long", "fp": "long", "fn": "long"})
    return counts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def greedy_pairs(df: DataFrame, key: list[str], left: str, right: str, distance: str, most: float, margin: float) -> DataFrame:
    """One-to-one pairs by rising distance up to ``most``; a left item whose two nearest differ by less than ``margin`` has none."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[distance] < most].sort_values([distance, left, right])
        near = pdf.groupby(left)[distance].apply(lambda d: len(d) < 2 or d.iloc[1] - d.iloc[0] >= margin)
        used: set = set()
        out = []
        for row in pdf.itertuples(index=False):
            a, b = getattr(row, left), getattr(row, right)
            if near[a] and ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)

    return df.groupBy(*key).applyInPandas(match, df.schema)
