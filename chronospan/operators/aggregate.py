"""Aggregates: bins, null-aware scores, robust spread, histograms and weighted rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import carried
from .quantiles import exact_quantiles


def fixed_bins(df: DataFrame, key: list[str], t: str, width: int, measures: dict[str, Column]) -> DataFrame:
    """Every bin of a key between its first and last, half-open, with the measures; empty bins have 0."""
    rows = df.withColumn("bin", F.floor(F.col(t) / F.lit(width)).cast("long"))
    have = rows.groupBy(*key, "bin").agg(*[m.alias(n) for n, m in measures.items()])
    span = have.groupBy(*key).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    every = span.select(*key, F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    return every.join(have, [*key, "bin"], "left").fillna(0, list(measures))


def null_aware_score(values: Column, weights: dict[str, float], scale: float = 25.0) -> Column:
    """Struct (score, observed_weight, unknown) of a map of dimension to value: null dimensions are unknown, not 0."""
    names = sorted(weights)
    known = lambda n: F.element_at(values, n)
    total = sum((F.when(known(n).isNotNull(), F.lit(weights[n])).otherwise(0.0) for n in names), F.lit(0.0))
    got = sum((F.coalesce(known(n) * F.lit(weights[n]), F.lit(0.0)) for n in names), F.lit(0.0))
    unknown = F.array_compact(F.array(*[F.when(known(n).isNull(), F.lit(n)) for n in names]))
    share = total / F.lit(float(sum(weights.values())))
    return F.struct(F.try_divide(got * scale, total).alias("score"), share.alias("observed_weight"), unknown.alias("unknown"))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rule_score(features: dict[str, Column], weights: dict[str, float], digits: int = 3) -> Column:
    """Sum of weighted features, each clipped to [0, 1] and rounded half-even before adding."""
    return sum((F.bround(clipped(features[n]) * F.lit(weights[n]), digits) for n in sorted(weights)), F.lit(0.0))


def scaled_percentile(df: DataFrame, key: list[str], x: str, q: float, least: float = 1.0) -> DataFrame:
    """The exact interpolated percentile of x a key, at least ``least``."""
    return exact_quantiles(df, key, x, {"_q": q}).select(*key, F.greatest(F.lit(least), F.col("_q")).alias("scale"))


def histogram(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, label, n) in long form; one map-side combined count."""
    return df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))


def robust_z(df: DataFrame, key: list[str], x: str, floor: float, factor: float = 1.4826) -> DataFrame:
    """Rows with median, scaled median absolute deviation (at least ``floor``) and z a key: two selections, joined back."""
    center = exact_quantiles(df, key, x, {"center": 0.5})
    off = df.select(*key, x).join(center, key).select(*key, F.abs(F.col(x) - F.col("center")).alias("_off"))
    spread = exact_quantiles(off, key, "_off", {"_mad": 0.5}).select(*key, F.greatest(F.lit(floor), F.col("_mad") * F.lit(factor)).alias("spread"))
    return df.join(center.join(spread, key), key).withColumn("z", (F.col(x) - F.col("center")) / F.col("spread"))


def jumps(df: DataFrame, key: list[str], t: str, x: str, more: float, tie: str, bucket: float | None = None) -> DataFrame:
    """Whether x rose by more than ``more`` since the previous row. With ``bucket``, a width of time, a key is sorted a bucket at a time."""
    here = F.struct(t, tie, F.col(x).alias("_x"))
    rows = carried(df.withColumn("_part", F.floor(F.col(t) / F.lit(bucket)) if bucket else F.lit(0).cast("long")), key, "_part", F.max(here), F.max, "_last")
    last = F.coalesce(F.lag(here).over(Window.partitionBy(*key, "_part").orderBy(t, tie)), "_last")
    return rows.withColumn("transient", F.coalesce(F.col(x) - last["_x"] > more, F.lit(False))).drop("_part", "_last")


def window_mean_sigmoid(df: DataFrame, key: list[str], pos: str, x: str, window: int, stride: int) -> DataFrame:
    """Mean of x over all windows that hold a position, then the sigmoid: overlapping window scores in long form."""
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - (window - 1)) / stride))
    last = F.floor(F.col(pos) / stride)
    spread = df.withColumn("_win", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return spread.groupBy(*key, pos).agg(F.avg(x).alias("mean")).withColumn("probability", 1 / (1 + F.exp(-F.col("mean")))).drop("mean")


def status(all_ok: Column, any_ok: Column) -> Column:
    """complete / partial / unavailable from what all and any parts report."""
    return F.when(all_ok, "complete").when(any_ok, "partial").otherwise("unavailable")
