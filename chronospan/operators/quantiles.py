"""Exact quantiles of keys of any size, by histograms that are refined round by round.

A key's values are counted in equal bins between its least and its largest, a
map-side combined count. The bin that holds a wanted rank becomes the next range,
with the rank within it, until a bin has few values or one value only. Bins are
cut by one expression that never falls with the value, so ranks are exact
whatever it rounds. A task holds the bins of a key, never its values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronospan.session import stored

#: Bins of a round, and the values of a key up to which one task holds them instead.
BINS, FEW = 4096, 200_000


def _join(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the table's other columns, for keys that it has; null keys are equal."""
    other = table.select(*[F.col(c).alias(f"_on_{c}") if c in key else F.col(c) for c in table.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in key], F.lit(True))
    return rows.join(other, same).drop(*[f"_on_{c}" for c in key])


def order_statistics(df: DataFrame, key: list[str], x: str, targets: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(key, rank, value): the value at each rank from 0 of ``targets`` (key, rank) among a key's values, nulls and NaN left out."""
    values = df.select(*key, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ends = values.groupBy(*key).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    # rank: what is asked for; _at: the rank among the values of the range that holds it.
    open_ = stored(_join(targets.select(*key, "rank", F.col("rank").alias("_at")), ends, key), "ranks")
    done = []
    while True:
        small = (F.col("_n") <= few) & (F.col("_lo") < F.col("_hi"))
        done.append(open_.where("_lo = _hi").select(*key, "rank", F.col("_lo").alias("value")))
        ranges = open_.where(small).select(*key, "_lo", "_hi").distinct()
        within = _join(values, ranges, key).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        sorted_ = within.groupBy(*key, "_lo", "_hi").agg(F.array_sort(F.collect_list("_x")).alias("_values"))
        picked = _join(open_.where(small), sorted_, [*key, "_lo", "_hi"])
        done.append(picked.select(*key, "rank", F.get("_values", F.col("_at").cast("int")).alias("value")))
        wide = open_.where((F.col("_n") > few) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        spans = wide.select(*key, "_lo", "_hi").distinct()
        inside = _join(values, spans, key).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        # Halves, as the whole width of a range may be beyond the numbers.
        share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        middle = F.least(F.floor(F.nanvl(share, F.lit(0.5)) * bins), F.lit(bins - 1))  # infinite ends have no share
        bin_ = F.when(F.col("_x") == F.col("_lo"), F.lit(0).cast("long")).when(F.col("_x") == F.col("_hi"), F.lit(bins - 1).cast("long")).otherwise(middle)
        counted = inside.groupBy(*key, "_lo", "_hi", bin_.alias("_bin")).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count(F.lit(1)).alias("_m"))
        before = Window.partitionBy(*key, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        hit = _join(wide.drop("_n"), placed.drop("_bin"), [*key, "_lo", "_hi"]).where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_m")))
        open_ = stored(hit.select(*key, "rank", (F.col("_at") - F.col("_before")).alias("_at"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_m").alias("_n")), "ranks")
    return reduce(DataFrame.unionByName, done)


def exact_quantiles(df: DataFrame, key: list[str], x: str, quantiles: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(key, a column a quantile): exact quantiles with linear interpolation between neighbours, nulls and NaN left out; null for keys without a value.

    Keys of up to ``few`` values are one aggregate; those of more are selected from by ``order_statistics``.
    """
    names = list(quantiles)
    known = df.select(*key, F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias("_x"))
    counts = known.groupBy(*key).agg(F.count("_x").alias("_n"))
    many = counts.where(F.col("_n") > few)
    direct = [F.percentile("_x", F.lit(float(q))).alias(name) for name, q in quantiles.items()]
    if many.isEmpty():
        return known.groupBy(*key).agg(*direct)
    many = stored(many, "many")
    other = many.select(*[F.col(k).alias(f"_on_{k}") for k in key])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in key], F.lit(True))
    rest = known.join(other, same, "left_anti").groupBy(*key).agg(*direct)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("place")) for name, q in quantiles.items()])
    places = many.select(*key, F.explode(wanted).alias("w")).select(*key, "w.*", F.explode(F.array_distinct(F.array(F.floor("w.place"), F.ceil("w.place")))).alias("rank"))
    found = order_statistics(_join(known, many.drop("_n"), key), key, "_x", places.select(*key, "rank").distinct(), bins, few)
    low, high, share = F.min("value"), F.max("value"), F.max(F.col("place") - F.floor("place"))
    each = _join(places, found, [*key, "rank"]).groupBy(*key, "name").agg((low + (high - low) * share).alias("value"))
    return rest.unionByName(each.groupBy(*key).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in names]))
