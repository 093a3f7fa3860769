"""Row rules as data: named predicates that give violations, reasons or an ordered veto."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronospan.operators.islands import carried


def reasons(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules that hold; a null rule doesn't."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The first rule that holds, in order: an ordered veto; null if none."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()])


def violations(df: DataFrame, id_: list[str], rules: dict[str, Column]) -> DataFrame:
    """(id, rule), one row a rule that a row breaks: one pass over the table whatever the number of rules."""
    return df.select(*id_, F.explode(reasons(rules)).alias("rule"))


def split_by(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def finite_between(x: Column, low: float, high: float) -> Column:
    """Whether a number is known, finite and in range; never null."""
    return F.coalesce(~F.isnan(x) & x.between(low, high), F.lit(False))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) for keys of two or more rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shared_values(df: DataFrame, split: str, value: str) -> DataFrame:
    """(value, splits) of values in more than one split: empty when splits are disjoint."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def coverage(df: DataFrame, key: list[str], t: str, start: Column, end: Column, gap: float, least: int, bucket: float | None = None) -> DataFrame:
    """(key, n, largest_gap, ok): enough rows, no gap too large, both ends within a gap of the span.

    With ``bucket``, a width of time, a key is sorted a bucket at a time, and the last time of the buckets before carried over.
    """
    part = F.floor(F.col(t) / F.lit(bucket)) if bucket else F.lit(0).cast("long")
    rows = carried(df.withColumn("_a", start).withColumn("_b", end).withColumn("_part", part), key, "_part", F.max(t), F.max, "_last")
    before = F.coalesce(F.lag(t).over(Window.partitionBy(*key, "_part").orderBy(t)), "_last")
    a = rows.withColumn("_gap", F.col(t) - before).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_gap"), F.lit(0)).alias("largest_gap"), F.min(F.col(t) - F.col("_a")).alias("_head"), F.min(F.col("_b") - F.col(t)).alias("_tail")
    )
    ok = (F.col("n") >= least) & (F.col("largest_gap") <= gap) & (F.col("_head") <= gap) & (F.col("_tail") <= gap)
    return a.select(*key, "n", "largest_gap", ok.alias("ok"))


def contiguous(df: DataFrame, key: list[str], order: str, start: str, end: str) -> DataFrame:
    """Rows whose start is not the end of the row before (or that overlap it)."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("expected", F.lag(end).over(w)).where(F.col("expected").isNotNull() & (F.col("expected") != F.col(start)))


def require_empty(df: DataFrame, message: str) -> None:
    """Raise with a few examples if a table of violations has rows."""
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {bad}")
