"""Groups of rows that can't affect rows outside them, and folds over such groups.

An order-dependent choice (suppression, greedy picks, merges, matching) depends
only on rows near by. Cutting a key's rows into islands first makes the groups
small, whatever the key's share of the table, and lets a task handle many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def same_key_join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null keys are equal; the table's key columns go."""
    other = table.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in table.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return rows.join(other, same, "left").drop(*[f"_on_{c}" for c in on])


def islands(df: DataFrame, key: list[str], start: str, end: str, gap: float, bucket: float | None = None, out: str = "island") -> DataFrame:
    """Add the start of each row's island: rows of a key with more than ``gap`` between the furthest end so far and the next start are parted.

    With ``bucket``, a width of time, a key's rows are sorted a bucket at a time and
    the ends and starts of buckets carried over, so a key in a third of all
    rows is many tasks' work; without it, a key is one sort.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(start) / F.lit(bucket)) if bucket else F.lit(0).cast("long"))
    on = [*key, "_bucket"]
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*on).orderBy(start, end)
    if bucket:
        ends = rows.groupBy(*on).agg(F.max(end).alias("_end"))
        rows = same_key_join(rows, ends.select(*on, F.max("_end").over(earlier).alias("_reach")), on)
    before = F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1))
    furthest = F.greatest(F.col("_reach"), before) if bucket else before
    new = furthest.isNull() | (F.col(start) - furthest > gap)
    told = rows.withColumn("_new", F.when(new, F.col(start)))
    local = told.withColumn(out, F.max("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    if bucket:
        heads = local.groupBy(*on).agg(F.max(out).alias("_head"))
        local = same_key_join(local, heads.select(*on, F.max("_head").over(earlier).alias("_carried")), on).withColumn(out, F.coalesce(out, "_carried"))
    return local.drop("_bucket", "_reach", "_new", "_carried")


def carried(rows: DataFrame, key: list[str], part: str, summary: Column, over_parts: Callable[[Column], Column], out: str, later: bool = False) -> DataFrame:
    """Add what the parts of a key before (``later``: after) a row's part say: ``over_parts`` of their ``summary``, null without any.

    A summary is an aggregate of a part's rows, combined before the shuffle; the table over which it is carried has a row a part.
    """
    beyond = Window.partitionBy(*key).orderBy(F.desc(part) if later else part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*key, part).agg(summary.alias("_summary"))
    return same_key_join(rows, parts.select(*key, part, over_parts(F.col("_summary")).over(beyond).alias(out)), [*key, part])


def haloed(df: DataFrame, key: list[str], at: str, width: float, before: float, after: float, part: str = "_part") -> DataFrame:
    """Rows dealt by ``width`` of ``at``, each also to the parts for whose rows it is within ``before`` ahead or ``after`` behind; ``_own`` is false there.

    A window of a part's rows then sees all that its own rows need of the key. ``before`` and ``after`` are at most ``width``.
    """
    own = F.floor(F.col(at) / F.lit(width))
    first, last = F.floor((F.col(at) - F.lit(after)) / F.lit(width)), F.floor((F.col(at) + F.lit(before)) / F.lit(width))
    dealt = df.withColumn("_home", own).withColumn(part, F.explode(F.array_distinct(F.array(first, own, last))))
    return dealt.withColumn("_own", F.col("_home") == F.col(part)).drop("_home")


def ranked(df: DataFrame, key: list[str], part: Column, order: list, out: str = "pos") -> DataFrame:
    """Add each row's place (from 1) in its key's ``order``, of which ``part`` is a whole number that never falls.

    Parts are ranked alone and shifted by the rows of the parts before, so a key
    of any size is many tasks' work.
    """
    rows = df.withColumn("_part", part)
    on = [*key, "_part"]
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    placed = same_key_join(local, counts.select(*on, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")), on)
    return placed.withColumn(out, F.col("_shift") + F.col("_local")).drop("_part", "_local", "_shift")


def fold_groups(df: DataFrame, key: list[str], order: list, fold: Callable[[list[tuple]], list[tuple]], schema: StructType) -> DataFrame:
    """Rows of ``schema`` that ``fold`` makes of each key's rows, given as tuples of ``df``'s columns in ``order``. A task sorts its keys and holds one of them at a time."""
    at = [df.columns.index(k) for k in key]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = [row[i] for i in at]
                if k != current:
                    out += fold(held) if held else []
                    current, held = k, []
                    if len(out) >= 10_000:
                        yield batch()
                        out = []
                held.append(row)
        out += fold(held) if held else []
        if out:
            yield batch()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def fold_sorted(df: DataFrame, key: list[str], order: list, fold: Callable[[list[tuple]], list[tuple]], keep: list[str] | None = None, add: dict[str, str] | None = None) -> DataFrame:
    """``fold_groups`` whose rows have the columns ``keep`` (all by default) and then those of ``add`` (name: long, or the name of a column to list)."""
    kinds = {f.name: f.dataType for f in df.schema}
    fields = [StructField(c, kinds[c]) for c in keep or df.columns]
    fields += [StructField(c, LongType() if k == "long" else ArrayType(kinds[k])) for c, k in (add or {}).items()]
    return fold_groups(df, key, order, fold, StructType(fields))
