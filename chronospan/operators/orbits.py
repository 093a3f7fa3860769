"""Choices that jump from row to row, over keys of any size.

A rate limit or a capped merge is an orbit: from each chosen row a rule names the
next one, which lies within a ``reach`` of time or is the first row beyond. A key's
rows are cut into blocks of time. Whatever came before, a block is entered at one of
its first rows, so a block is a small table from the place of entry to the place of
entry into the next block. Tables of successive blocks compose; composed tables of
long stretches are chained, then those within each stretch, and each block is
walked from its own entry. No task holds more of a key's rows than a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .islands import fold_groups, same_key_join

#: Blocks whose tables are composed into one.
STRETCH = 256
#: From sorted rows: the place of the row that follows a given place, or the number of rows if none of them does.
Rule = Callable[[list[tuple]], Callable[[int], int]]


def step(table: list[int], place: int) -> int:
    """The place of entry into the next block: from beyond a block's rows, its first."""
    return table[place] if place < len(table) else 0


def block_table(rows: list[tuple], own: int, heads: int, following: Callable[[int], int]) -> list[int]:
    """For entries at each of the first ``heads`` places and the one after: the place in the next block at which the orbit leaves the first ``own`` rows."""
    left: dict[int, int] = {}
    for i in range(min(heads + 1, own)):
        path = []
        while i < own and i not in left:
            path.append(i)
            i = following(i)
        leaves = left[i] if i < own else i - own
        left.update(dict.fromkeys(path, leaves))
    return [left[i] for i in range(min(heads + 1, own))]


def composed(tables: list[list[int]]) -> list[int]:
    """One table for successive blocks, with an entry beyond the first block's rows too."""
    out = []
    for place in range(len(tables[0]) + 1):
        for table in tables:
            place = step(table, place)
        out.append(place)
    return out


def orbit(df: DataFrame, key: list[str], order: list[str], reach: float, rule: Rule, take: Callable[[list[tuple], int, int], tuple], schema: StructType, blocks: int = 64) -> DataFrame:
    """Rows ``take(rows, i, j)`` for the rows i of each key's orbit from its first row, j being the place of the next.

    ``rows`` are tuples of ``df``'s columns by ``order``, whose first column is a time. The rule may look
    at rows up to ``reach`` after a row; if none of these follows, the first row beyond does. A block is
    ``blocks`` times ``reach`` long. Rows without a time take no part.
    """
    width = blocks * reach
    t, size, at_key = df.columns.index(order[0]), len(df.columns), [df.columns.index(k) for k in key]
    kinds = {f.name: f.dataType for f in df.schema}
    keys = [StructField(k, kinds[k]) for k in key]
    block = F.floor(F.col(order[0]) / F.lit(width))
    own = df.where(F.col(order[0]).isNotNull()).withColumn("_block", block)
    ahead = F.array(F.col("_block"), F.when(F.col(order[0]) <= F.col("_block") * F.lit(width) + F.lit(reach), F.col("_block") - 1))
    dealt = own.withColumn("_own", F.col("_block")).withColumn("_block", F.explode(F.array_compact(ahead)))
    # A block of rows looked at ahead of time alone, before any of its own, is none.
    head = lambda rows: (rows[0][size], sum(r[size] == r[size + 1] for r in rows))

    def tables(rows: list[tuple]) -> list[tuple]:
        at, n = head(rows)
        if not n:
            return []
        heads = sum(r[t] <= at * width + reach for r in rows[:n])
        return [(*(rows[0][i] for i in at_key), at, block_table(rows, n, heads, rule(rows)))]

    where = StructField("_block", LongType())
    table = StructField("_table", ArrayType(IntegerType()))
    entry = StructField("_entry", IntegerType())
    each = fold_groups(dealt, [*key, "_block"], order, tables, StructType([*keys, where, table])).withColumn("_stretch", F.floor(F.col("_block") / STRETCH))
    n = len(key)

    def compose(rows: list[tuple]) -> list[tuple]:
        return [(*rows[0][:n], rows[0][n + 2], composed([r[n + 1] for r in rows]))]

    def chain(rows: list[tuple]) -> list[tuple]:
        """Entries of successive tables (key, place, table, and at the end the first entry)."""
        place, out = rows[0][-1], []
        for r in rows:
            out.append((*r[: n + 1], place))
            place = step(r[n + 1], place)
        return out

    long = fold_groups(each, [*key, "_stretch"], ["_block"], compose, StructType([*keys, StructField("_stretch", LongType()), table]))
    starts = fold_groups(long.withColumn("_entry", F.lit(0)), key, ["_stretch"], chain, StructType([*keys, StructField("_stretch", LongType()), entry]))
    within = same_key_join(each, starts, [*key, "_stretch"]).select(*key, "_block", "_table", "_stretch", "_entry")
    entries = fold_groups(within, [*key, "_stretch"], ["_block"], chain, StructType([*keys, where, entry]))

    def walk(rows: list[tuple]) -> list[tuple]:
        i, out = rows[0][size + 2], []
        _, n_own = head(rows)
        if i is None:
            return out
        following = rule(rows)
        while i < n_own:
            j = following(i)
            out.append(take(rows, i, j))
            i = j
        return out

    entered = same_key_join(dealt, entries, [*key, "_block"]).select(*df.columns, "_block", "_own", "_entry")
    return fold_groups(entered, [*key, "_block"], order, walk, schema)


def at_least_apart(t: int, least: float) -> Rule:
    """The first row at least ``least`` after; ``t`` is the place of the time in a row."""

    def rule(rows: list[tuple]) -> Callable[[int], int]:
        times = [r[t] for r in rows]

        def following(i: int) -> int:
            j = max(i + 1, bisect_left(times, times[i] + least))
            while j > i + 1 and times[j - 1] - times[i] >= least:  # a sum may be rounded
                j -= 1
            while j < len(times) and times[j] - times[i] < least:
                j += 1
            return j

        return following

    return rule


def merged_up_to(start: int, end: int, longest: float) -> Rule:
    """The first row that doesn't overlap those merged from a row on, or would make the whole longer than ``longest``."""

    def rule(rows: list[tuple]) -> Callable[[int], int]:
        def following(i: int) -> int:
            first, last, j = rows[i][start], rows[i][end], i + 1
            while j < len(rows) and rows[j][start] <= last and max(rows[j][end], last) - first <= longest:
                last = max(rows[j][end], last)
                j += 1
            return j

        return following

    return rule
