"""Folds whose state soon forgets its past, over keys of any size.

A key's rows are cut into chunks. Each chunk is folded at once, from a state that the
rows before it have warmed up. Where that isn't the state in which the chunk before really ended, the
chunk is folded again from there, till all seams agree. So the result is always that of one fold from the first row to
the last; how much is folded again depends on how well the fold forgets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chronospan.session import stored

from .islands import fold_groups, haloed, same_key_join

#: From values and the text of a state, or None at the first row of a key: what comes out for each value, and the text of the state after.
Fold = Callable[[list, str | None], tuple[list, str]]


def speculative_fold(df: DataFrame, key: list[str], pos: str, x: str, fold: Fold, out: StructField, chunk: int, warm: int) -> DataFrame:
    """(key, pos, out): each row with what ``fold`` gives for its x, a key's rows being taken by ``pos``, consecutive whole places.

    ``warm`` rows, at most ``chunk`` of them, warm a chunk up.
    """
    rows, n = df.select(*key, pos, x), len(key)
    keys = [f for f in (rows.schema[c] for c in key)]
    part, first, last = StructField("_part", LongType()), StructField("_in", StringType()), StructField("_out", StringType())
    told = StructType([*keys, part, first, last])
    # Rows of a chunk are (key, pos, x, part, own, ...), those before it first.

    def guess(held: list[tuple]) -> list[tuple]:
        before, own = ([r[n + 1] for r in held if r[n + 3] is mine] for mine in (False, True))
        if not own:
            return []
        start = fold(before, None)[1] if before else None
        return [(*held[0][:n], held[0][n + 2], start, fold(own, start)[1])]

    def again(held: list[tuple]) -> list[tuple]:
        start = held[0][-1]
        return [(*held[0][:n], held[0][n + 2], start, fold([r[n + 1] for r in held], start)[1])]

    dealt = haloed(rows, key, pos, chunk, warm, 0)
    own = dealt.where("_own").drop("_own")
    states = stored(fold_groups(dealt, [*key, "_part"], [pos], guess, told), "states")
    order = Window.partitionBy(*key).orderBy("_part")
    while True:
        seams = states.withColumn("_true", F.lag("_out").over(order))
        wrong = stored(seams.where(~F.col("_true").eqNullSafe(F.col("_in"))).select(*key, "_part", "_true"), "wrong")
        if wrong.isEmpty():
            break
        redo = same_key_join(own, wrong, [*key, "_part"]).where("_true is not null")
        fresh = fold_groups(redo, [*key, "_part"], [pos], again, told).select(*key, "_part", F.col("_in").alias("_in2"), F.col("_out").alias("_out2"))
        met = same_key_join(states, fresh, [*key, "_part"])
        changed = F.col("_out2").isNotNull()
        states = stored(met.select(*key, "_part", F.when(changed, F.col("_in2")).otherwise(F.col("_in")).alias("_in"), F.when(changed, F.col("_out2")).otherwise(F.col("_out")).alias("_out")), "states")

    def final(held: list[tuple]) -> list[tuple]:
        found, _ = fold([r[n + 1] for r in held], held[0][-1])
        return [(*r[: n + 1], v) for r, v in zip(held, found, strict=True)]

    started = same_key_join(own, states.select(*key, "_part", "_in"), [*key, "_part"])
    return fold_groups(started, [*key, "_part"], [pos], final, StructType([*keys, rows.schema[pos], out]))
