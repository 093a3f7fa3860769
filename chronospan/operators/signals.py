"""Alignment of two signals of a key by the lag of largest correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .islands import haloed, same_key_join


def best_lag(df: DataFrame, key: list[str], pos: str, x: str, y: str, most: int, block: int = 1 << 16, silent: float = 1e-6) -> DataFrame:
    """(key, status, lag, correlation): the lag within ``most`` at which y, moved back by it, is most like x; the smallest of equal ones.

    ``pos`` are whole places; both signals are less their means, and the sum of
    products at a lag is over the norms of the whole signals. A key with a norm
    under ``silent`` is ``silent_window``, with lag 0 and no correlation. Each block of places, with ``most``
    more of y on either side, gives its share of the sum at every lag, and the shares
    are added up; nothing is held of a key but a number a lag. Nulls, and places that aren't there, add nothing.
    """
    means = df.groupBy(*key).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    level = same_key_join(df.select(*key, pos, x, y), means, key).select(
        *key, F.col(pos).cast("long").alias("_pos"), F.coalesce(F.col(x) - F.col("_mx"), F.lit(0.0)).alias("_x"), F.coalesce(F.col(y) - F.col("_my"), F.lit(0.0)).alias("_y")
    )
    norms = level.groupBy(*key).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_nx"), F.sqrt(F.sum(F.col("_y") * F.col("_y"))).alias("_ny"))
    step = max(block, most)
    dealt = haloed(level, key, "_pos", step, most, most)
    rows = dealt.groupBy(*key, "_part").agg(F.collect_list(F.struct((F.col("_pos") - F.col("_part") * step + most).alias("i"), F.when(F.col("_own"), F.col("_x")).otherwise(0.0).alias("x"), F.col("_y").alias("y"))).alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for held in batch.column(batch.num_columns - 1):
                at, a, b = (held.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                both = np.zeros((2, step + 2 * most))
                both[0, at], both[1, at] = a, b
                sums.append(np.correlate(both[1], both[0, most : most + step], "valid"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "_sums"])

    kinds = dict(df.dtypes)
    shares = rows.drop("_part").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "_sums array<double>"]))
    at_lag = shares.select(*key, F.posexplode("_sums").alias("_i", "_s")).groupBy(*key, "_i").agg(F.sum("_s").alias("_s"))
    best = at_lag.groupBy(*key).agg(F.max(F.struct("_s", (-F.col("_i")).alias("i"))).alias("_best"))
    met = same_key_join(norms, best, key)
    loud = (F.col("_nx") >= silent) & (F.col("_ny") >= silent)
    return met.select(
        *key, F.when(loud, "checked").otherwise("silent_window").alias("status"), F.when(loud, -F.col("_best.i") - most).otherwise(0).cast("long").alias("lag"),
        F.when(loud, F.col("_best._s") / (F.col("_nx") * F.col("_ny"))).alias("correlation"),
    )
