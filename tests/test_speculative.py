"""Chunks folded at once against one fold from the first row to the last, for folds that forget and one that never does."""

import random

from pyspark.sql.types import LongType, StructField

from chronospan.operators.speculative import speculative_fold
from chronospan.streaming import streams as T


def test_sizes_in_chunks_equal_one_fold(spark):
    r = random.Random(4)
    values = {k: [r.choice([None, 0.0, r.uniform(1, 60), r.gauss(20, 2)]) for _ in range(n)] for k, n in (("a", 900), ("b", 70), ("c", 1))}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, pos long, x double").repartition(5)
    got = {(x.k, x.pos): x["size"] for x in T.sizes_batch(df, "k", "pos", "x", 64, 8).collect()}  # a warm-up far too short: many seams differ
    assert got == {(k, i): s for k, vs in values.items() for i, s in enumerate(T.sizes(vs, None)[0])}


def test_a_fold_that_never_forgets_is_still_right(spark):
    def total(values, state):
        n, out = int(state or 0), []
        for v in values:
            n += v
            out.append(n)
        return out, str(n)

    df = spark.createDataFrame([(None, i, i % 3) for i in range(100)], "k string, pos long, x long")
    got = {x.pos: x.total for x in speculative_fold(df, ["k"], "pos", "x", total, StructField("total", LongType()), 16, 4).collect()}
    assert got == {i: sum(j % 3 for j in range(i + 1)) for i in range(100)}
