"""Helpers that the training-data operators share.

Tables that cut lineage are Parquet files below the folder named by
``spark.checkpoint.dir``, which driver and executors share, so that a lost
executor costs a re-read and never an unreachable local file.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these.
BLANKS = r"[\x20\x09-\x0D]+"
#: Largest table, in bytes of Parquet, that is ever sent to every executor.
BROADCAST_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a session without one, as in tests, gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronospan-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronospan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Has Spark delete a query's shuffle files when it ends; what is stored is read from its files from then on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries within have their shuffle files deleted when they end."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


class Stored:
    """A DataFrame written once to the shared folder and read back from there."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        with shuffle_files_deleted(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def bytes(self) -> int:
        fs, p = _hadoop(self.spark, self.path)
        return int(fs.getContentSummary(p).getLength())

    def drop(self) -> None:
        """Delete the files; only for tables that nothing reads any more."""
        fs, p = _hadoop(self.spark, self.path)
        fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows of fewer files than there are cores over as many tasks as cores: a small file is one task's, however long its texts take."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the left side's keys stay."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    met = left.join(other, same, how)
    return met if how in ("left_semi", "left_anti") else met.drop(*[f"_on_{c}" for c in on])


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def maybe_broadcast(table: Stored, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its files are small, else as it is (a shuffle join)."""
    return F.broadcast(table.df) if table.bytes() <= limit else table.df


def gapless_rank(df: DataFrame, group: list[str], order: list[str], spread: Column, buckets: int, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2... within ``group``, however large a group is.

    A group is dealt over ``buckets`` parts by ``spread``, ranked by ``order``
    within each part, and shifted by the rows of the parts before. The table of
    shifts has ``groups * buckets`` rows, so callers bound the number of groups.
    """
    from pyspark.sql import Window

    part = df.withColumn("_part", F.pmod(spread, F.lit(buckets)).cast("int"))
    keys = [*group, "_part"]
    sizes = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        part.withColumn("_local", local)
        .join(F.broadcast(shifts), keys)
        .withColumn(name, F.col("_local").cast("long") - 1 + F.col("_shift"))
        .drop("_part", "_local", "_shift")
    )


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: of one type with an order) as (id, component), component being the smallest id.

    Alternating large-star and small-star rounds, each a map-side combined
    minimum and a join back, until the edges stop changing. Minima are stored
    before they are joined: small ones are broadcast, and for others Spark splits
    the rows of a component's root. Ids without an edge are not returned.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now = Stored(e, name)
    seen = _fingerprint(now.df)
    for _ in range(max_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = Stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        met = both.join(maybe_broadcast(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Stored(met.where("u <> v").distinct(), name)
        least = Stored(large.df.groupBy("u").agg(F.min("v").alias("m")), name)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.df.join(maybe_broadcast(least), "u").select(F.explode(ends).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        nxt = Stored(small, name)
        mark = _fingerprint(nxt.df)
        for table in (now, low, large, least):
            table.drop()
        now = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"{name}: no fixpoint after {max_rounds} rounds")
    roots = now.df.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.df.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
