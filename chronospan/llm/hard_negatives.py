"""Hard-negative mining by norm-bucketed search (operator 13).

Points are sorted by norm and cut into buckets, each one row that packs its
vectors and carries its largest norm. Anchors are packed in blocks. By
Cauchy-Schwarz no score of a bucket is over ``|anchor| * largest norm``, so a block
needs only the buckets up from a first one: the block's least wanted score, which
is a window's lower limit or a running kth score, decides. As buckets are in order of
norm, the kept ones are a range of numbers, and blocks meet buckets by an equi join on
the number; there is no join of points with points. Within a task the buckets of a
block come by falling norm, and those that the running kth scores rule out are
skipped before they are multiplied.

The search runs twice: for each anchor's best rows of its label (positives), and
for each positive's window, a share of its score, the best rows of other labels.

Defined results: scores are whole numbers, ties go to the smaller id. Rows with a
null id, label or vector, or with a null or non-finite component, take no
part; nor do vectors so long that a score could leave a long (norm of 2**31 or more).
Components that a shorter vector lacks count as 0, and an empty vector scores 0. Rows equal in id, label and
vector count once; rows of the anchor's id are never its partners; rows that
share an id with other vectors or labels are rows of their own. Empty tables, and
anchors without positives or positives without negatives, give no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

#: Rows a bucket and anchors a block; a task holds one of each and their scores.
BUCKET, BLOCK = 2048, 256
#: Ranges of buckets that a block is dealt over, each searched alone with its own running scores.
SHELVES = 16
#: Groups of buckets whose largest norms the driver holds to find a block's first bucket.
TOPS = 1024
#: Packed rows that a task takes from Spark at once.
ROWS_AT_ONCE = 16
#: Vectors from this norm on take no part.
LONGEST = 2.0**31
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def points(df: DataFrame, id_: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """Rows (id, label, q, norm): usable rows once each, components as whole numbers ``floor(scale * x)``."""
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(LONGEST / scale)))  # false for NaN's and infinity's sizes too
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & usable)
    q = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("q"))
    size = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return q.withColumn("norm", size).where(F.col("norm") < LONGEST).distinct()


PACK = "struct<n: long, dim: long, top: double, ids: binary, labels: binary, norms: binary, q: binary>"
_SCHEMA = pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("top", pa.float64()), *((c, pa.binary()) for c in ("ids", "labels", "norms", "q"))])


def _pack(rows: pa.Table) -> dict:
    lists, ids, labels, norms = (rows.column(c).combine_chunks() for c in ("q", "id", "label", "norm"))
    lengths = lists.value_lengths().to_numpy()
    q = np.zeros((len(lengths), int(lengths.max())), np.int32)
    q[np.arange(q.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    kind = next(k for k in (np.int8, np.int16, np.int32) if k is np.int32 or (len(q) and q.size and np.iinfo(k).min <= q.min() and q.max() <= np.iinfo(k).max))
    order = np.argsort(ids.to_numpy(), kind="stable")
    parts = [x[order].tobytes() for x in (ids.to_numpy(), labels.to_numpy(), norms.to_numpy(), q.astype(kind))]
    return dict(zip(_SCHEMA.names, (len(q), q.shape[1], float(norms.to_numpy().max()), *parts), strict=True))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(place, ``name``): one packed row for up to ``size`` successive rows of a partition; places rise with the partitions and within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_pack(pa.Table.from_batches(held))], pa.struct(list(_SCHEMA)))], [name])

        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - sum(x.num_rows for x in held))
                held.append(part)
                b = b.slice(part.num_rows)
                if sum(x.num_rows for x in held) == size:
                    yield out()
                    held = []
        if held:
            yield out()

    packed = rows.select("id", "label", "q", "norm").mapInArrow(run, f"{name} {PACK}")
    return packed.withColumn("place", F.monotonically_increasing_id())


class _Unpacked:
    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.norms, self.top = np.frombuffer(row["norms"], np.float64), row["top"]
        kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(row["q"]) // (n * dim) if dim else 4]
        self.q = np.frombuffer(row["q"], kind).reshape(n, dim)


def scores(a: _Unpacked, b: _Unpacked) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave its whole numbers, else in whole numbers."""
    dim = min(a.q.shape[1], b.q.shape[1])
    kind = np.float64 if a.top * b.top < 2.0**52 else np.int64
    return (a.q[:, :dim].astype(kind) @ b.q[:, :dim].astype(kind).T).astype(np.int64)


class Best:
    """The best k (score, id) of each window so far: falling score, then rising id."""

    def __init__(self, windows: int, k: int):
        self.k, self.score, self.id = k, np.full((windows, k), LEAST), np.full((windows, k), MOST)

    def add(self, window: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:
            kept = score >= np.partition(score, -self.k)[-self.k]
            score, ids = score[kept], ids[kept]
        score, ids = np.concatenate([self.score[window], score]), np.concatenate([self.id[window], ids])
        order = np.lexsort((ids, ~score))[: self.k]  # ~x is -x - 1, for the least number too
        self.score[window], self.id[window] = score[order], ids[order]


FOUND = "block long, window long, anchor long, anchor_id long, p long, positive long, score long, other long"


def _search(blocks: DataFrame, buckets: DataFrame, n_buckets: int, k: int, share: tuple[int, int] | None, name: str) -> DataFrame:
    """The best k rows of every window of ``blocks`` (block, a, windows, p, positive, first) with ``rank``, stored.

    Window w belongs to the anchor at place ``windows[w]`` of its block. Without ``share`` it takes all rows of the anchor's label; with
    it the rows of other labels whose score is between these percentages of ``p[w]``. ``first`` is the first bucket to look in.
    """
    step = max(1, -(-n_buckets // SHELVES))
    last, shelf = F.lit(n_buckets - 1).cast("long"), lambda bucket: F.floor(bucket / step)
    needed = blocks.where(F.col("first") < n_buckets)
    # Pairs hold numbers alone, and a block comes once a shelf, before its buckets. Spark takes exploded rows for as few as there were
    # before and would send them all to the driver and every executor, hence the hint.
    pairs = needed.select("block", F.explode(F.sequence("first", last)).alias("bucket"))
    met = pairs.join(buckets.hint("merge"), "bucket").select("block", shelf(F.col("bucket")).alias("shelf"), "bucket", "b")
    heads = needed.select("block", F.explode(F.sequence(shelf(F.col("first")), shelf(last))).alias("shelf"), F.lit(n_buckets).cast("long").alias("bucket"), "windows", "p", "positive", "a")
    ordered = heads.unionByName(met, allowMissingColumns=True).repartition("block", "shelf").sortWithinPartitions("block", "shelf", F.desc("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None

        def found() -> pa.RecordBatch:
            w, j = np.nonzero(best.score > LEAST)
            columns = (np.full(len(w), current[0]), w, windows[w], a.ids[windows[w]], p[w], positive[w], best.score[w, j], best.id[w, j])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [c.split()[0] for c in FOUND.split(", ")])

        for row in (x for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            if row["b"] is None:
                if current is not None:
                    yield found()
                current, a = (row["block"], row["shelf"]), _Unpacked(row["a"])
                windows, p, positive = (np.array(row[c], np.int64) for c in ("windows", "p", "positive"))
                best = Best(len(windows), k)
                lows = np.array([-(-share[0] * x // 100) for x in p.tolist()], np.int64) if share else np.full(len(p), LEAST + 1)
                highs = np.array([share[1] * x // 100 for x in p.tolist()], np.int64) if share else np.full(len(p), MOST)
                continue
            # Cauchy-Schwarz, rounded up, against each window's lower limit and running kth score.
            wanted = np.maximum(lows, best.score[:, -1])
            open_ = (a.norms[windows] * row["b"]["top"] * (1 + 1e-9) + 1 >= wanted) & (lows <= highs)
            if not open_.any():
                continue
            b = _Unpacked(row["b"])
            product = scores(a, b)
            for w in np.flatnonzero(open_):
                i = windows[w]
                s = product[i]
                fits = (s >= wanted[w]) & (s <= highs[w]) & ((b.labels == a.labels[i]) != bool(share)) & (b.ids != a.ids[i])
                if fits.any():
                    best.add(w, s[fits], b.ids[fits])
        if current is not None:
            yield found()

    rows = ordered.select("block", "shelf", "windows", "p", "positive", "a", "b").mapInArrow(run, FOUND)
    order = Window.partitionBy("block", "window").orderBy(F.desc("score"), "other")  # of SHELVES * k rows at most
    return _stored(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name).df


def _stored(df: DataFrame, name: str) -> Stored:
    """Store what Python makes of packed rows, a few of which it takes at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, str(ROWS_AT_ONCE))
    try:
        return Stored(df, name)
    finally:
        conf.set(key, was)


def _buckets(known: DataFrame, size: int) -> tuple[DataFrame, int, list[float], int]:
    """Buckets (bucket, b) numbered by norm, how many there are, and the largest norms of up to TOPS ranges of so many of them."""
    by_norm = known.repartitionByRange("norm", "id", "label").sortWithinPartitions("norm", "id", "label")
    cut = Stored(_packed(by_norm, size, "b"), "norm_buckets").df
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in cut.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = [0] * (max(counts, default=-1) + 2), 0
    for i in range(len(before)):
        before[i], total = total, total + counts.get(i, 0)
    shift = F.get(F.lit(before), part.cast("int"))
    numbered = cut.select((shift + local).cast("long").alias("bucket"), "b")
    width = max(1, -(-total // TOPS))
    tops = numbered.groupBy(F.floor(F.col("bucket") / width).alias("g")).agg(F.max("b.top").alias("top")).orderBy("g").collect()
    return numbered, total, [r.top for r in tops], width


def mine(usable: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, bucket_rows: int = BUCKET, block_rows: int = BLOCK) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``points``.

    Anchors are the points for which ``is_anchor``, a condition on ``id``, holds. The
    negatives of a positive of score p are the best rows of other labels whose
    score n has ``low * p <= 100 * n <= high * p``.
    """
    known = Stored(usable, "points").df
    buckets, n_buckets, tops, width = _buckets(known, bucket_rows)
    spread = known.where(is_anchor).repartition("id").sortWithinPartitions("id", "label", "norm")
    anchors = Stored(_packed(spread, block_rows, "a"), "anchor_blocks").df.withColumnRenamed("place", "block")
    places = F.transform(F.sequence(F.lit(1).cast("long"), F.col("a.n")), lambda i: i - 1)
    nothing = F.transform(places, lambda i: F.lit(0).cast("long"))
    whole = anchors.select("block", "a", places.alias("windows"), nothing.alias("p"), nothing.alias("positive"), F.lit(0).cast("long").alias("first"))
    chosen = _search(whole, buckets, n_buckets, positives, None, "positives")
    listed = chosen.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("anchor", F.col("score").alias("p"), F.col("other").alias("positive")))).alias("w"))
    # A bucket whose largest norm is under this can hold no score of the block's lowest window.
    reach = (F.array_min(F.transform("w.p", lambda p: p.cast("double") * (low / 100))) * (1 - 1e-9) - 2) / F.greatest(F.col("a.top"), F.lit(1.0))
    heights = F.lit(tops).cast("array<double>")
    first = F.size(F.filter(heights, lambda t: t < reach)).cast("long") * width if tops else F.lit(0).cast("long")
    windows = listed.join(anchors, "block").select("block", "a", F.col("w.anchor").alias("windows"), F.col("w.p").alias("p"), F.col("w.positive").alias("positive"), first.alias("first"))
    best = _search(windows, buckets, n_buckets, negatives, (low, high), "negatives")
    return best.select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
