"""Packing by cutting-stock column generation (operator 8).

A document's ids, then one end id, are cut into full sequences and a rest. The
lengths of all pieces, in classes of ``step`` tokens, make a histogram whose
size doesn't grow with the corpus. On it the driver solves the linear program
of the cutting-stock problem: columns are patterns (how many pieces of each
class fill one sequence), a knapsack dynamic program over the duals prices new
columns, and the solution is rounded down; what rounding leaves over, at most
one sequence's worth a basic pattern, is packed first-fit by length. Pieces are
ranked within their class on Spark, and a rank's place in the list of patterns
gives its sequence.

Defined results: null or empty text is the end id alone; equal rows are packed
separately; ties in rank are between equal rows only; empty input gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Stored, gapless_rank

CAPACITY = 2048
#: Tokens a length class spans; a piece takes its class's upper end in patterns.
STEP = 16
END_ID = 1
#: Parts into which each length class is dealt for ranking; the table of part sizes has classes * parts rows.
RANK_PARTS = 64
#: The linear program ends when its value is within this share of its lower bound.
GAP = 1e-3


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): full sequences and a rest for each document."""
    end = bpe.packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.load(vocabulary).ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), total))
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the largest total value of pieces within ``room``, and how many of each size."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if k := fits[w]:
            got = best[w - s[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[w] + 1e-12:
                best[w], pick[w] = got[j], j
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[order[pick[w]]] += 1
            w -= int(s[pick[w]])
    return float(best[room]), counts


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, max_columns: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: basic patterns (rows) and how often each is used, fractional.

    Rounding errors of the basis only make the solution less good: whoever rounds
    it down checks each pattern against what is left of the demand.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (room // sizes))
    x = inverse @ demand
    for _ in range(max_columns):
        duals = inverse.sum(axis=0)
        value, column = best_pattern(sizes, duals, room)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
            break
        d = inverse @ column
        ratios = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratios.argmin())
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        patterns[r] = column
        x = np.maximum(inverse @ demand, 0)
    else:
        warnings.warn(f"column generation stopped after {max_columns} columns, short of its gap of {gap}", stacklevel=2)
    assert patterns.shape == (m, m)
    return patterns, x


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, copies) that use up ``demand`` exactly."""
    if not len(sizes):
        return []
    patterns, x = relaxed(sizes, demand.astype(float), room)
    left, found = demand.copy(), []
    for p, n in sorted(zip(patterns, np.floor(x + 1e-9).astype(np.int64), strict=True), key=lambda t: -t[1]):
        used = p > 0
        n = int(min(n, (left[used] // p[used]).min())) if used.any() else 0
        if n > 0:
            found.append((p, n))
            left -= n * p
    while left.any():  # first fit, long to short, one open sequence at a time, repeated while it lasts
        p, free = np.zeros_like(left), room
        for i in np.argsort(-sizes, kind="stable"):
            if sizes[i] <= free and left[i]:
                p[i] = min(left[i], free // sizes[i])
                free -= int(p[i] * sizes[i])
        n = int((left[p > 0] // p[p > 0]).min())
        found.append((p, n))
        left -= n * p
    return found


def plan(histogram: dict[int, int], room: int) -> dict[str, np.ndarray]:
    """For each class, the ranges of ranks and the sequences that they go to, sorted by (class, rank)."""
    full = histogram.get(room, 0)
    sizes = np.array(sorted(c for c in histogram if c != room), np.int64)
    demand = np.array([histogram[c] for c in sizes.tolist()], np.int64)
    taken = {int(c): 0 for c in sizes}
    rows, base = ([(room, 0, 1, 0)], full) if full else ([], 0)
    for pattern, copies in whole_patterns(sizes, demand, room):
        for i in np.flatnonzero(pattern):
            c, each = int(sizes[i]), int(pattern[i])
            rows.append((c, taken[c], each, base))
            taken[c] += each * copies
        base += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("cls", "rank", "each", "sequence"), table.T, strict=True))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece."""
    pieces = Stored(cut(docs, vocabulary or bpe.default_vocabulary(), capacity), "pieces").df
    classed = pieces.withColumn("cls", F.ceil(F.col("length") / step).cast("long"))
    histogram = {r.cls: r.n for r in classed.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan(histogram, capacity // step)
    keys = (table["cls"] << 48) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, r = (batch.column(i).to_numpy() for i in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(keys, (c << 48) + r, side="right") - 1
            sequence = table["sequence"][at] + (r - table["rank"][at]) // table["each"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence)], [*batch.schema.names[:-2], "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = gapless_rank(classed, ["cls"], ["doc_id", "start", "ids_crc32"], F.xxhash64("doc_id", "start"), RANK_PARTS, "rank")
    placed = ranked.select(*names, "cls", "rank").mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "sequence_id"]))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
