"""Quality rules by host (operator 2).

Each document gets base counts and a base verdict. Failures are added up by
host (map-side combined, so a host with a third of all rows is one partial sum
a task), each host's failure rate is shrunk towards an empirical beta prior
fitted by moments to the hosts' counts, and the host verdict is joined back.

Defined results: null or blank text has no words and fails; a null host has no
verdict of its own, so its documents keep their base verdict; equal rows are
judged alike and all returned; empty input gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, maybe_broadcast

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(tokens: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(tokens)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, n)
    if len(ids) == n:
        return 0
    pair = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)[1]
    _, at, times = np.unique(pair * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = times[at] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= hit
    return int(mark.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    tokens = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    return (
        len(tokens),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(tokens),
    )


def count_words(docs: DataFrame, host: str) -> DataFrame:
    """Rows (doc_id, host, the five counts), one a document."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_counts(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T.copy())], ["doc_id", "host", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(run, f"doc_id long, host string, {FEATURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, failed: str, max_rate: float, min_strength: float = 2.0) -> DataFrame:
    """Rows (host, host_docs, host_failures, host_rate, host_failed), one a non-null host.

    The prior Beta(m s, (1 - m) s) has the rate m of all documents. Its strength
    s = 1 / r - 1 comes from the part r of the hosts' spread, each weighted by
    its documents, that sampling of documents within hosts doesn't explain: at
    least ``min_strength``, and 1e6 where nothing is left or m is 0 or 1. A
    single host, or hosts of one document each, tell nothing: ``min_strength``.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures")
    )
    table = Stored(hosts, "hosts")
    n, f = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    k, docs, squares, failures, spread = (x or 0 for x in table.df.agg(F.count(F.lit(1)), F.sum(n), F.sum(n * n), F.sum(f), F.sum(f * f / n)).first())
    m, strength = prior(k, docs, squares, failures, spread, min_strength)
    shrunk = (F.col("host_failures") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    return table.df.withColumn("host_rate", shrunk).withColumn("host_failed", shrunk > max_rate)


def prior(k: int, docs: float, squares: float, failures: float, spread: float, min_strength: float) -> tuple[float, float]:
    """Mean and strength from the hosts' number and the sums of documents n, n * n, failures f and f * f / n."""
    if not k:
        return 0.0, min_strength
    m = failures / docs
    free = docs - squares / docs - (k - 1)
    if k < 2 or free <= 0:
        return m, min_strength
    if not 0 < m < 1:
        return m, 1e6
    shared = ((spread - docs * m * m) / (m * (1 - m)) - (k - 1)) / free
    return m, max(min_strength, min(1e6, 1 / shared - 1)) if shared > 0 else 1e6


def judge_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """All documents with base counts, ``base_failed``, host figures and ``kept``.

    A document is kept if it passes the base rules and its host's shrunk
    failure rate is at most ``max_rate``.
    """
    judged = Stored(count_words(docs, host).withColumn("base_failed", base_failed()), "quality")
    verdicts = Stored(host_verdicts(judged.df, "host", "base_failed", max_rate), "host_verdicts")
    back = judged.df.join(maybe_broadcast(verdicts), "host", "left")
    return back.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
