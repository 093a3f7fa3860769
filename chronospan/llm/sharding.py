"""Rendezvous sharding (operator 5).

Every record key gets one score per shard from a hash of (key, shard) and goes
to the highest. A shard's score is ``-weight / ln(u)`` with u the hash in
(0, 1), which makes its share of keys proportional to its weight. A new shard
of any weight only adds one more score, so the rows that move are those the new
shard wins.

Defined results: a null key hashes as such, so all null keys share one shard;
equal keys share a shard; empty input gives no rows; a null text has size
16 (no bytes, plus the record overhead) and checksum 0; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Parts into which each shard is dealt for ranking; the table of part sizes has shards * parts rows.
RANK_PARTS = 256


def _score(key: Column, shard: int, weight: float) -> Column:
    """The shard's score for a key, in one order for all weights: by ``-weight / ln(u)``, then by the hash itself."""
    h = F.xxhash64(key, F.lit(shard))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    unsigned = h.bitwiseXOR(F.lit(-(1 << 63)))
    return F.struct((-F.lit(float(weight)) / F.ln(u)).alias("score"), unsigned.alias("hash"), F.lit(shard).alias("shard"))


def assign(key: Column, weights: list[float]) -> Column:
    """Shard (int) of a key among ``len(weights)`` shards; ties go to the larger shard number."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    best = [_score(key, i, w) for i, w in enumerate(weights)]
    return (F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, parts: int = RANK_PARTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, grown_shard) for all documents.

    ``grown_shard`` is the shard after one more of average weight joins.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight a shard")
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        assign(key, weights).alias("shard"),
        assign(key, [*weights, sum(weights) / shards]).alias("grown_shard"),
    )
    return gapless_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], F.xxhash64("doc_id", F.lit("slot")), parts, "slot")
