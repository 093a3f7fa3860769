"""Cross-tokenizer alignment by relational steps (operator 12).

Two tokenizers cut the same bytes. A document is encoded with the byte that each
token ends at, the running sum of token lengths. Tokens are exploded with their places and ends, and an equi join on
document and end finds the places where both cut. The running number of cuts is the group of
a token: a group is the shortest stretch that both sides cut alike. A range of
places between two cuts gives the group's tokens of each side.

Documents are dealt by a key of their own, encoded there and stored once in buckets of it, so that the join
of tokens stays where their document is; only texts and linked
pairs of ids are shuffled, not tokens. Buckets are in the order of keys, so the join sorts what is nearly sorted.

Defined results: null and empty texts, and texts whose bytes a tokenizer
doesn't give back, have no tokens: zeros and an empty digest. Equal rows
are aligned each for itself and both count. Empty input gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Stored, maybe_broadcast, scratch_path, shuffle_files_deleted

#: Words that a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 150_000, 32
#: Taken from ids, so that those of 65,536 fit in two bytes.
SHIFT = 1 << 15
#: Buckets for each shuffle partition: a document has as many rows as tokens once it is exploded, and a bucket's should be sorted in memory.
BUCKETS_EACH = 4
#: Documents of a batch that a task encodes at once.
SLICE = 256
#: Largest table of pair counts, in bytes of Parquet, that is sent to every executor.
COUNTS_BYTES = 16 << 20
#: Joins on (document, end) use that both sides are dealt by document, and lists of a document's cuts that the join has sorted them.
_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}


def default_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


class Pieces:
    """Ids of a sentencepiece model that puts a blank first, and each id's bytes.

    Where no piece holds a line end or reaches over a blank, words between single blanks and line ends are encoded alone and remembered.
    """

    def __init__(self, model: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.bytes = [_piece_bytes(p, self._model.is_byte(i)) for i, p in enumerate(names)]
        self._apart = not any("\n" in p or ("▁" in p[1:] and p.strip("▁")) for p in names) and len(self._model.encode("\n")) == 2
        self.unknown = self._model.unk_id()
        self._known: dict[str, bytes] = {}

    def _word(self, ids: list[int], word: str) -> bytes:
        return bpe.packed(ids[1:] if word[0] == "\n" else ids)  # the blank put first stands alone before a line end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts. Words that aren't remembered are encoded at once."""
        cut = [self._words(t) for t in texts]
        new = list({w for words in cut if words for w in words}.difference(self._known))
        ids = {w: self._word(x, w) for w, x in zip(new, self._model.encode(new, num_threads=1), strict=True)} if new else {}
        room = CACHE_WORDS - len(self._known)
        get, late = self._known.get, ids.get
        out = [b"".join([get(w) or late(w) for w in words]) if words else bpe.packed(self._model.encode(t, num_threads=1)) for t, words in zip(texts, cut, strict=True)]
        self._known.update((w, ids[w]) for w in [w for w in new if len(w) <= CACHE_CHARS][: max(0, room)])
        return out

    def _words(self, text: str) -> list[str] | None:
        """The words of a text that can be encoded alone, a line end standing before its word; None if they can't."""
        if not self._apart or text[:1] in ("", " ", "\n") or text[-1] == " " or "  " in text or " \n" in text or "▁" in text:
            return None
        return text.replace("\n", " \n").split(" ")


class Bytes:
    """Ids of a blank and a text by a byte-level BPE vocabulary, special tokens' strings being plain text, and each id's bytes."""

    def __init__(self, vocabulary: str):
        self.encode = bpe.load(vocabulary).encode_after_blank
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = bpe.printable_bytes()
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()


@lru_cache(maxsize=2)
def load(vocabulary: str, model: str) -> tuple[Bytes, Pieces]:
    """Both tokenizers, one pair a Python worker, kept between tasks."""
    return Bytes(vocabulary), Pieces(model)


def encoded(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """(key, doc_id, a, b, a_end, b_end) of documents (key, doc_id, text): ids by both tokenizers and the bytes they end at, empty where their bytes differ from a blank and the text.

    Byte-level tokens give a text back; pieces do where none is unknown and the text holds no blank sign of the model's own.
    Ids are held less ``SHIFT``, in two bytes where the vocabularies allow it.
    """
    kind = ("short", np.int16) if max(map(len, (t.bytes for t in load(vocabulary, model)))) <= 2 * SHIFT else ("int", np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = load(vocabulary, model)
        sizes = [np.fromiter(map(len, t.bytes), np.int32, len(t.bytes)) for t in (one, two)]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t if t and "▁" not in t else "" for t in part.column(2).to_pylist()]
                a = [np.frombuffer(one.encode(t) if t else b"", np.int32) for t in texts]
                b = [np.frombuffer(x if t else b"", np.int32) for t, x in zip(texts, two.encode(texts), strict=True)]
                same = [not (y == two.unknown).any() for y in b]
                lists, running = [], []
                for side, n_bytes in zip((a, b), sizes, strict=True):
                    kept = [x if ok else x[:0] for x, ok in zip(side, same, strict=True)]
                    offsets = pa.array(np.cumsum([0, *map(len, kept)], dtype=np.int32))
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array((np.concatenate(kept) - SHIFT).astype(kind[1]))))
                    running.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.cumsum(n_bytes[x], dtype=np.int32) for x in kept]))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists, *running], ["key", "doc_id", "a", "b", "a_end", "b_end"])

    return docs.mapInArrow(run, f"key long, doc_id long, a array<{kind[0]}>, b array<{kind[0]}>, a_end array<int>, b_end array<int>")


def ends(dealt: DataFrame, side: str) -> DataFrame:
    """(key, at, end): one side's tokens by place with the byte that each ends at."""
    return dealt.select("key", F.posexplode(f"{side}_end").alias(f"{side}_at", "end"))


class Bucketed:
    """Rows made of ``df`` by ``make``, which keeps ``key``, in buckets of it: written once to the shared folder, and read back from there.

    ``df`` is dealt before, so what is made isn't shuffled. The integers ``rising`` are held as differences.
    """

    def __init__(self, df: DataFrame, make: Callable[[DataFrame], DataFrame], key: str, rising: list[str], name: str):
        self.spark, self.name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
        n = BUCKETS_EACH * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made = make(df.repartition(n, key))
        columns = ", ".join(f"{c} {kind}" for c, kind in made.dtypes)
        options = ", ".join(["compression 'zstd'", "'parquet.writer.version' 'v2'", *[f"'parquet.enable.dictionary#{c}.list.element' 'false'" for c in rising]])
        buckets = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS"
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet OPTIONS ({options}) {buckets} LOCATION '{scratch_path(self.spark, name)}'")
        with shuffle_files_deleted(self.spark):
            made.write.insertInto(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table; its files go with the shared folder."""
        self.spark.sql(f"DROP TABLE {self.name}")


def align(dealt: DataFrame) -> DataFrame:
    """(key, doc_id, a, b, cuts) of ``encoded`` rows in buckets of key: ``cuts`` lists in order the places of the tokens that end together, a's above b's 32 bits.

    The running number of a cut, its place in the list, is its group: the tokens after the places of the cut before, up to its own.
    """
    cuts = ends(dealt, "a").join(ends(dealt, "b"), ["key", "end"])
    place = F.shiftleft(F.col("a_at").cast("long"), 32).bitwiseOR(F.col("b_at").cast("long"))
    listed = cuts.groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("cuts"))
    return dealt.select("key", "doc_id", "a", "b").join(listed, "key", "left")


@lru_cache(maxsize=2)
def _written(n: int) -> np.ndarray:
    """The ids up to ``n`` as text before a comma, then before a bar, then before a semicolon."""
    return np.array([f"{i}{after}" for after in ",|;" for i in range(n)], object)


def _group_text(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, n: int) -> str:
    """The groups of ids below ``n`` that end at the places ``a_at`` and ``b_at`` as text: ``a1,a2|b1;a3|b2,b3``."""
    if not len(a_at):
        return ""
    from_a = np.arange(a_at[-1] + 1) + np.repeat(np.r_[0, b_at[:-1] + 1], np.diff(a_at, prepend=-1))
    from_b = np.arange(b_at[-1] + 1) + np.repeat(a_at + 1, np.diff(b_at, prepend=-1))
    out = np.empty(len(from_a) + len(from_b), np.int32)
    out[from_a], out[from_b] = a[: len(from_a)], b[: len(from_b)]
    out[from_a[a_at]] += n
    out[from_b[b_at]] += 2 * n
    return "".join(_written(n)[out].tolist())[:-1]


def grouped(aligned: DataFrame, n: int) -> DataFrame:
    """(key, doc_id, n_a, n_b, groups, links) of ``align``, ids being below ``n``: the groups as text, and the pairs (a_id, b_id) of tokens that end together, in order."""

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [flat[i:j] for i, j in zip(offsets, offsets[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                a, b = ([x.astype(np.int32) + SHIFT for x in lists(part.column(c))] for c in ("a", "b"))
                cuts = lists(part.column("cuts"))
                places = [(c >> 32, c & ((1 << 32) - 1)) for c in cuts]
                text = [_group_text(x, y, *p, n) for x, y, p in zip(a, b, places, strict=True)]
                ids = [pa.array(np.concatenate([x[p[side]] for x, p in zip(all_, places, strict=True)])) for side, all_ in enumerate((a, b))]
                offsets = pa.array(np.cumsum([0, *map(len, cuts)], dtype=np.int32))
                pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(ids, ["a_id", "b_id"]))
                sizes = [pa.array(list(map(len, x)), pa.int64()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), *sizes, pa.array(text, pa.string()), pairs], ["key", "doc_id", "n_a", "n_b", "groups", "links"])

    rows = aligned.select("key", "doc_id", "a", "b", F.coalesce("cuts", F.array().cast("array<long>")).alias("cuts"))
    return rows.mapInArrow(run, "key long, doc_id long, n_a long, n_b long, groups string, links array<struct<a_id: int, b_id: int>>")


def linked_pairs(linked: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how many of the rows (a_id, b_id) hold each pair, and whether that is its ``b_id``'s highest."""
    counts = Stored(linked.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n")), "pair_counts").df
    highest = counts.groupBy("b_id").agg(F.max("n").alias("_most"))
    return counts.join(highest, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignment_report(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all documents."""
    spark, vocabulary, model = docs.sparkSession, vocabulary or bpe.default_vocabulary(), model or default_piece_model()
    one, two = load(vocabulary, model)
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long"), "text")
    held = Bucketed(keyed, lambda dealt: encoded(dealt, vocabulary, model), "key", ["a_end", "b_end"], "token_alignment")
    was = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        aligned = align(held.df)
        digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.lit(""))
        told = Stored(grouped(aligned, max(len(one.bytes), len(two.bytes))).select("key", "doc_id", "n_a", "n_b", digest.alias("groups_sha256"), "links"), "aligned").df
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        held.drop()
    each = told.select("key", F.inline("links"))
    pairs = Stored(linked_pairs(each), "linked_pairs")
    rated = each.join(maybe_broadcast(pairs, COUNTS_BYTES), ["a_id", "b_id"])
    sums = rated.groupBy("key").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    n = F.size("links").cast("long")
    met = told.withColumn("n_links", n).drop("links").join(sums, "key", "left").fillna(0, ["n_best", "count_sum"])
    return met.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
