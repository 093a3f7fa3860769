"""Substring dedup by sliding sentence spans (operator 9).

A text is cut into sentences: after ``.``, ``!`` or ``?`` and at line ends, and
also before an upper-case word that follows a lower-case one, where pasted
text tends to start within a sentence; the full stops of unspaced scripts
(``STOPS``) need no blank after them. From every sentence on, and up to every
sentence, the shortest run of consecutive sentences of at least ``min_words``
words (several sentences, unless one has that many by itself) is hashed, so any
repeated stretch of that many words is covered by repeated runs to its last
sentence. A letter of an unspaced script counts as a word. Runs meet across the
corpus by hash; the first of equal runs, by (doc_id, sentence), stays, and
sentences that any other of them covers are removed.

Hashes are 128 bits of XXH3 over the run's sentences, each with its blanks at
the ends cut off. Runs are counted by half of their hash, map-side first, which
leaves those that may repeat; they then meet by the whole hash. Both joins
are shuffle joins at every size, as repeated runs grow with the corpus; Spark
splits the rows of a passage that is in a third of all documents.

Defined results: null, blank or short text has no run and loses nothing; runs
repeated within one document count like others; rows of equal doc_id and text
are one document and leave each other alone; rows of one doc_id with different
texts are documents of their own, told apart by ``mark``; null doc_ids come
first; empty input gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, maybe_broadcast

MIN_WORDS = 25
#: Ends of sentences in scripts that put no blank after them.
STOPS = "。！？｡"
_CUT = re.compile(rf"(?<=[.!?])\s+|\s*\n\s*|(?<=[^\W\d_A-Z]) (?=[^\W\d_a-z])|(?<=[{STOPS}])(?![{STOPS}」』”’）\s])\s*|(?<=[{STOPS}][」』”’）])(?![{STOPS}」』”’）\s])\s*|(?<=[{STOPS}」』”’）])\s+")
#: Letters that are written without blanks between words: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Code point ranges of the sentences of a text; blanks between them belong to none."""
    out, start = [], 0
    if text:
        for m in _CUT.finditer(text):
            if m.end() < len(text) and m.group() == " " and not text[m.end()].isupper():
                continue
            if m.start() > start:
                out.append((start, m.start()))
            start = m.end()
        if start < len(text) and text[start:].strip():
            out.append((start, len(text)))
    return out


def count_words(part: str) -> int:
    """Words between blanks, where each letter of an unspaced script is a word of its own."""
    return len(part.split()) if part.isascii() else len(_UNSPACED.sub(" x ", part).split())


def runs(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, last sentence) of the shortest runs of ``min_words`` words from each sentence on and up to each sentence."""
    if not text:
        return []
    parts = [text[a:b].strip() for a, b in sentences(text)]
    total = np.cumsum([0, *map(count_words, parts)])
    if total[-1] < min_words:
        return []
    ends = np.searchsorted(total, total[:-1] + min_words)
    found = {(i, j) for i, j in enumerate(ends.tolist()) if j < len(total)}
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    found |= {(i, j) for j, i in enumerate(starts.tolist(), 1) if i >= 0}
    packed = b"".join(xxhash.xxh3_64_digest(p.encode("utf-8", "surrogatepass")) for p in parts)
    return [(xxhash.xxh3_128_digest(packed[8 * i : 8 * j]), i, j - 1) for i, j in sorted(found)]


def hashed_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (h, h2, doc_id, mark, first, last) of all runs."""
    names = ["h", "h2", "doc_id", "mark", "first", "last"]

    def packed(found: list[tuple[bytes, int, int]], docs: list[tuple], sizes: list[int]) -> pa.RecordBatch:
        hashes, first, last = zip(*found, strict=True)
        halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        ids, marks = (pa.array(x, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for x in zip(*docs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids, marks, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, docs, sizes = [], [], []
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own := runs(text, min_words):
                    found += own
                    docs.append((doc, mark))
                    sizes.append(len(own))
                if len(found) > 50_000:
                    yield packed(found, docs, sizes)
                    found, docs, sizes = [], [], []
            if found:
                yield packed(found, docs, sizes)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "h long, h2 long, doc_id long, mark long, first int, last int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, mark, first, last, kept_in): runs of sentences to remove, and the document that keeps each."""
    every = Stored(hashed_runs(docs, min_words), "sentence_runs")
    several = Stored(every.df.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "sentence_runs_several")
    met = Stored(every.df.join(several.df.hint("merge"), "h", "left_semi"), "sentence_runs_met")
    every.drop()
    place = F.struct("doc_id", "mark", "first")
    firsts = met.df.groupBy("h", "h2").agg(F.min(place).alias("keeper"), F.max(place).alias("other")).where("keeper <> other")
    keepers = Stored(firsts.select("h", "h2", "keeper"), "sentence_runs_kept")  # read back, so that the join's rows can be split
    found = met.df.join(keepers.df.hint("merge"), ["h", "h2"]).where(place != F.col("keeper"))
    return found.select("doc_id", "mark", "first", "last", F.col("keeper.doc_id").alias("kept_in"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, n_removed, spans, kept_in) for documents that lose sentences.

    ``spans`` are the (first, last) sentences of the removed stretches, merged
    and in order; ``kept_in`` are the documents that keep them. Lists are as
    long as one document's own spans at most.
    """
    return marked_removals(docs, min_words).drop("mark")


def marked_removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """:func:`removals` with the document's ``mark``."""
    found = repeated_spans(docs, min_words).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"), F.array_sort(F.collect_set("kept_in")).alias("kept_in")
    )
    start = F.array(F.element_at("s", 1))
    grown = lambda acc, x: F.when(
        x["first"] <= F.element_at(acc, -1)["last"] + 1,
        F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    merged = found.select("doc_id", "mark", F.aggregate("s", start, grown).alias("spans"), "kept_in")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return merged.select("doc_id", "mark", removed.alias("n_removed"), "spans", "kept_in")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the sentences of ``spans`` and the blanks that follow them."""
    cut = sentences(text)
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : cut[first][0]])
        at = cut[last + 1][0] if last + 1 < len(cut) else len(text)
    return ("".join(out) + text[at:]).rstrip() if len(spans) else text


def clean_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` less their repeated sentences; texts that lose nothing stay as they are."""
    lost = Stored(marked_removals(docs, min_words).select(F.col("doc_id").alias("_of"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans")), "sentence_removals")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = docs.select(F.struct("*").alias("_row"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_of")) & (F.xxhash64("_row.text") == F.col("_mark"))
    joined = rows.join(maybe_broadcast(lost), same, "left").withColumn("_text", cut("_row.text", "_spans"))
    return joined.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
