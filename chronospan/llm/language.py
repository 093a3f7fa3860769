"""Language identification by word-first backoff (operator 3).

A known word scores by its log frequency in each language. A word never seen
backs off to character n-grams of itself between word ends, ``^`` and ``$``:
the longest order at which any of its n-grams is known decides, by the mean of
their log frequencies. A text's words add up, and the score is the share of
the best language among all, by softmax.

The model is fitted on a bounded sample: about ``per_lang`` labelled documents
a language, drawn by a hash of their id, with the ``top_words`` and
``top_grams`` most frequent words and n-grams (of each order) a language, so
its size doesn't grow with the corpus. Every text is read whole.

Defined results: null text or text without a letter is ``und`` with score 0;
equal texts get equal results; ties between languages go to the first by name;
without any labelled text everything is ``und``; empty input gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LANG = 1500
TOP_WORDS = 10_000
TOP_GRAMS = 4_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Unseen words whose backoff scores a Python worker remembers before it starts anew.
REMEMBERED = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_lang: int = PER_LANG, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> dict:
    """The model from rows (doc_id, text, lang): languages, words, n-grams and their log frequencies."""
    known = labelled.where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "index": {}, "grams": {}, "logs": np.zeros((0, 0), np.float32)}
    draw = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    sample = known.where(unit < draw[F.col("lang")]).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    counts = sample.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ends = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    units = [F.struct(F.lit(0).alias("k"), F.array("word").alias("g"))]
    for k in ORDERS:
        units.append(F.struct(F.lit(k).alias("k"), _grams(ends, k).alias("g")))
    grams = (
        counts.select("lang", "n", F.explode(F.array(*units)).alias("u"))
        .select("lang", "n", "u.k", F.explode("u.g").alias("gram"))
        .groupBy("lang", "k", "gram")
        .agg(F.sum("n").alias("n"))
        .where("k = 0 or length(gram) = k")
    )
    by = Window.partitionBy("lang", "k")
    ranked = grams.withColumn("total", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "gram")))
    rows = ranked.where(F.when(F.col("k") == 0, F.col("r") <= top_words).otherwise(F.col("r") <= top_grams)).select("lang", "k", "gram", "n", "total").collect()
    at = {lang: i for i, lang in enumerate(langs)}
    keys = sorted({(r.k, r.gram) for r in rows})
    place = {key: i for i, key in enumerate(keys)}
    seen = np.zeros((len(keys), len(langs)))
    totals = np.ones((len(ORDERS) + 1, len(langs)))
    for r in rows:
        seen[place[r.k, r.gram], at[r.lang]] = r.n
        totals[r.k, at[r.lang]] = r.total
    order = np.array([k for k, _ in keys], int)
    logs = np.log((seen + 0.5) / (totals[order] + 0.5 * len(keys))).astype(np.float32)
    return {
        "langs": langs,
        "index": {g: i for (k, g), i in place.items() if k == 0},
        "grams": {g: i for (k, g), i in place.items() if k},
        "logs": logs,
    }


def _grams(text: Column, k: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))


class _Words(dict):
    """Row of a word in a growing table of scores: fixed for known words, worked out once for others."""

    def __init__(self, model: dict):
        super().__init__(model["index"])
        self.grams, self.known = model["grams"], len(model["logs"])
        self.table = np.concatenate([model["logs"], np.zeros((1024, len(model["langs"])), np.float32)])
        self.fixed, self.used = model["index"], self.known

    def __missing__(self, word: str) -> int:
        full = f"^{word}$"
        rows: list[int] = []
        for k in ORDERS:
            rows = [r for r in (self.grams.get(full[i : i + k]) for i in range(len(full) - k + 1)) if r is not None]
            if rows:
                break
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.table[rows].mean(axis=0) if rows else 0
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def trim(self) -> None:
        """Between texts only: rows in use would lose their meaning."""
        if self.used - self.known > REMEMBERED:
            self.clear()
            self.update(self.fixed)
            self.used = self.known


_LOADED: dict[int, _Words] = {}


def scorer(shared: Broadcast) -> _Words:
    """One a Python worker and model, kept between tasks."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Words(shared.value)
    return _LOADED[key]


def classify(text: str | None, words: _Words, langs: list[str]) -> tuple[str, float]:
    found = _LETTERS.findall(text.lower()) if text else []
    if not found or not langs or not any(any(map(str.isalpha, w)) for w in found):
        return UNKNOWN, 0.0
    rows = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    total = words.table[rows].sum(axis=0, dtype=np.float64)
    words.trim()
    best = int(total.argmax())
    share = 1 / np.exp(np.maximum(total - total[best], -700)).sum()
    return langs[best], float(min(1.0, max(0.0, share))) if math.isfinite(share) else 0.0


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score added; any columns of those names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs = scorer(shared), shared.value["langs"]
        for batch in batches:
            found = [classify(t, words, langs) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    from pyspark.sql.types import DoubleType, StringType, StructType

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for all documents, learnt from those not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
