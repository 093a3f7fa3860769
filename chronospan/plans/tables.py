"""The driver's tables in the shapes the operators take: whole tables, times as LONG microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.functions.scalars import micros
from chronospan.operators import islands as I

HOUR = 3_600_000_000
DAY = 24 * HOUR
WEEK = 7 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, us, k: the observations; user is the source, type the label."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def placed(events: DataFrame) -> DataFrame:
    """Events with ``pos``, the place from 1 among their user's by time and id, ranked a week at a time."""
    return I.ranked(events, ["user_id"], F.floor(F.col("us") / WEEK), ["us", "event_id"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of users: (event_id, user_id, event_type, value, start, end) of value minutes at least one, from purchases and errors."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    return e.select("event_id", "user_id", "event_type", "value", F.col("us").alias("start"), (F.col("us") + HOUR + F.col("k") * 60_000_000).alias("end"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, truth, score: labels with a score in [0, 1] from the text's length, with ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    y = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    return y.join(d, "doc_id").select("doc_id", "lang", "truth", (F.least(F.floor(F.col("n_chars") / 50), F.lit(100)) / 100.0).alias("score"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, rater, kind, grade (0-4): events as ratings of an hour by raters."""
    e = events(spark, sf_dir)
    grade = F.least(F.floor(F.col("value") / 10), F.lit(4)).cast("int")
    return e.select(F.floor(F.col("us") / HOUR).cast("long").alias("unit"), (F.col("user_id") % 3).cast("int").alias("rater"), F.col("event_type").alias("kind"), "event_id", F.when(F.col("k") % 10 != 0, grade).alias("grade"))
