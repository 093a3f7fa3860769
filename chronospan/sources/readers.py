"""Readers with explicit schemas and integrity guards, and the sinks that go with them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from chronospan.functions.rules import duplicates, require_empty
from chronospan.functions.scalars import redacted, source_name

FRAMES = "frame INT, time_s DOUBLE, state STRING, state_confidence DOUBLE, actions ARRAY<STRUCT<class: STRING, confidence: DOUBLE, xyxy: ARRAY<DOUBLE>>>, players ARRAY<STRUCT<xyxy: ARRAY<DOUBLE>, confidence: DOUBLE>>"
BALL = "Frame INT, Visibility INT, X DOUBLE, Y DOUBLE, Radius INT"
#: File endings of media.
MEDIA = ("mp4", "mov", "mkv", "avi", "m4v", "webm", "mts", "m2ts")


def frames(spark: SparkSession, path: str, schema: str = FRAMES) -> DataFrame:
    """JSON lines of per-frame records; a record that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ball(spark: SparkSession, path: str, schema: str = BALL) -> DataFrame:
    """Header CSV of ball rows, checked against the schema's names."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def aligned(detections: DataFrame, balls: DataFrame, pts: DataFrame, skew: float = 0.002) -> DataFrame:
    """Detections, ball rows and clock by frame; a missing frame on any side, or a clock off by more than ``skew``, is an error."""
    b = balls.withColumnRenamed("Frame", "frame")
    met = detections.join(b, "frame", "full_outer").join(pts, "frame", "full_outer")
    bad = F.col("time_s").isNull() | F.col("Visibility").isNull() | F.col("pts").isNull() | (F.abs(F.col("time_s") - F.col("pts")) > skew)
    ok = F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("frame out of line: "), F.col("frame").cast("string"))).cast("boolean"))
    return met.where(ok)


def discovered(spark: SparkSession, directory: str) -> DataFrame:
    """(path, date, part) of media files below a folder by name.

    Names that don't fit, two files of one date and part, and a folder without
    media are errors. Only names are read: file contents are left alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    stem = F.regexp_extract("path", rf"([^/]+)\.(?i:{'|'.join(MEDIA)})$", 1)
    media = files.where(stem != "").select("path", source_name(stem).alias("s"))
    require_empty(media.where("s is null").select("path"), "media files need names of year, month, day and part")
    found = media.select("path", "s.date", "s.part")
    require_empty(duplicates(found, ["date", "part"]), "two files of one date and part")
    if found.isEmpty():
        raise ValueError(f"no media below {directory}")
    return found.orderBy("date", "part")


def digests(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: What an entry of an archive's directory says; ``problem`` is set for an archive that can't be read, which has no other values.
ENTRIES = "path string, name string, is_dir boolean, bytes long, packed_bytes long, crc32 long, method int, offset long, encrypted boolean, problem string"


def archive_entries(spark: SparkSession, directory: str) -> DataFrame:
    """The central directories of the ZIP archives of a folder, a row an entry; nothing is unpacked.

    An archive is one row of one task. One without a directory, or with names that lead out of its folder, is told by ``problem``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(directory).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                        for e in z.infolist():
                            out = e.filename.startswith(("/", "\\")) or ".." in e.filename.replace("\\", "/").split("/")
                            rows.append((path, e.filename, e.is_dir(), e.file_size, e.compress_size, e.CRC, e.compress_type, e.header_offset, bool(e.flag_bits & 1), "name leads out" if out else None))
                except (zipfile.BadZipFile, NotImplementedError, ValueError) as wrong:
                    rows = [(path, *[None] * 8, str(wrong))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = to_arrow_schema(spark.createDataFrame([], ENTRIES).schema)
    return files.mapInArrow(run, ENTRIES)


def verified_cache(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest rows (sha256, bytes, ...) whose file is there unchanged; the rest is to be computed anew."""
    return manifest.join(actual.select("sha256", "bytes"), ["sha256", "bytes"], "left_semi")


def listing(files: DataFrame, offset: int, page: int = 200) -> DataFrame:
    """A page of (name, is_dir): folders first, then by name without case."""
    return files.orderBy(F.desc("is_dir"), F.lower("name"), "name").offset(offset).limit(page)


def strict_json(text: str) -> object:
    """One JSON value without repeated keys, NaN or infinities (Spark's own parser takes all three)."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key is given twice")
        return out

    def refuse(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def fenced_json(text: str) -> object:
    """As :func:`strict_json`, with at most one fence round the whole text."""
    body = text.strip()
    if body.startswith("```"):
        first, _, rest = body.partition("\n")
        if first.strip("`").strip().lower() not in ("", "json") or not rest.rstrip().endswith("```"):
            raise ValueError("the fence does not hold the whole text")
        body = rest.rstrip()[:-3]
    return strict_json(body)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON document each (objects, or arrays of objects as rows); what doesn't fit the schema and NaN fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key a table has not yet: a ledger that a repeated call leaves as it is. Null keys are always new."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = df.dropDuplicates(key)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)


def dead_letters(rejected: DataFrame, texts: list[str]) -> DataFrame:
    """Rejected rows with secrets in their ``texts`` masked, ready to be appended to a table of failures."""
    return rejected.withColumns({c: redacted(F.col(c)) for c in texts})


def write_json(df: DataFrame, path: str) -> None:
    """Write JSON lines by Spark's commit protocol; NaN and infinities fail the write."""
    checked = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
            checked = checked.withColumn(name, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(F.col(name)))
    checked.write.mode("overwrite").json(path)


def write_frames(df: DataFrame, path: str) -> None:
    """Frames as the three tables that :func:`frames`, :func:`ball` and :func:`aligned` read: ``detections`` (JSON lines), ``ball`` (CSV) and ``pts`` (text).

    ``df`` has the columns of ``FRAMES`` and ``BALL`` and a clock ``pts``. A frame that is given twice, or has no clock, fails the write.
    Each table is replaced by Spark's commit protocol; a line of ``pts`` is the frame and its clock.
    """
    names = lambda schema: [f.split()[0] for f in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", schema).split(", ")]
    require_empty(duplicates(df, ["frame"]), "frames given twice")
    require_empty(df.where("frame is null or pts is null").select("frame", "pts"), "frames without a clock")
    write_json(df.select(*names(FRAMES)), f"{path}/detections")
    df.withColumn("Frame", F.col("frame")).select(*names(BALL)).write.mode("overwrite").option("header", True).csv(f"{path}/ball")
    df.select(F.concat_ws(" ", "frame", F.col("pts").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/pts")


def clocks(spark: SparkSession, path: str) -> DataFrame:
    """(frame, pts) of the lines of a clock table; a line that isn't two numbers fails the read."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].cast("int").alias("frame"), parts[1].cast("double").alias("pts"))


def write_buckets(df: DataFrame, path: str, t: str, width: float) -> None:
    """Parquet in folders of ``width`` seconds, so that a reader of a range opens only its buckets."""
    df.withColumn("bucket", F.floor(F.col(t) / width).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, t: str, width: float, start: float, end: float) -> DataFrame:
    """Rows with start <= t < end: the bucket range prunes folders, the time itself filters rows."""
    lo, hi = int(start // width), int(-(-end // width))
    return spark.read.parquet(path).where((F.col("bucket") >= lo) & (F.col("bucket") < hi) & (F.col(t) >= start) & (F.col(t) < end)).drop("bucket")


def write_once(df: DataFrame, path: str) -> None:
    """Exclusive create: an existing target is an error."""
    df.write.mode("errorifexists").parquet(path)
