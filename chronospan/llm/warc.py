"""Monolithic gzip WARC archives and their normaliser (operator 4).

``write_monolithic`` writes records as whole-file gzip streams with Spark's own
text writer. ``normalise`` opens each such stream once, inflates it chunk by
chunk, rewrites every record as a gzip member of its own and writes a sidecar
index of the members' offsets, so that one record can be read without the
rest. ``read_records`` reads records back by that index.

A task writes to a name of its own and renames at the end, so a retried or
speculative task replaces a whole file by an equal one. Files are opened with
``pyarrow.fs`` from the archive folder's URI. Memory is bounded by the largest
record, not by the archive.

Defined results: null html is an empty payload; repeated rows give a record
each; empty input gives no archive and no record; other columns are ignored,
whatever their names. Of records with equal payloads of at least
``min_bytes`` bytes, the one with the largest page_id is the response and the
others revisit it (of rows with that same page_id, each is a response).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, maybe_broadcast, scratch_path, _hadoop

END = b"\r\n\r\n"
CHUNK = 1 << 20
INDEX = "archive string, ordinal long, offset long, bytes long, record_id string, record_type string"


def linked_by(html: Column, min_bytes: int) -> Column:
    """Digest of a payload that may be revisited; null if it is too short."""
    payload = F.coalesce(html, F.lit(""))
    return F.when(F.octet_length(payload) >= min_bytes, F.sha2(payload, 256))


def safe_url(url: Column) -> Column:
    """The URL with control characters and blanks percent-encoded."""
    code = lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))
    each = F.transform(F.split(url, ""), lambda c: F.when((c != "") & ((F.ascii(c) <= 32) | (F.ascii(c) == 127)), code(c)).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(each, "")).otherwise(F.coalesce(url, F.lit("about:blank")))


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Rows (page_id, digest, refers_to) for every record that repeats a later page's payload.

    Payloads meet by digest and length; sums are combined map-side, and only
    digests of two or more pages are joined back.
    """
    keys = pages.select("page_id", linked_by(F.col("html"), min_bytes).alias("digest")).where("digest is not null")
    keyed = Stored(keys, "payload_keys")
    groups = keyed.df.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = Stored(groups.where("n > 1").select("digest", "refers_to"), "payload_groups")
    return keyed.df.join(maybe_broadcast(repeated), "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()


def record_text(page_id: Column, url: Column, html: Column, refers_to: Column) -> Column:
    """A WARC record without its closing blank lines, as text."""
    payload = F.coalesce(html, F.lit(""))
    digest = F.sha1(payload)
    body = F.when(refers_to.isNull(), payload).otherwise(F.lit(""))
    uid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), uid(page_id),
        F.lit("\r\nWARC-Target-URI: "), safe_url(url),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nX-Payload-Bytes: "), F.octet_length(payload).cast("string"),
        F.when(refers_to.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uid(refers_to))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body,
    )


def write_monolithic(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write all pages below ``path``: one gzip stream a partition, records in it not addressable."""
    links = Stored(revisits(pages, min_bytes), "revisits")
    rows = pages.select("page_id", "url", "html", linked_by(F.col("html"), min_bytes).alias("digest")).join(maybe_broadcast(links), ["page_id", "digest"], "left")
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"), F.col("refers_to"))
    rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records (headers and body, without the closing blank lines) of an inflated archive."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        start = 0
        while (head := buffer.find(END, start)) >= 0:
            length = content_length(bytes(buffer[start:head]))
            stop = head + len(END) + length
            if len(buffer) < stop + len(END):
                break
            if buffer[stop : stop + len(END)] != END:
                raise ValueError("a record does not end where its length says")
            yield bytes(buffer[start:stop])
            start = stop + len(END)
        del buffer[:start]
    if buffer:
        raise ValueError("the archive ends within a record")


def content_length(head: bytes) -> int:
    return int(headers(head)["content-length"])


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}


def inflate(stream) -> Iterator[bytes]:
    """Inflated chunks of a gzip stream of one or more members."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield z.decompress(data, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            data = z.unused_data
            if z.eof and data:
                z = zlib.decompressobj(31)
    yield z.flush()
    if not z.eof:
        raise ValueError("the gzip stream is cut off")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def normalise_one(source: str, target: str, level: int) -> list[tuple]:
    """Rewrite one archive; the index rows, also written beside it as ``<target>.idx`` (JSON lines)."""
    fs, src = _open(source)
    fs2, dst = _open(target)
    part = f"{dst}.{uuid.uuid4().hex}.tmp"
    rows, at = [], 0
    with fs.open_input_stream(src, compression=None) as stream, fs2.open_output_stream(part, compression=None) as out:
        for n, record in enumerate(split_records(inflate(stream))):
            head = headers(record[: record.index(END)])
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(record + END) + z.flush()
            out.write(member)
            rows.append((target, n, at, len(member), head["warc-record-id"], head["warc-type"]))
            at += len(member)
    with fs2.open_output_stream(f"{part}.idx", compression=None) as out:
        for r in rows:
            out.write(json.dumps(dict(zip(("archive", "ordinal", "offset", "bytes", "record_id", "record_type"), r, strict=True))).encode() + b"\n")
    fs2.move(part, dst)
    fs2.move(f"{part}.idx", f"{dst}.idx")
    return rows


def _archives(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().toUri().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".gz"))


def normalise(spark: SparkSession, source: str, target: str, level: int = 4) -> DataFrame:
    """Normalise every archive of folder ``source`` into folder ``target``; the index as a DataFrame.

    One task an archive. The index is stored as Parquet in the shared folder too.
    """
    names = _archives(spark, source)
    fs, p = _hadoop(spark, target)
    fs.mkdirs(p)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = normalise_one(name, f"{uri}/{name.rpartition('/')[2].split('.')[0]}.warc.gz", level)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["archive", "ordinal", "offset", "bytes", "record_id", "record_type"])

    jobs = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return Stored(jobs.mapInArrow(run, INDEX), "warc_index").df


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    record = zlib.decompress(member, 31)
    cut = record.index(END)
    return headers(record[:cut]), record[cut + len(END) : -len(END)]


def read_records(index: DataFrame) -> DataFrame:
    """Rows (page_id, record_type, refers_to, payload_bytes, payload_digest, payload) read from normalised archives.

    Index rows are sorted by place within tasks, so each task reads forward. A
    response's payload is checked against its digest; a revisit has none here.
    """
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def number(urn: str) -> int | None:
        value = urn[len("<urn:page:") : -1]
        return None if value == "null" else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            out = []
            for archive, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if stream:
                        stream.close()
                    fs, at = _open(archive)
                    name, stream = archive, fs.open_input_file(at)
                stream.seek(offset)
                head, body = _parse(stream.read(size))
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{head['warc-record-id']}: the payload does not match its digest")
                to = number(head["warc-refers-to"]) if kind == "revisit" else None
                out.append((number(head["warc-record-id"]), kind, to, int(head["x-payload-bytes"]), digest, body if kind == "response" else None))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if stream:
            stream.close()

    return index.select("archive", "offset", "bytes").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and read every record back by the index.

    The monolithic archives are deleted at once; the normalised ones stay in the
    shared folder, as the rows are read from them whenever the result is used.
    """
    spark = pages.sparkSession
    whole, single = scratch_path(spark, "warc_whole"), scratch_path(spark, "warc")
    write_monolithic(pages, whole, min_bytes)
    index = normalise(spark, whole, single)
    fs, p = _hadoop(spark, whole)
    fs.delete(p, True)
    return read_records(index)
