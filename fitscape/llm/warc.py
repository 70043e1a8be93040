"""WARC archives: a request, a response or revisit and a metadata record for each capture; reading them back and joining each capture's records."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitscape.llm.shared import with_match

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: Fixed value: the profile of revisits of an equal payload.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(*parts: Column) -> Column:
    """A URN made from an MD5 of the parts: equal captures have equal ones, whichever task writes them."""
    h = F.md5(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column | str, record_id: Column, date: str, content_type: str, block: Column, **more: Column | str) -> Column:
    """A record's header and block, without the empty lines behind it. Fields of more with a null value are left out."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), text(value).cast("string"), F.lit("\r\n")), F.lit(""))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *((k.replace("_", "-"), v) for k, v in more.items()), ("Content-Type", content_type), ("Content-Length", F.octet_length(block))]
    return F.concat(F.lit("WARC/1.1\r\n"), *[field(k, v) for k, v in fields], F.lit("\r\n"), block)


def planned(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, record_id and, for a revisit, refers_to: the record of the largest id with an equal payload of LEAST_BYTES or more.

    All rows with that largest id are responses; rows with a null id revisit it; without any id all are responses.
    Digests are grouped without their payloads, and a payload that many rows share is found by broadcast.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("record_id", _id(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest")))
    long = rows.filter(F.octet_length("payload") >= LEAST_BYTES)
    groups = long.groupBy(F.col("digest").alias("_key")).agg(F.count("*").alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("first"))
    linked = with_match(rows, F.when(F.octet_length("payload") >= LEAST_BYTES, F.col("digest")), groups.filter("n > 1 and first is not null").select("_key", "first"), "first", F.col("record_id"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return linked.select(*rows.columns, F.when(other, F.col("first.record_id")).alias("refers_to"))


def record_texts(captures: DataFrame, date: str) -> DataFrame:
    """value: the records of planned() captures, three a row, next to each other."""
    # a URI has no white space or control characters; the metadata record keeps the address as it is
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "_")
    host, path = F.regexp_extract(uri, r"://([^/?#]*)", 1), F.regexp_extract(uri, r"://[^/?#]*([^#]*)", 1)
    whole = F.col("refers_to").isNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    response = _record(
        F.when(whole, "response").otherwise("revisit"), F.col("record_id"), date, "application/http; msgtype=response", F.concat(head, F.when(whole, F.col("payload")).otherwise("")), WARC_Target_URI=uri,
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")), WARC_Refers_To=F.col("refers_to"), WARC_Profile=F.when(~whole, _SAME_PAYLOAD),
    )
    asked = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record("request", _id(F.lit("request"), F.col("record_id")), date, "application/http; msgtype=request", F.coalesce(asked, F.lit("")), WARC_Target_URI=uri, WARC_Concurrent_To=F.col("record_id"))
    known = F.to_json(F.struct("page_id", "url"))
    metadata = _record("metadata", _id(F.lit("metadata"), F.col("record_id")), date, "application/json", known, WARC_Target_URI=uri, WARC_Concurrent_To=F.col("record_id"))
    return captures.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(captures: DataFrame, path: str, *, date: datetime | None = None, records_per_file: int = 30_000) -> None:
    """Write planned() captures as gzip archives into a new folder: one file or more for each task, committed by Spark once the task is whole."""
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    # each record ends with two line breaks, which part rows here
    record_texts(captures, when).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_RECORD = "record_id string, record_type string, date string, target_uri string, content_type string, concurrent_to array<string>, refers_to string, payload_digest string, http_head binary, payload binary, payload_bytes long, payload_sha1 string"


def _fields(head: bytes) -> list[tuple[str, str]]:
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()[1:]
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]


class _Reader:
    """Records of archives that come as a stream of bytes; holds one record at a time."""

    def __init__(self):
        self.buffer, self.at, self.head, self.parts, self.missing = b"", 0, None, [], 0

    def feed(self, data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        if self.head is None:
            data = self.buffer + data
        at = 0
        while True:
            if self.head is not None:
                got = data[at : at + self.missing]
                self.parts.append(got)
                self.missing -= len(got)
                at += len(got)
                if self.missing:
                    self.buffer = b""
                    return
                yield self.head, b"".join(self.parts)
                self.head = None
            start = data.find(b"WARC/", at)
            if data[at : start if start >= 0 else len(data)].strip(b"\r\n"):
                raise ValueError(f"no record begins at {data[at : at + 40]!r}")
            end = re.compile(rb"\r?\n\r?\n").search(data, start) if start >= 0 else None
            if end is None:
                self.buffer = data[at:]
                return
            self.head = _fields(data[start : end.start()])
            self.parts, self.missing, at = [], int(dict(self.head)["content-length"]), end.end()

    def close(self) -> None:
        if self.head is not None or self.buffer.strip(b"\r\n"):
            raise ValueError("an archive ends within a record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of gzip archives (as a whole or by record), which Spark doesn't split: each is read by one task, as a stream of lines.

    record_id, record_type, date, target_uri, content_type, concurrent_to (all of them), refers_to, payload_digest (as
    written), http_head (of HTTP records), payload (the block behind it), payload_bytes and payload_sha1 (computed). Missing
    fields are null. A record of any size is one row; archives cut off within a record raise an error; no files give none.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = _Reader(), [], 0
        for batch in batches:
            lines = batch.column("line").to_pylist()
            for head, block in reader.feed(b"\n".join([*lines, b""])):
                f = dict(head)
                cut = re.search(rb"\r?\n\r?\n", block) if f.get("content-type", "").startswith("application/http") else None
                http, payload = (block[: cut.end()], block[cut.end() :]) if cut else (None, block)
                concurrent = [v for k, v in head if k == "warc-concurrent-to"]
                rows.append((
                    f.get("warc-record-id"), f.get("warc-type"), f.get("warc-date"), f.get("warc-target-uri"), f.get("content-type"), concurrent, f.get("warc-refers-to"), f.get("warc-payload-digest"),
                    http, payload, len(payload), hashlib.sha1(payload).hexdigest(),
                ))
                size += len(block)
                if size > 4 << 20 or len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
        reader.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [{"array<string>": pa.list_(pa.string()), "long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in _RECORD.split(", ")]
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(parse, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: response (the response or revisit record), requests and metadata (those concurrent to it, by record id). records: a stored table, as it is read several times.

    A link counts whichever side names the other. Records with one id are one, but for responses: each is a capture.
    A capture without a request or metadata has an empty list; records concurrent to no response are unlinked().
    """
    captures = records.filter("record_type in ('response', 'revisit')")
    others = records.filter("record_type in ('request', 'metadata')")
    named = others.select("record_id", F.explode("concurrent_to").alias("capture"))
    names = captures.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    body = F.struct("record_id", "record_type", "date", "target_uri", "content_type", "payload", "http_head")
    # a record named by both sides meets its capture once
    of = named.unionByName(names).distinct().join(others.select("record_id", body.alias("r")), "record_id").groupBy("capture").agg(F.array_sort(F.collect_set("r")).alias("all"))
    kind = lambda k: F.coalesce(F.filter("all", lambda r: r["record_type"] == k), F.array())
    left = captures.select(F.struct(*captures.columns).alias("response"))
    return left.join(of, F.col("response.record_id") == F.col("capture"), "left").select("response", kind("request").alias("requests"), kind("metadata").alias("metadata"))


def unlinked(records: DataFrame) -> DataFrame:
    """Request and metadata records that are concurrent to no response or revisit record."""
    captures = records.filter("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture"), "concurrent_to")
    others = records.filter("record_type in ('request', 'metadata')")
    named = others.select("record_id", F.explode("concurrent_to").alias("capture")).join(captures.select("capture"), "capture", "left_semi").select("record_id")
    return others.join(named.union(captures.select(F.explode("concurrent_to"))), "record_id", "left_anti")


def revisited(captures: DataFrame) -> DataFrame:
    """Adds original to assemble()'s rows: record_id, metadata, payload_bytes and payload_sha1 of the response that a revisit refers to, null for others. A response that many refer to is found by broadcast."""
    of = F.struct("response.record_id", "metadata", "response.payload_bytes", "response.payload_sha1")
    known = captures.filter("response.record_type = 'response'").select(F.col("response.record_id").alias("_key"), of.alias("original")).dropDuplicates(["_key"])
    return with_match(captures, F.col("response.refers_to"), known, "original", F.col("response.record_id"))
