"""WARC archives: writing captures with revisit records, reading them back, assembling transactions.

``write`` makes a request, a response (or revisit) and a metadata record of each capture and lets Spark's text writer lay them
out: a record's end mark, CR LF CR LF, is the line separator, files are gzipped and hold a bounded number of captures and bytes: captures
are written by classes of size, so that a file has some 64 MB before compression, or one capture where that is larger. Of
captures with equal payloads the one with the least key is the response; the others become revisit records, without payload, that
refer to it. ``read`` walks each file by Content-Length, whatever bytes a payload holds. ``transactions`` joins request and
metadata records to their response or revisit record through WARC-Concurrent-To and gives one nested row for each capture.

Defined results: a null payload counts as empty, and equal (also empty) payloads are revisited like others; repeated rows are
captures of their own, and where two have the least key the second revisits the first; a null key is greater than all others
and comes back as null; line breaks in a URL become spaces, a null URL has no target; an empty
table gives no rows; a very long payload is a file of its own. Only key, url and payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path

CRLF = "\r\n"
END = CRLF * 2
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, digest string, payload_bytes long, fields map<string,string>, payload binary"
MOST_BROADCAST = 2_000_000
#: Classes of payload sizes (from, below) and how many captures of each a file may hold.
SIZES = ((0, 1 << 16, 1000), (1 << 16, 1 << 20, 64), (1 << 20, 1 << 31, 1))


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: each 5 hex digits are 4 digits to base 32."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: str, record_id: Column, block: Column, headers: list[tuple[str, Column]]) -> Column:
    """A record's bytes without its end mark; headers whose value is null are left out."""
    lines = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    said = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines]
    return F.concat(F.concat(F.lit(VERSION + CRLF), *said, F.lit(CRLF)).cast("binary"), block)


def write(captures: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the captures' archives as gzipped files to the folder ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), F.col(key).alias("sort_key"), F.regexp_replace(F.col(url).cast("string"), r"[\r\n]+", " ").alias("url"), body.alias("body"), F.octet_length(body).alias("size"))
    rows = saved(rows.withColumn("digest", base32_sha1(F.col("body"))), "captures")
    group = rows.groupBy("digest").agg(F.min(F.struct(F.col("sort_key").isNull().alias("none"), "sort_key", "row")).getField("row").alias("first"), F.count("*").alias("n"))
    again = saved(rows.select("row", "digest").join(group.where("n > 1").select("digest", "first"), "digest").where("row <> first").select("row", "first"), "revisits")
    if again.count() <= MOST_BROADCAST:
        again = F.broadcast(again)
    rows = rows.join(again, "row", "left")
    name = F.lit(path)
    revisit = F.col("first").isNotNull()
    main_id, text = urn(name, F.lit("main"), F.col("row")), lambda s: s.cast("binary")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    head = text(F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(END)))
    http, digest = ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    again_of = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", urn(name, F.lit("main"), F.col("first")))]
    main = F.when(revisit, record("revisit", main_id, head, [*common, digest, *again_of, http])).otherwise(record("response", main_id, F.concat(head, F.col("body")), [*common, digest, http]))
    asked = text(F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    request = record("request", urn(name, F.lit("request"), F.col("row")), asked, [*common, ("WARC-Concurrent-To", main_id), ("Content-Type", F.lit("application/http; msgtype=request"))])
    said = text(F.concat(F.coalesce(F.concat(F.lit("key: "), F.col("key"), F.lit(CRLF)), F.lit("")), F.lit("payload-bytes: "), F.octet_length("body").cast("string"), F.lit(CRLF)))
    metadata = record("metadata", urn(name, F.lit("metadata"), F.col("row")), said, [*common, ("WARC-Concurrent-To", main_id), ("Content-Type", F.lit("application/warc-fields"))])
    end = F.lit(END).cast("binary")
    whole = F.concat(request, end, main, end, metadata).cast("string")  # the bytes stay as they are
    largest = rows.agg(F.max("size")).first()[0] or 0
    rows = rows.select("size", whole.alias("value"))
    for low, high, per_file in (x for x in SIZES if x[0] <= largest):
        some = rows.where((F.col("size") >= low) & (F.col("size") < high)).select("value")
        some.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(f"{path}/from-{low}")


def parse(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive, plain or gzipped (in one member or many)."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        start = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : start - 4].decode("utf-8", "replace").split(CRLF)[1:]
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[start : start + int(heads["content-length"])]
        at = start + len(block)
        kind, fields, payload = heads.get("warc-type", ""), {}, b""
        if kind == "metadata":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if k.strip()}
        elif kind in ("response", "revisit", "request"):
            payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else heads.get("warc-payload-digest", "").removeprefix("sha1:")
        yield (heads.get("warc-record-id"), kind, heads.get("warc-concurrent-to"), heads.get("warc-refers-to"), heads.get("warc-target-uri"), heads.get("warc-date"), digest or None, len(payload), fields, payload if with_payload else None)


def read(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``; a response's digest is of the bytes read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            for data in b["content"]:
                yield pd.DataFrame(list(parse(bytes(data), with_payload)), columns=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, FIELDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture, requests, metadata; revisits also have the metadata of what they refer to."""
    side = lambda kind, name: records.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("id")).agg(F.collect_list(F.struct("record_id", "target_uri", "date", "fields")).alias(name))
    main = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("id"), F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")]).alias("capture"))
    return main.join(side("request", "requests"), "id", "left").join(side("metadata", "metadata"), "id", "left")


def round_trip(captures: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None) -> DataFrame:
    """Write the captures, read the archives back, and describe each capture by what they hold."""
    spark = captures.sparkSession
    path = path or scratch_path(spark, "warc")
    write(captures, path, key=key, url=url, payload=payload)
    records = saved(read(spark, path, with_payload=False), "records")
    field = lambda name: F.get(F.col("metadata"), F.lit(0)).getField("fields").getItem(name)
    whole = transactions(records).select("id", "capture", field("key").cast(captures.schema[key].dataType).alias(key), field("payload-bytes").cast("long").alias("payload_bytes"))
    whole = saved(whole.select("id", key, "payload_bytes", "capture.digest", "capture.record_type", "capture.refers_to"), "transactions")
    targets = whole.where("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col(key).alias("target"))
    return whole.join(targets, "refers_to", "left").select(key, "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("target").alias("refers_to"))
