"""WARC archives that store a payload once.

A payload is addressed by its SHA-256. One record of the largest page_id of a payload is a response and carries it; the
others are revisits of headers only. Response and revisit records go to gzip files of their own; reading parses them,
recomputes each payload's digests, and joins headers to payloads by digest, which gives every original record back.

Files are gzip streams of many records, which the format allows; Spark's writers can't begin a gzip member with each record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# The format's lines.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads a file of responses, on average: payloads are dealt by digest to as many files as that asks for, so a reader holds
#: about as much, compressed. Records a file of revisits, which are a few hundred bytes each, at most.
BYTES_A_FILE, RECORDS_A_FILE = 64 << 20, 100_000
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, sha256 string, header string, payload binary, payload_bytes long"


def base32_sha1(payload: str) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8, from five hexadecimal digits (20 bits, four characters) at a time."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def addressed(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per row of pages: page_id, url, sha256, payload_digest, payload_bytes, record_type, refers_to; no payload. Stored.

    One row of each payload is the response: of those of the largest page_id (null is least) that of the greatest url, of equal ones any;
    all others, equal rows too, are revisits. Payloads of fewer bytes than `least` are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("p")).select(
        "page_id", "url", F.sha2("p", 256).alias("sha256"), base32_sha1("p").alias("payload_digest"), F.octet_length("p").cast("long").alias("payload_bytes")
    )
    # Numbered once and stored, so equal rows can be told apart.
    rows = C.stored(rows.withColumn("_n", F.monotonically_increasing_id()), "warc-rows")
    firsts = rows.groupBy("sha256").agg(F.max(F.struct("page_id", "url", "_n")).alias("first"))
    first = (F.col("_n") == F.col("first._n")) | (F.col("payload_bytes") < least)
    d = rows.join(firsts, "sha256").withColumn("record_type", F.when(first, "response").otherwise("revisit"))
    return C.stored(d.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first.page_id"))).drop("first", "_n"), "warc-heads")


def _text(c: str | Column) -> Column:
    """A header value on one line."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.replace(F.replace(F.replace(c.cast("string"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))


def _named(c: str | Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _text(c), F.lit(">"))


def _header(date: str) -> Column:
    """A record's header lines; `block_bytes` and `http` are columns of their own."""
    revisit = F.when(
        F.col("record_type") == "revisit",
        F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _named("refers_to"), F.lit("\r\n")),
    ).otherwise(F.lit(""))
    uri = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _text("url"), F.lit("\r\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), _named("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\n"), uri, revisit,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nX-Payload-SHA256: "), F.col("sha256"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length("http") + F.col("block_bytes")).cast("string"),
    )


def write(pages: DataFrame, path: str, least: int = 0, date: str | None = None, bytes_a_file: int = BYTES_A_FILE) -> None:
    """Write path/responses and path/revisits, one record a row of pages; each payload of `least` bytes or more once. Null html is the empty payload; null
    ids and urls are kept. date: WARC-Date of the records, the time of writing if not given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = addressed(pages, least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    full = lambda d: F.concat(_header(date), F.lit(END), F.col("http"), d)
    put = lambda df, to: df.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(f"{path}/{to}")
    own = heads.filter("record_type = 'response'")
    total = own.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(math.ceil(total / bytes_a_file), min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (1 << 20))), 1)
    # One of each payload, before and after the shuffle; equal ones meet in the task that writes them.
    payloads = pages.select(F.coalesce("html", F.lit("")).alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    payloads = payloads.groupBy("sha256").agg(F.min("payload").alias("payload")).repartition(files, "sha256")
    own = own.withColumns({"http": http, "block_bytes": F.col("payload_bytes")}).repartition(files, "sha256")
    put(own.join(payloads, "sha256").select(full(F.col("payload")).alias("value")), "responses")
    again = heads.filter("record_type = 'revisit'").withColumns({"http": http, "block_bytes": F.lit(0)})
    put(again.select(full(F.lit("")).alias("value")), "revisits")


def records(content: bytes) -> Iterator[tuple]:
    """The responses, resources and revisits of one gzip file, of one member or many, as RECORDS has them; records of other types are passed over.

    Records of other writers may lack digests and lengths of payloads; those of a response are then found from its payload, those of a revisit
    are null, as are ids and urls that aren't there. A payload that isn't what its header says, and a record that does not end
    where it should, is an error.
    """
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        stream = io.BufferedReader(f, 1 << 16)
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            lines = []
            while line not in (b"\r\n", b"\n", b""):
                lines.append(line)
                line = stream.readline()
            header = b"".join(lines).decode("utf-8", "replace")
            h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header.splitlines()[1:])}
            name, kind, size = h.get("warc-record-id", ""), h.get("warc-type", ""), int(h.get("content-length", 0))
            block = stream.read(size)
            if len(block) < size or stream.read(4) != END.encode():
                raise ValueError(f"a record does not end where it should: {name}")
            if kind not in ("response", "resource", "revisit"):
                continue
            said = h.get("warc-payload-digest", "")
            sha1, sha256, size = (said[5:] if said.lower().startswith("sha1:") else None), h.get("x-payload-sha256"), int(h["x-payload-length"]) if "x-payload-length" in h else None
            payload = None
            if kind != "revisit":
                http = kind == "response" and block.startswith(b"HTTP/")
                payload = block.partition(END.encode())[2] if http else block
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode(), hashlib.sha256(payload).hexdigest(), len(payload)
                if any(x is not None and x != y for x, y in zip((sha1, sha256, size), found, strict=True)):
                    raise ValueError(f"a payload is not what its header says: {name}")
                sha1, sha256, size = found
            url = h.get("warc-target-uri")
            url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if name.startswith("<urn:page:") else url
            yield _page(name), url, "revisit" if kind == "revisit" else "response", _page(h.get("warc-refers-to", "")), sha1, sha256, header, payload, size


def _page(name: str) -> int | None:
    """The page_id in a record's name; None of an empty one and of names that others give."""
    of = name.removeprefix("<urn:page:").removesuffix(">") if name.startswith("<urn:page:") else ""
    return int(of) if of.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Parse and verify the archives of a folder; without `payload` its column is null."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for r in records(content):
                    rows.append(r if payload else (*r[:7], None, r[8]))
                    held += len(r[6]) + len(r[7] or b"") * payload
                    if held > 8 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parse, RECORDS)


def reconstruct(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every original record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, header and, if asked for, payload.

    A revisit gets what its payload's digest points to; one whose payload isn't there has null payload_bytes.
    """
    cols = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "header", *(["payload"] if payload else [])]
    # Parsed once.
    kept = C.stored(read(spark, f"{path}/responses", payload), "warc-responses")
    stores = kept.select("sha256", "payload_digest", "payload_bytes", *(["payload"] if payload else [])).dropDuplicates(["sha256"])
    heads = read(spark, f"{path}/revisits", False).drop("payload", "payload_bytes", "payload_digest")
    return kept.select(*cols).unionByName(heads.join(stores, "sha256", "left").select(*cols))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back: per row of pages page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = C.shared_path(spark, "warc")
    write(pages, path, least)
    return reconstruct(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
