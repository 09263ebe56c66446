"""WARC archives: pages to request, response or revisit, and metadata records, and back to one nested row a capture.

Archives are written by Spark's text writer with the records' own end as line separator, so they reach any file system that
Spark writes to; they are read as binary files, of which a worker unpacks one record at a time. Which pages share a payload is
found on digests alone; pages themselves are never brought together by payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The format's version, the end of a record and the profile of revisits.
VERSION, END, PROFILE = "WARC/1.1", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures have no date of their own; all records carry this one unless another is given.
DATE = "1970-01-01T00:00:00Z"
#: Records and unpacked bytes (by the mean of all pages) of a file at most.
RECORDS_A_FILE, FILE_BYTES = 30_000, 64 << 20
#: Bytes of a page's three records beside its payload, about.
HEADS = 1500
#: Payloads with copies of which the digests are broadcast (100 bytes each at most); beyond that pages are joined by their own ids.
MOST_BROADCAST = 200_000
#: Parts into which the revisits of one response are dealt.
SALTS = 16

RECORD = "record_id string, concurrent_to string, kind string, uri string, refers_to string, payload_bytes long, payload_digest string, fields map<string,string>"


def _urn(*parts: Column) -> Column:
    """A record id made from a name."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _record(kind: Column, rid: Column, headers: list[Column], content: str, block: Column) -> Column:
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), *headers, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)  # concat_ws leaves null headers out


def revisiting(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """rows with `first`: the largest page id of their payload where several rows share it, else null."""
    groups = common.save(keys.groupBy("sha").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"))
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), "sha", "left")
    # page ids with digests are all different, but for rows that repeat; rows to be responses find nothing
    own = F.coalesce("page", F.lit(NO_PAGE)).alias("own")
    marks = keys.join(groups, "sha").select("sha", own, "first").filter("own <> first").distinct()
    return rows.withColumn("own", own).join(marks, ["own", "sha"], "left").drop("own")


NO_PAGE = -(1 << 63)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, most_broadcast: int = MOST_BROADCAST) -> None:
    """Three records a row: request, response (or revisit) and metadata; the latter two name the first as concurrent.

    Of rows with equal payloads the one with the largest id is the response and the others revisit it; rows that share that id
    are all responses. A null id is below all others, and its metadata has no page-id; null html is an empty payload; a null
    url leaves the target out, and control characters and spaces in it are escaped. An empty table gives empty archives.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keys = common.save(rows.select("page", "sha", F.octet_length("html").alias("size")))
    total, n = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    per_file = max(3, min(RECORDS_A_FILE, 3 * FILE_BYTES * n // (total + HEADS * n))) if n else RECORDS_A_FILE
    rows = revisiting(rows, keys, most_broadcast)
    again = F.coalesce(F.col("first") != F.coalesce(F.col("page"), F.lit(NO_PAGE)), F.lit(False))
    # base32 of the digest: eight times 20 bits, each four letters
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    fives = [F.shiftright(F.conv(F.substring(F.col("sha"), 1 + 5 * k, 5), 16, 10).cast("int"), bits).bitwiseAND(31) for k in range(8) for bits in (15, 10, 5, 0)]
    digest = F.concat(*(F.substring(alphabet, x + 1, F.lit(1)) for x in fives))
    rows = rows.withColumns({"again": again, "digest": digest, "request": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "response": _urn(F.lit("response"), F.col("page"), F.col("sha")), "meta": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))})
    uri, on = F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.lit(f"WARC-Date: {date}")
    with_request = F.concat(F.lit("WARC-Concurrent-To: "), F.col("request"))
    host, way = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(F.coalesce(way, F.lit("")).startswith("/"), way).otherwise(F.concat(F.lit("/"), F.coalesce(way, F.lit("")))), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    answer = [with_request, uri, on, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(F.col("again"), F.lit(f"WARC-Profile: {PROFILE}")), F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), _urn(F.lit("response"), F.col("first"), F.col("sha"))))]
    own = F.when(F.col("again"), _urn(F.lit("revisit"), F.col("request"))).otherwise(F.col("response"))
    records = F.array(
        _record(F.lit("request"), F.col("request"), [uri, on], "application/http;msgtype=request", asked),
        _record(F.when(F.col("again"), "revisit").otherwise("response"), own, answer, "application/http;msgtype=response", F.concat(head, F.when(F.col("again"), "").otherwise(F.col("html")))),
        _record(F.lit("metadata"), F.col("meta"), [with_request, uri, on], "application/warc-fields", F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit(""))),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def fields_of(lines: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.split("\r\n")) if k}


def parse(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, one at a time."""
    f, at = io.BytesIO(source) if isinstance(source, bytes) else source, 0
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        lines, size = [], len(line)
        while (line := f.readline()) not in (b"\r\n", b""):
            lines.append(line)
            size += len(line)
        head = fields_of(b"".join(lines).decode().removesuffix("\r\n"))
        length = int(head["content-length"])
        block = f.read(length)
        if len(block) < length or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield head, block
        at += size + 2 + length + 4


def unpacked(raw: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 20) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def described(head: dict[str, str], block: bytes) -> dict:
    """One record as a row; a response's length and digest are those of its bytes, which must be what its header tells."""
    kind, told = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out = {"record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "kind": kind, "uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload_bytes": None, "payload_digest": told, "fields": {}}
    if kind == "metadata":
        out["fields"] = fields_of(block.decode())
    elif kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out["fields"] = fields_of(http.decode().partition("\r\n")[2])
        if kind == "response":
            out["payload_bytes"], out["payload_digest"] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if told not in (None, out["payload_digest"]):
                raise ValueError(f"the payload of {out['record_id']} is not what its digest tells")
        elif "content-length" in out["fields"]:
            out["payload_bytes"] = int(out["fields"]["content-length"])
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]

    def table(part: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "fields" else r[n] for r in part], k) for n, k in zip(names, kinds, strict=True)], names=names)

    common.release()
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for record in parse(unpacked(content.as_buffer().to_pybytes())):
                rows.append(described(*record))
                if len(rows) == 5000:
                    yield table(rows)
                    rows = []
            yield table(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path."""
    common.tune(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its request, its response or revisit, and its metadata records.

    Records of a capture name one of them as concurrent, which itself names none. Parts that are missing are null (metadata:
    an empty list); a record that stands alone is a capture of its own.
    """
    part = F.struct("record_id", "kind", "uri", "refers_to", "payload_bytes", "payload_digest", "fields")
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture"), F.col("kind").alias("k"), part.alias("part"))
    return keyed.groupBy("capture").agg(
        F.first(F.when(F.col("k") == "request", F.col("part")), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("k").isin("response", "revisit"), F.col("part")), ignorenulls=True).alias("response"),
        F.collect_list(F.when(F.col("k") == "metadata", F.col("part"))).alias("metadata"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = common.save(assemble(read_archives(spark, path)))
    rows = captures.select(F.get("metadata", F.lit(0))["fields"]["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.record_id").alias("own"), F.col("response.refers_to").alias("to"))
    again = rows.filter("to is not null")
    wanted = again.select("to").distinct()
    firsts = rows.filter("record_type = 'response'").select(F.col("own").alias("to"), "page_id").join(wanted, "to", "left_semi").groupBy("to").agg(F.max("page_id").alias("refers_to"))
    # very many pages may revisit one response: each of them looks for it in one of SALTS places
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = again.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(firsts, ["to", "salt"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return rows.filter("to is null").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(*names, "refers_to"))
