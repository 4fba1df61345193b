"""WARC archives: written from a table of pages, read back, and put together as one nested row for each capture.

A capture is three records: request, response (or revisit) and metadata. The response names the request, and the
metadata the response, by WARC-Concurrent-To; the reader joins them by these identifiers. Of captures with equal payloads
of at least LEAST bytes, the one with the smallest page id stores it; the others are revisits that name its record.

Every record is a gzip member of its own (a record above MEMBER bytes is several), so that one record can be read by its
place, and the reader holds one record at a time beside the file. Archives are written by Spark's text writer, so that any file
system that Spark reaches will do: a member of less than 16 MB ends with the byte zero, the highest of its length, and that
byte is the writer's line separator. Pages are written where they are read, without an exchange of payloads as long as the table of
repeated digests is small enough for Spark to broadcast (by its size as stored); beyond that both sides meet by digest, a
payload that a third of all pages share spread over SALTS copies of its row. A file holds what one task reads:
spark.sql.files.maxPartitionBytes of the table, or a row group. The reader goes by Content-Length, so payloads may hold
anything, headers of other records included.

Defined results for odd input: a null html counts as empty, and is a response; null urls have no target header; line
breaks in urls are percent-encoded; rows with a null page id come after all others when the response is chosen; of rows
with the same page id and payload, one (of the smallest url) is the response and the others revisit it; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, staged

#: Bytes of a payload worth a revisit; copies of a digest's row; bytes of a record that one gzip member holds.
LEAST, SALTS, MEMBER = 100, 64, 8 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PARSED = "record_id string, record_type string, concurrent_to string, refers_to_id string, target_uri string, payload_digest string, block_bytes long, computed_digest string, page_id string, payload_bytes long, payload string"


def _urn(kind: str, capture: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), capture))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, bytes, first (is it a response), _capture (a name), and for revisits _original, the
    capture they refer to. Only a response that others refer to has a name that its payload gives; all others are drawn."""
    url = F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    # Repeated digests: the smallest page id, and whether several rows have it. Ids and digests alone are exchanged.
    seen = rows.where(F.col("bytes") >= LEAST).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first"), F.sum("n").alias("n"))
    seen = staged(seen.where("n > 1").select("digest", F.col("first.page_id").alias("_first"), (F.col("first.n") > 1).alias("_tied")), "warc-repeated")
    salted = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "_salt"], "left").drop("_salt")
    known, owner = F.col("_tied").isNotNull(), F.col("page_id").eqNullSafe(F.col("_first"))
    columns = ["page_id", "url", "html", "digest", "bytes"]
    plain = rows.where(~known | ~owner | ~F.col("_tied")).select(*columns, (~known | owner).alias("first"), known.alias("_known"))
    out = [plain]
    if not seen.where("_tied").isEmpty():
        # Rows that are equal but for the url: one is the response, the others need no payload.
        tied = rows.where(known & owner & F.col("_tied")).groupBy("digest", "page_id", "bytes", "url").agg(F.count(F.lit(1)).alias("n"), F.first("html").alias("html"))
        least = tied.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("least")).select("digest", F.col("least.url").alias("_url"))
        tied = tied.join(least, "digest").withColumn("first", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.col("url").eqNullSafe(F.col("_url")) & (i == 1))))
        out.append(tied.select("page_id", "url", F.when(F.col("first"), F.col("html")).otherwise(F.lit("")).alias("html"), "digest", "bytes", "first", F.lit(True).alias("_known")))
    both = out[0] if len(out) == 1 else out[0].union(out[1])
    drawn = both.withColumn("_drawn", F.uuid())
    return drawn.select(*columns, "first", F.when(F.col("_known") & F.col("first"), F.col("digest")).otherwise(F.col("_drawn")).alias("_capture"), F.when(~F.col("first"), F.col("digest")).alias("_original"))


def _record(kind: Column, urn: Column, headers: list[tuple[str, Column]], content: str, block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), urn, F.lit(">")), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # a null value leaves its line out
    lines += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block, F.lit(CRLF * 2))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to gzip members, without their last byte, which is zero."""
    for batch in batches:
        for column in batch.columns:
            at = 0
            while at < len(column):
                out, size = [], 0
                while at < len(column) and size < MEMBER:
                    raw = column[at].as_py()
                    at += 1
                    for i in range(0, len(raw), MEMBER):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.append((pack.compress(raw[i : i + MEMBER]) + pack.flush())[:-1])
                        size += len(out[-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, **columns) -> None:
    """Archives of all pages under path."""
    c = captures(pages, **columns)
    angle = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    request, response, metadata = (_urn(kind, F.col("_capture")) for kind in ("request", "response", "metadata"))
    original = F.when(F.col("_original").isNotNull(), angle(_urn("response", F.col("_original"))))
    target = ("WARC-Target-URI", F.col("url"))
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF * 2}"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    facts = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF)))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    again = F.when(~F.col("first"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    records = (
        _record(F.lit("request"), request, [target], "application/http; msgtype=request", get),
        _record(F.when(F.col("first"), F.lit("response")).otherwise(F.lit("revisit")), response, [target, ("WARC-Concurrent-To", angle(request)), ("WARC-Refers-To", original), ("WARC-Profile", again), digest], "application/http; msgtype=response", F.concat(head, F.when(F.col("first"), F.col("html")).otherwise(F.lit("")))),
        _record(F.lit("metadata"), metadata, [target, ("WARC-Concurrent-To", angle(response))], "application/warc-fields", facts),
    )
    members = c.select(*(r.cast("binary").alias(f"r{i}") for i, r in enumerate(records))).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("encoding", "UTF-8").text(path)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one archive, member by member."""
    whole, at, n, text = memoryview(data), 0, len(data), bytearray()
    while at < n:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at >= n:
                raise ValueError("the archive ends inside a member")
            part = whole[at : at + 65536]
            text += unpack.decompress(part)
            at += len(part) - len(unpack.unused_data)
        while text:
            end = text.find(b"\r\n\r\n")
            if end < 0:
                break
            lines = text[:end].decode("utf-8", "surrogateescape").split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record before byte {at}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            stop = end + 4 + int(headers["content-length"])
            if len(text) < stop + 4:  # goes on in the next member
                break
            yield headers, bytes(memoryview(text)[end + 4 : stop])
            text = text[stop + 4 :]
    if text:
        raise ValueError("the archive ends inside a record")


def _rows(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in PARSED.split(", ")]

    def flushed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for raw in batch.column(0):
            rows, size = [], 0
            for h, block in records_of(raw.as_py()):
                kind, body, page, length, digest = h["warc-type"], None, None, None, None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                    body = payload.decode("utf-8", "surrogatepass") if payloads else None
                    size += length if payloads else 0
                elif kind == "metadata":
                    facts = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
                    page, length = facts.get("page-id"), int(facts["payload-bytes"])
                bare = lambda name: h[name].strip("<>") if name in h else None  # noqa: B023, E731
                rows.append((bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, len(block), digest, page, length, body))
                if len(rows) >= 2000 or size >= MEMBER:
                    yield flushed(rows)
                    rows, size = [], 0
            if rows:
                yield flushed(rows)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record. payloads: also the text of responses."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: _rows(batches, payloads), PARSED)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: structs request, response (a revisit too) and metadata, joined by concurrent-to."""
    of = lambda kinds, name: records.where(F.col("record_type").isin(*kinds)).select(F.struct(*records.columns).alias(name))
    response, request, metadata = of(("response", "revisit"), "response"), of(("request",), "request"), of(("metadata",), "metadata")
    both = response.join(request, F.col("response.concurrent_to") == F.col("request.record_id"), "left")
    return both.join(metadata, F.col("metadata.concurrent_to") == F.col("response.record_id"), "left")


def op7_warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages, reads them back, and gives what was found of each page."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    records = staged(read_warc(spark, path, payloads=False).drop("payload"), "warc-records")  # no payloads: a small table
    kind = pages.schema["page_id"].dataType
    r, m = "response.", "metadata."
    found = staged(
        assemble(records).select(
            F.col(m + "page_id").cast(kind).alias("page_id"),
            F.coalesce(r + "payload_bytes", m + "payload_bytes").alias("payload_bytes"),
            F.coalesce(r + "computed_digest", r + "payload_digest").alias("payload_digest"),
            F.col(r + "record_type").alias("record_type"),
            F.col(r + "refers_to_id").alias("_to"),
            F.col(r + "record_id").alias("_id"),
        ),
        "warc-captures",
    )
    named = found.where(F.col("_to").isNotNull()).select(F.col("_to").alias("_id")).distinct()
    originals = found.where("record_type = 'response'").join(named, "_id", "left_semi")
    originals = originals.select(F.col("_id").alias("_to"), F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    out = found.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(originals, ["_to", "_salt"], "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
