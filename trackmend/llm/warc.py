"""WARC archives: writing, reading, and assembly of transactions.

A capture is three records: the request, the response (or the revisit of an equal payload that is stored elsewhere) and
the metadata.  Request and metadata name the second one in ``WARC-Concurrent-To``.  Archives are written by Spark's
text writer, whose line separator is the empty lines that end a WARC record, so that its commit protocol covers them
and any store that Spark reaches can hold them; each file is compressed as a whole.  They are read as binary files and
parsed by ``Content-Length`` while they are decompressed, a record at a time.  ``assemble`` joins the records of a
capture through their identifiers into one nested row.

Which response a revisit refers to is found among (key, digest) pairs; payloads move once, to their key's partition.

A null payload is empty; a null address is written as ``urn:page:<key>``.  Rows repeated under one key are captures of
their own, whose identifiers differ by a number.  Null keys are written as an empty field, read as null, and never revisit.  An empty
table writes and gives nothing.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, kind string, concurrent_to string, refers_to string, uri string, date string, payload_bytes long, payload_digest string, page_key string, payload binary"


def _identifier(kind: str, key: Column, digest: Column, number: Column) -> Column:
    """Of the rows with one key and payload, ``number`` tells them apart."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), F.coalesce(key.cast("string"), F.lit("")), F.hex(digest), number.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))  # no line for null
    return F.concat(*lines, F.lit("\r\n"), block)


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value, payload_bytes): the text of each record.  Of equal payloads of ``least`` bytes or more, the largest key has
    the response."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("body"))
    digest = F.unhex(F.sha2("body", 256))
    long = rows.where(F.octet_length("body") >= least).select("key", digest.alias("digest"))
    last = long.groupBy("digest").agg(F.max("key").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    moved = long.distinct().join(last, "digest").where("key <> target")
    moved = moved.groupBy("key").agg(F.collect_set(F.struct("digest", "target")).alias("targets"))  # one for each payload of a key

    # the join and the window deal rows by the same key: payloads move once; rows without a key are dealt by payload
    full = rows.withColumn("digest", digest).withColumn("deal", F.coalesce("key", F.xxhash64("digest"))).join(moved.withColumnRenamed("key", "deal"), "deal", "left")
    full = full.withColumn("number", F.row_number().over(Window.partitionBy("deal", "key", "digest").orderBy("uri")) - 1)
    target = F.filter(F.when(F.col("key").isNotNull(), F.col("targets")), lambda x: x["digest"] == F.col("digest"))
    full = full.withColumn("target", F.try_element_at(target, F.lit(1)))
    again = F.col("target").isNotNull()

    response, request, metadata = (_identifier(k, F.col("key"), F.col("digest"), F.col("number")) for k in ("response", "request", "metadata"))
    address = F.coalesce(F.regexp_replace(F.col("uri"), r"[\r\n ]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    sha1, size = F.concat(F.lit("sha1:"), F.sha1("body")), F.octet_length("body").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", address)]
    kinds = F.array(
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), address, F.lit(" HTTP/1.1\r\n\r\n"))),
        _record(
            [
                ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
                ("WARC-Record-ID", response),
                *common,
                ("WARC-Payload-Digest", sha1),
                ("WARC-Profile", F.when(again, F.lit(PROFILE))),
                ("WARC-Refers-To", F.when(again, _identifier("response", F.col("target.target"), F.col("digest"), F.lit(0)))),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            F.when(again, head).otherwise(F.concat(head, F.col("body"))),
        ),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", metadata), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\r\n"))),
    )
    return full.select(F.explode(kinds).alias("value"), F.octet_length("body").alias("payload_bytes"))


#: Bytes of payload that an archive holds at most, about, and largest payload of the smallest class of them.
FILE_BYTES, SMALL_BYTES = 256 << 20, 64 << 10


def write_warc(pages: DataFrame, path: str, payload: str = "html", records_per_file: int = 100_000, **columns) -> None:
    """Writes archives of ``records_per_file`` records at most.

    An archive is read as one binary value, so it must stay well below 2 GB however sizes are spread.  Payloads are put in
    classes, each of up to eight times the size of the one before, and written class by class; the largest payload of a
    class says how many records make a file.  Most tables have one class or two."""
    size = F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0))
    number = sum((F.when(size > SMALL_BYTES * 8**i, 1).otherwise(0) for i in range(5)), F.lit(0))  # up to 2 GB
    classes = sorted(r.c for r in pages.select(number.alias("c")).distinct().collect()) or [0]
    for number in classes:
        most = SMALL_BYTES * 8**number
        within = (F.col("payload_bytes") > (most // 8 if number else -1)) & (F.lit(number == 5) | (F.col("payload_bytes") <= most))
        some = records(pages, payload=payload, **columns).where(within).select("value")
        # a third of the records have a payload
        count = max(1, min(records_per_file, 3 * FILE_BYTES // most))
        some.write.mode("append" if number != classes[0] else "errorifexists").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", count).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)


def parse(stream: Iterator[bytes], with_payload: bool) -> Iterator[tuple]:
    """The records of an archive that comes in pieces."""
    held = bytearray()
    done = False

    def fill(n: int) -> bool:
        nonlocal done
        while len(held) < n and not done:
            piece = next(stream, None)
            if piece is None:
                done = True
            else:
                held.extend(piece)
        return len(held) >= n

    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0 and fill(len(held) + 1):
            at = held.find(b"\r\n\r\n")
        if at < 0:
            return
        fields = {k.lower().decode(): v.decode() for k, v in _FIELD.findall(bytes(held[:at]))}
        start, n = at + 4, int(fields["content-length"])
        if not fill(start + n):
            raise ValueError("the archive ends within a record")
        block = bytes(held[start : start + n])
        fill(start + n + 4)
        del held[: start + n + 4]
        kind, payload, size, digest, page = fields["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"{fields['warc-record-id']}: the payload isn't the one that was written")
        elif kind == "metadata":
            page = block.decode().removeprefix("page:").strip()
        concurrent, refers = fields.get("warc-concurrent-to"), fields.get("warc-refers-to")
        yield fields["warc-record-id"], kind, concurrent, refers, fields.get("warc-target-uri"), fields.get("warc-date"), size, digest, page, payload if with_payload and kind == "response" else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in ``path``."""
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD_SCHEMA.split(", ")])

    def inflate(data: memoryview) -> Iterator[bytes]:
        if bytes(data[:2]) != b"\x1f\x8b":
            for at in range(0, len(data), 1 << 20):
                yield bytes(data[at : at + (1 << 20)])
            return
        one, at = zlib.decompressobj(31), 0
        while at < len(data):
            yield one.decompress(data[at : at + (1 << 18)])
            at += 1 << 18
            while one.eof and one.unused_data:  # archives with a member for each record
                rest, one = one.unused_data, zlib.decompressobj(31)
                yield one.decompress(rest)
        yield one.flush()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for r in parse(inflate(memoryview(batch.column(0)[i].as_buffer())), with_payload):
                    held.append(r)
                    size += len(r[-1] or b"") + 300
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(columns, x, strict=True)) for x in held], schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(columns, x, strict=True)) for x in held], schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """(capture_id, response, request, metadata): a nested row for each capture.

    Records of one capture that are missing give null; requests and metadata whose response isn't there give none.
    """
    response = found.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct("kind", "uri", "date", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"))
    request = found.where("kind = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "uri", "date").alias("request"))
    metadata = found.where("kind = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", F.col("page_key").try_cast("long").alias("page")).alias("metadata"))
    return response.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""
