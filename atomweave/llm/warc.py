"""WARC archives: write captures, read records back, and assemble transactions.

Archives are written and read by Spark's text source, so they can lie in any store Spark knows, a lost
task is repeated by the commit protocol, and large archives are read in parts.  The reader cuts at version
lines.  Where a block itself holds one, the piece is shorter than its record's declared length, and where a
header line ends like one, the piece has no end of headers: files with such records, and only those, are put together again in order of their cuts, one record in memory at a time.

A capture is a request, a response (or a revisit of an equal one) and a metadata record; request and
metadata name the response in ``WARC-Concurrent-To``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stage
from .common import query, table

VERSION = "WARC/1.1"
END = "\r\n\r\n"
CUT = VERSION + "\r\n"  # no prefix of it occurs in it again, which a line reader's buffers could trip over
#: Characters that could end a header line or field.
UNSAFE = r"[\x00-\x20\x7F-\x9F\u2028\u2029]"
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 1000


def _record(kind: Column, name: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line ends; fields with null values are left out."""
    lines = [F.concat(F.lit(f"{field}: "), value, F.lit("\r\n")) for field, value in fields]
    return F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name, F.lit("\r\n"),
                    *[F.coalesce(line, F.lit("")) for line in lines],
                    F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _name(kind: str, key: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.lit(kind), *[key])),
                                                          "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _clean(value: Column) -> Column:
    """Header-safe text: blanks, control characters and line separators (also U+0085, U+2028, U+2029) are percent-encoded."""
    coded = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.when(
        c.rlike(UNSAFE), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(value.rlike(UNSAFE), F.array_join(coded, "")).otherwise(value)


def with_roles(pages: DataFrame, key: Column, url: Column, payload: Column) -> DataFrame:
    """``id``, ``url``, ``payload``, ``bytes``, ``digest`` and ``refers_to`` (null for responses) of every row.

    Of rows with equal payloads of at least 1000 bytes the one with the largest id is the response; rows
    that repeat that id are responses too, null ids are the smallest.  Only digests that occur more than
    once are joined back; they are staged, so that their size is known before payloads would be shuffled.
    """
    text = F.coalesce(payload, F.lit(""))
    rows = pages.select(key.cast("long").alias("id"), url.alias("url"), text.alias("payload"),
                        F.octet_length(text).cast("long").alias("bytes"), F.sha1(text).alias("digest"))
    large = F.col("bytes") >= LEAST_REVISIT
    repeated = stage(rows.where(large).groupBy("digest").agg(F.max("id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                     .where("_n > 1").select(F.col("digest").alias("_digest"), "_first"), "repeated-payloads")
    joined = rows.join(repeated, large & (F.col("digest") == F.col("_digest")), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.withColumn("refers_to", refers).drop("_digest", "_first")


def write(captures: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Write rows of :func:`with_roles` as archives.

    Archives compressed by gzip are read as a stream by one task each, uncompressed ones ("none") in parts.
    Rows that are equal in id, URL and payload have the same record ids.  A null id is left out of the metadata.
    """
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("")), "digest")
    response, target = _name("response", key), F.coalesce(F.when(F.col("url") != "", _clean(F.col("url"))),
                                                          F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    revisit = F.col("refers_to").isNotNull()
    date = F.lit("2024-01-01T00:00:00Z")
    host = F.coalesce(F.regexp_extract(target, "://([^/?#]*)", 1), F.lit(""))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = F.concat(*[F.coalesce(F.concat(F.lit(f"{field}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
                       for field, value in (("page-id", F.col("id")), ("refers-to-page-id", F.col("refers_to")))])
    records = F.array(
        _record(F.lit("request"), _name("request", key),
                [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Concurrent-To", response),
                 ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record(F.when(revisit, "revisit").otherwise("response"), response,
                [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest),
                 ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                 ("Content-Type", F.lit("application/http; msgtype=response"))],
                F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))),
        _record(F.lit("metadata"), _name("metadata", key),
                [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Concurrent-To", response),
                 ("Content-Type", F.lit("application/warc-fields"))], about))
    (captures.select(F.explode(records).alias("value")).write.option("lineSep", END)
     .option("compression", compression).text(folder))


def _glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put records together again that were cut inside their headers or blocks; rows come in order.

    Empty pieces count: they stand between two version lines in a row.  Only what lies before a file's first
    version line is no record's beginning.
    """
    held, name, lacking = [], None, 0

    def missing(record: str) -> int:
        """Bytes that the block lacks; -1 while the headers have not ended."""
        head, end, block = record.partition(END)
        if not end:
            return -1
        lengths = (line.split(":", 1)[1].strip() for line in head.split("\r\n") if line.lower().startswith("content-length:"))
        length = next(lengths, "")
        return max(0, int(length) - len(block.encode())) if re.fullmatch("[0-9]+", length) else 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([CUT.join(held)])], ["record"])

    for batch in batches:
        for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name == file and lacking:
                held.append(piece)
                if lacking > 0:
                    lacking = max(0, lacking - len(CUT) - len(piece.encode()))
                elif END in CUT + piece:
                    lacking = missing(CUT.join(held))
                continue
            if name is not None:
                yield out()
            lacking = 0 if name != file and END not in piece else missing(piece)
            held, name = [piece], file
    if name is not None:
        yield out()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records: ``record_id``, ``type``, ``target``, ``concurrent_to``, ``payload_digest``, ``length``,
    ``headers`` (the header lines), ``block`` (bytes, as many as declared) and ``complete`` (whether the
    archive has all of them)."""
    pieces = (spark.read.option("lineSep", CUT).text(folder)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                      F.monotonically_increasing_id().alias("place"), F.col("value").alias("record")))
    head = F.substring_index("record", END, 1)
    has = F.octet_length("record") - F.octet_length(head) - len(END)
    short = (F.col("record") != "") & (has < _length(head))  # without the end of its headers a piece has less than nothing
    broken = stage(pieces.where(short).select("file").distinct(), "cut-archives")
    if broken.isEmpty():
        return _parsed(pieces)
    again = (pieces.join(broken, "file", "left_semi").repartition("file").sortWithinPartitions("file", "part", "place")
             .select("file", "record").mapInArrow(_glue, "record string"))
    return _parsed(pieces.join(broken, "file", "left_anti").select("record").union(again))


def _field(headers: Column, name: str) -> Column:
    """A header field's value, whatever the case of its name; null if it is not there.  Only a line feed ends a line."""
    found = F.regexp_extract(headers, rf"(?imd)^{name}:[ \t]*(.*?)\r?$", 1)
    return F.when(found != "", found)


def _length(headers: Column) -> Column:
    """The declared length, 0 where it is missing or no number."""
    return F.coalesce(_field(headers, "Content-Length").try_cast("long"), F.lit(0))


def _parsed(pieces: DataFrame) -> DataFrame:
    head = F.col("headers")
    cut = pieces.withColumn("headers", F.substring_index("record", END, 1))
    length = _length(head)
    block = F.substring(F.col("record").cast("binary"), F.octet_length(head) + len(END) + 1,
                        F.least(length, F.lit(2**31 - 1)).cast("int"))
    return (cut.select(
        _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Type").alias("type"),
        _field(head, "WARC-Target-URI").alias("target"), _field(head, "WARC-Concurrent-To").alias("concurrent_to"),
        _field(head, "WARC-Payload-Digest").alias("payload_digest"), length.alias("length"), head, block.alias("block"),
        (F.octet_length("record") - F.octet_length(head) - len(END) >= length).alias("complete"))
        .where("type IS NOT NULL"))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (a response or revisit), its ``request``, and its ``metadata``.

    Requests and metadata are joined to the capture they are concurrent to; a missing one is null, the one
    with the smallest record id is taken where several name the same capture, and records that name no
    capture that is there are left out.
    """
    kept = ["record_id", "type", "target", "payload_digest", "length", "block"]
    captures = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct(*kept).alias("capture"))

    def least(kind: str) -> Column:
        return F.min(F.when(F.col("type") == kind, F.struct(*kept))).alias(kind)

    partners = (records.where(F.col("type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("record_id"))
                .agg(least("request"), least("metadata")))
    return captures.join(partners, "record_id", "left").select("capture", "request", "metadata")


WARC_SQL = f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT}
                     THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first,
             md5('request|' || coalesce(page_id::VARCHAR, 'null') || '|' || coalesce(url, '') || '|' || payload_digest) AS name FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       '<urn:uuid:' || name[1:8] || '-' || name[9:12] || '-' || name[13:16] || '-' || name[17:20] || '-' || name[21:32] || '>' AS request_id
FROM f
"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, written to archives and read back.

    A page without an id is a response unless an equal page of 1000 bytes or more has one, which it then refers
    to; the SQL, where a null equals nothing, calls each such page a revisit that refers to nothing.
    ``request_id`` is the record id of the request that was joined to the capture.
    """
    folder = fresh_path(spark, "archives")
    write(with_roles(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"), F.col("html")), folder)
    found = transactions(read(spark, folder))
    block = F.col("capture.block")
    at = F.locate(END, block.cast("string"))  # in characters, which are bytes in an HTTP head
    head = F.decode(F.substring(block, F.lit(1), at), "UTF-8")
    body = F.substring(block, at + len(END), F.octet_length(block))
    response = F.col("capture.type") == "response"

    def about(name: str) -> Column:
        fields = F.str_to_map(F.decode("metadata.block", "UTF-8"), F.lit("\r\n"), F.lit(": "))
        return F.try_element_at(fields, F.lit(name)).try_cast("long")

    return found.select(
        about("page-id").alias("page_id"),
        F.when(response, F.octet_length(body)).otherwise(_field(head, "Content-Length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1(body)).otherwise(F.substring_index("capture.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("capture.type").alias("record_type"), about("refers-to-page-id").alias("refers_to"),
        F.col("request.record_id").alias("request_id"))
