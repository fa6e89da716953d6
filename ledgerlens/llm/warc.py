"""WARC archives: write captures, read them back, resolve revisits, write deduplicated archives.

An archive is a folder of gzip-compressed WARC/1.1 files that Spark's text writer commits (record separator CR LF CR LF), so
a lost task leaves no half-written file.  Readers split the stream where a record's end meets the next version line.
A payload that holds a version text could be split too, so it is sent in chunked transfer coding with a chunk border
inside each version text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialise

CRLF = "\r\n"
BLANK = CRLF + CRLF
VERSION = "WARC/1.1"
SPLIT = BLANK + VERSION + CRLF
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always kept as responses.
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000


def _header(name: str, value: Column) -> Column:
    """``name: value`` and CR LF, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _field(lines: str, name: str) -> Column:
    """Value of the first of a header's lines with this name, or null."""
    line = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(name + ": "))), F.lit(0))
    return F.substring(line, len(name) + 3, 1 << 30)


def _chunked(payload: Column) -> Column:
    """Chunked coding with a border inside each version text, so that no separator forms, also not with what stands around."""
    parts = F.split(payload, r"WARC(?=/1\.1)", -1)
    last = F.size(parts) - 1
    coded = F.transform(parts, lambda p, i: F.when(i < last, F.concat(p, F.lit("WARC"))).otherwise(p))
    sized = F.transform(coded, lambda p: F.when(p == "", F.lit("")).otherwise(
        F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(CRLF), p, F.lit(CRLF))))
    return F.concat(F.array_join(sized, ""), F.lit("0" + BLANK))


def _unchunked(body: Column) -> Column:
    """Payload bytes of a chunked body (bytes)."""
    rounds = F.sequence(F.lit(1), F.regexp_count(body.cast("string"), F.lit(r"\r\n")))
    start = F.struct(body.alias("rest"), F.lit(b"").alias("payload"))

    def step(state, _):
        rest = state["rest"]
        line = F.substring_index(F.substring(rest, 1, 20).cast("string"), CRLF, 1)
        size = F.coalesce(F.conv(line, 16, 10).cast("int"), F.lit(0))
        at = F.length(line) + 3
        more = size > 0
        return F.struct(F.when(more, F.substring(rest, at + size + 2, F.length(rest))).otherwise(F.lit(b"")).alias("rest"),
                        F.when(more, F.concat(state["payload"], F.substring(rest, at, size)))
                        .otherwise(state["payload"]).alias("payload"))

    return F.aggregate(rounds, start, step, lambda s: s["payload"])


def _uuid(*parts: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _record(head: Column, block: Column) -> Column:
    return F.concat(F.lit(VERSION + CRLF), head, _header("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def _write(records: DataFrame, path: str) -> None:
    (records.write.option("lineSep", BLANK).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One response record per row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8 (null: empty).  A null page_id or url leaves its header out; control characters
    and spaces of a url become %20.  The record id is that of the row's place in the scan, so equal rows differ.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    hides = F.contains(payload, F.lit(VERSION))
    block = F.concat(F.lit(HTTP), F.when(hides, F.lit("Transfer-Encoding: chunked" + BLANK)).otherwise(F.concat(
        _header("Content-Length", F.octet_length(payload)), F.lit(CRLF))),
        F.when(hides, _chunked(payload)).otherwise(payload))
    head = F.concat(
        F.lit("WARC-Type: response" + CRLF),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record"), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", "%20")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))),
        _header("X-Page-ID", F.col("page_id").cast("long")),
        _header("Content-Type", F.lit("application/http;msgtype=response")))
    rows = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("at"))
    record = _uuid(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("at").cast("string"))
    _write(rows.withColumn("record", record).select(_record(head, block).alias("value")), path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, target_uri, date, payload_digest, refers_to, payload_bytes, head, block) of all
    records; block is everything after the record's header, cut to its Content-Length.

    A block shorter than its Content-Length raises an error: the archive is damaged.
    """
    raw = spark.read.option("lineSep", SPLIT).schema("value string").text(path).where("value != ''")
    text = F.when(F.startswith("value", F.lit(VERSION)), F.substring("value", len(VERSION + CRLF) + 1, 1 << 30)
                  ).otherwise(F.col("value"))
    raw = raw.select(text.alias("value"))
    split = raw.select(F.substring_index("value", BLANK, 1).alias("head"),
                       F.expr("value").cast("binary").alias("bytes"))
    split = split.withColumn("lines", F.split("head", CRLF))  # once per record, for all fields
    split = split.withColumn("size", _field("lines", "Content-Length").cast("int"))
    begin = F.octet_length("head") + len(BLANK)
    whole = F.octet_length("bytes") >= begin + F.col("size")
    block = F.when(whole, F.substring("bytes", begin + 1, F.col("size"))).otherwise(
        F.raise_error(F.concat(F.lit("damaged WARC record: "), F.col("head"))).cast("binary"))
    strip = lambda c: F.regexp_extract(c, "^<?(?:urn:uuid:)?([^>]*)>?$", 1)
    return split.select(
        strip(_field("lines", "WARC-Record-ID")).alias("record_id"), _field("lines", "WARC-Type").alias("record_type"),
        _field("lines", "X-Page-ID").cast("long").alias("page_id"), _field("lines", "WARC-Target-URI").alias("target_uri"),
        _field("lines", "WARC-Date").alias("date"),
        F.regexp_replace(_field("lines", "WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        strip(_field("lines", "WARC-Refers-To")).alias("refers_to"), block.alias("block"))


def payload_of(block: Column) -> Column:
    """Payload bytes of an HTTP response block, chunked coding undone."""
    head = F.substring_index(F.substring(block, 1, 4096).cast("string"), BLANK, 1)
    body = F.substring(block, F.octet_length(head) + len(BLANK) + 1, F.octet_length(block))
    return F.when(F.contains(head, F.lit("Transfer-Encoding: chunked")), _unchunked(body)).otherwise(body)


def resolve(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """For each revisit: (record_id, original record, page, uri, date).

    ``headers`` has record_id, page_id, target_uri, date, payload_digest, payload_bytes of response records; only these
    are shuffled, by digest.  The original is the record with the smallest page_id (null last, then record_id); the
    others of its digest revisit it if the payload has ``min_bytes`` or more.  Originals come from a partial
    aggregate, so a payload that a third of all records share costs one row per task; the join back keeps only
    digests with more than one record.
    """
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "target_uri", "date")
    first = (long.groupBy("payload_digest").agg(F.min(key).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("payload_digest", "first.*", "n")
             .toDF("payload_digest", "none", "of_page", "of_record", "of_uri", "of_date", "n").drop("none", "n"))
    return (long.select("record_id", "payload_digest").join(first, "payload_digest")
            .where(F.col("record_id") != F.col("of_record")).drop("payload_digest"))


def deduplicate(spark: SparkSession, captures: str, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the archives of ``captures`` anew: first responses whole, repeats as revisit records, headers fresh."""
    records = read_headers(spark, captures).where("record_type = 'response'")
    full = records.withColumn("payload_bytes", F.octet_length(payload_of(F.col("block")))).select(
        "record_id", "page_id", "target_uri", "date", "payload_digest", "payload_bytes")
    full = materialise(full, "warc-headers")  # so that the archives are parsed once for both sides of the join
    joined = records.join(resolve(full, min_bytes), "record_id", "left")
    is_revisit = F.col("of_record").isNotNull()
    fresh = _uuid(F.lit("dedup"), F.col("record_id"))
    head = F.concat(
        F.when(is_revisit, F.lit("WARC-Type: revisit" + CRLF)).otherwise(F.lit("WARC-Type: response" + CRLF)),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), fresh, F.lit(">"))),
        _header("WARC-Date", F.col("date")), _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("X-Page-ID", F.col("page_id")),
        F.when(is_revisit, F.concat(
            _header("WARC-Profile", F.lit(PROFILE)),
            _header("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), _uuid(F.lit("dedup"), F.col("of_record")), F.lit(">"))),
            _header("WARC-Refers-To-Target-URI", F.col("of_uri")),
            _header("WARC-Refers-To-Date", F.col("of_date")))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http;msgtype=response")))
    http_head = F.concat(F.substring_index(F.substring("block", 1, 4096).cast("string"), BLANK, 1), F.lit(BLANK))
    block = F.when(is_revisit, http_head).otherwise(F.col("block").cast("string"))
    _write(joined.select(_record(head, block).alias("value")), path)
    discard(full)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, date) of all records.

    Responses' bytes and digests are those of the payload that the archive holds, not what its headers claim.  Revisits take
    theirs from the response that they refer to, by record id; a revisit of a record that is not there has null bytes.
    """
    records = read_headers(spark, path)
    response = F.col("record_type") == "response"
    records = records.withColumn("payload", F.when(response, payload_of(F.col("block"))))
    # without payloads, and written, so that the archives are parsed and hashed once for all that follows
    slim = materialise(records.select(
        "record_id", "record_type", "page_id", "target_uri", "date", "refers_to",
        F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "warc-records")
    revisits = slim.where("record_type = 'revisit'")
    # only responses that some revisit names are joined; the names are few after a distinct
    named = slim.where("record_type = 'response'").join(
        revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    of = named.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"),
                      F.col("bytes").alias("of_bytes"), F.col("digest").alias("of_digest"))
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "date")
    back = revisits.join(of, "refers_to", "left").select(
        "page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type",
        F.col("of_page").alias("refers_to"), "target_uri", "date")
    whole = slim.where("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), "target_uri", "date")
    return whole.select(*out).unionByName(back.select(*out))


def deduplicated_archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages to archives, revisits resolved, and the deduplicated archives read back; see :func:`read_archives`.

    No pages, no records.  Other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    captures, kept = fresh_path(spark, "warc-captures"), fresh_path(spark, "warc")
    write_archives(pages, captures)
    deduplicate(spark, captures, kept, min_bytes)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(captures)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return read_archives(spark, kept)
