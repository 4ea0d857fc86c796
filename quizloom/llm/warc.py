"""Deduplicated web archives: revisit resolution, writing and reading of WARC files.

Pages are read and hashed once, into a table. Headers (digest, id, address; no payload) are aggregated by payload
digest: the record with the largest id is the response that the others revisit. Headers alone are
joined with the digests that occur more than once, with an exchange on either side, so Spark can split
a digest that a third of the pages share; that gives the revisits, which need no payload. Responses
pass no exchange: a bit table says whose digest may be repeated, another which of those may be the
response, and only pages that pass both are joined to be sure.

Records are text, so Spark's text writer puts them into gzipped archives in the shared folder; a
record's end (CRLF CRLF) is its line separator. A file is bounded in bytes: one write deals each task's records by size
class, and to a new file once as many as fit in FILE_BYTES may be there. A revisit carries fresh headers and
no payload. Spark reads the archives as binary files; each task parses whole files, and checks every
response's digest and length.

Nulls: a null payload is empty; a null address leaves its header out; a row with a null id is
written without an id and revisits its digest's response, or is a response itself if no id is known.
Rows that repeat the largest id of a digest are responses. Payloads smaller than min_bytes are
never revisits. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import id_table, materialise, may_hold, new_path, remove, tables

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Payload bytes of the first size class, and those of a file where each record is as long as its class allows.
SMALL, FILE_BYTES = 1 << 16, 1 << 28
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: Column) -> Column:
    """Base32 of the payload's SHA-1: five hex digits at a time are four letters."""
    hexed = F.sha1(payload.cast("binary"))
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (id, url, payload, digest, bytes) with refers_to and refers_url, null for responses; revisits lack a payload."""
    heads = pages.drop("payload")
    # What decides between the rows of a digest; a row without an id is none of those with the largest.
    key = F.concat_ws(":", "digest", "id").alias("key")
    asked = heads.where(F.col("bytes") >= min_bytes)
    originals = asked.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n"))
    originals = originals.where((F.col("n") > 1) & F.col("first.id").isNotNull())
    originals = materialise(originals.select("digest", F.col("first.id").alias("to"), F.col("first.url").alias("to_url")), "originals")
    repeated = id_table(originals, "digest")
    again = asked.where(may_hold(repeated, "digest")).join(originals, "digest", "left")
    again = materialise(again.select("digest", "id", "url", "bytes", "to", "to_url"), "again")
    own = F.col("to").isNull() | F.col("id").eqNullSafe(F.col("to"))
    answers = materialise(again.where(own).select(key).distinct(), "answers")
    revisits = again.where(~own).select("id", "url", F.lit(None).cast("string").alias("payload"), "digest", "bytes", F.col("to").alias("refers_to"), F.col("to_url").alias("refers_url"))

    none = {"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}
    first = pages.where((F.col("bytes") < min_bytes) | ~may_hold(repeated, "digest"))
    # Of pages whose digest may be repeated, those that may be the response; the join decides.
    some = pages.where(F.col("bytes") >= min_bytes).withColumn("key", key).where(may_hold(repeated, "digest") & may_hold(id_table(answers, "key"), "key"))
    some = some.join(answers, "key", "left_semi").drop("key")
    return revisits.unionByName(first.withColumns(none)).unionByName(some.withColumns(none))


def _record_id(id_: Column, digest: Column) -> Column:
    """The same for the same page, however often its task runs."""
    h = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def record(date: str) -> Column:
    """A row's WARC record, without the separator that ends it."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x20]+", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest")))).otherwise(""),
        maybe("WARC-Refers-To-Target-URI", clean(F.col("refers_url"))),
        maybe("X-Page-ID", F.col("id")),
        maybe("X-Refers-To-Page-ID", F.col("refers_to")),
        line("X-Payload-Length", F.col("bytes")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
        block,
    )


def size_class(bytes_: Column) -> Column:
    """0 for payloads of up to SMALL bytes, one more for each four times that."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(bytes_, F.lit(1)) / SMALL) / 2)).cast("int")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None) -> None:
    """Writes the archives size=*/file=*/part-*.txt.gz under path; records are dated now unless date is given."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), digest_of(payload).alias("digest"))
    with tables() as own:
        rows = materialise(rows, "pages")
        largest = rows.agg(F.max(size_class(F.col("bytes")))).first()[0] or 0
        rows = resolved(rows, min_bytes)
    rows = rows.withColumn("size", F.when(F.col("refers_to").isNull(), size_class(F.col("bytes"))).otherwise(0))
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of its task
    most = F.greatest(F.lit(1), F.floor(FILE_BYTES / (SMALL * F.pow(F.lit(4), F.col("size")))))
    rows = rows.withColumn("file", F.floor(nth / most).cast("int"))
    out = rows.select(record(date).alias("value"), "size", "file").write.partitionBy("size", "file")
    out.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
    jvm, conf = pages.sparkSession._jvm, pages.sparkSession._jsc.hadoopConfiguration()
    for size in range(largest + 1):  # a folder for every class up to the largest, also for those that no page is in
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/size={size}")
        at.getFileSystem(conf).mkdirs(at)
    remove(pages.sparkSession, own)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (text := stream.readline().decode().rstrip(CRLF)) != "":
            name, _, value = text.partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"truncated record {headers.get('WARC-Record-ID')}")
        yield headers, block


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda text: None if text is None else int(text)
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                digest, size, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"]), headers["WARC-Type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its headers")
                rows.append((number(headers.get("X-Page-ID")), size, digest, kind, number(headers.get("X-Refers-To-Page-ID"))))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read_rows, READ)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages into new archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "archives")
    write(pages, path, **columns)
    return read(pages.sparkSession, path)
