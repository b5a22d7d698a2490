"""WARC archives with resolved revisits.

Writing: headers (page, digest, size) are grouped by payload digest, which finds the original of each group of equal
payloads of at least ``min_bytes``, the capture with the largest page_id; the decision joins the captures by page, so a
payload is shuffled once and never by a hot digest. Captures become WARC 1.0 response or revisit records with fresh
record ids and headers, written by Spark's own text writer (a record ends with two line ends) as files of at most
``RECORDS_PER_FILE`` records. Reading: whole files are cut into records by Content-Length, and revisits are joined to
the responses that they refer to.

Defined results: null html is an empty payload, null url an empty target; control characters in a url are dropped.
Rows with a null page_id are responses. Repeated rows of one page with one payload are the same capture: all are
responses or all are revisits of the same one. Extra columns are dropped; an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtables.llm.storage import new_folder

MIN_BYTES = 1000
RECORDS_PER_FILE = 5000
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, refers_to_id string, page_id long, target_uri string, payload_digest string, payload binary"


def record_id(page_id: Column, digest: Column) -> Column:
    """urn:uuid of a capture, from its page and payload."""
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    return F.format_string("<urn:uuid:%s-%s-%s-%s-%s>", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def captures(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))


def resolved(rows: DataFrame, min_bytes: int) -> DataFrame:
    """captures with ``original``: the page that a revisit refers to, null for responses."""
    headers = rows.select("page_id", "digest", F.octet_length("html").alias("n")).filter(F.col("n") >= min_bytes)
    originals = headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.min("page_id").alias("least")).filter("least < original").select("digest", "original")
    revisits = headers.select("page_id", "digest").distinct().join(originals, "digest").filter("page_id < original")
    return rows.join(revisits, ["page_id", "digest"], "left")


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2025-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a record for each row of pages (page_id, url, html) to files in the folder ``path``.

    compression: gzip (each file is one gzip member) or none.
    """
    rows = resolved(captures(pages), min_bytes)
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.coalesce(F.col("page_id").cast("string"), F.uuid()), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", "")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), record_id(F.col("original"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)  # concat_ws leaves out what is null
    rows.select(record.alias("value")).write.option("lineSep", END + END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)


def parse(content: bytes, name: str) -> Iterator[tuple]:
    """Records of one archive file, plain or gzip."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at} of {name}")
        found = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in content[at:head].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(found["content-length"])
        block = content[head + 4 : head + 4 + size]
        at = head + 4 + size + 4
        page = found.get("warc-page-id")
        digest = found.get("warc-payload-digest", "").removeprefix("sha1:")
        yield found.get("warc-type"), found.get("warc-record-id"), found.get("warc-refers-to"), int(page) if page else None, found.get("warc-target-uri"), digest, block[block.find(b"\r\n\r\n") + 4 :]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archive files in ``path``; revisits have an empty payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for record in parse(content.as_py(), name):
                    held.append(record)
                    size += len(record[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; revisits take theirs from the response."""
    facts = records.select("record_type", "record_id", "refers_to_id", "page_id", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")).persist(StorageLevel.MEMORY_AND_DISK)
    responses = facts.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    wanted = facts.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id")
    originals = facts.filter("record_type = 'response'").join(wanted.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    return responses.unionByName(wanted.join(originals, "refers_to_id", "left").drop("refers_to_id"))


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives of ``pages`` (to a new folder of the shared one if no path is given) and read them back."""
    path = path or new_folder(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return resolve(read_archive(pages.sparkSession, path))
