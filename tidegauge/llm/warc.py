"""WARC archives: writing, normalising monolithic gzip, offset index, reading back.

Many crawlers gzip a whole WARC file as one stream, which cannot be read from
the middle. The normaliser inflates such a file once, as a stream through
Spark's text source, rewrites each record as a gzip member of its own and keeps
an index of offsets beside it, so that any range of records can be read alone.

Tasks write members through pyarrow.fs to a folder that executors share. Each
attempt has files of its own and only the index, committed by Spark, says which
count: a lost executor leaves an unreferenced file and no wrong rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import shared

BREAK = "\r\n\r\n"
INDEX = "file string, offset long, size long, record_id string, page_id long, payload_bytes long, payload_digest string"
#: Neighbouring records up to this many bytes are read at once.
READ_BYTES = 8 << 20


def write_monolithic(pages: DataFrame, path: str) -> None:
    """One response record per row of (page_id, url, html); each file is one gzip stream.

    A null html is an empty payload; a null url or page_id leaves its header out.
    """
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(">")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url").cast("string"))),
        F.concat(F.lit("Page-ID: "), F.col("page_id").cast("long").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    # the text writer ends each row with the record's closing blank lines
    pages.select(F.concat(header, F.lit(BREAK), payload)).write.option("compression", "gzip").option("lineSep", BREAK).text(path)


def field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", header)
    return found[1].decode("utf-8", "replace") if found else None


def records(pieces, where: str):
    """(header, payload) from the pieces between blank lines of one WARC stream."""
    gap = BREAK.encode()
    held, header, need = bytearray(), None, 0
    for piece in pieces:
        held += piece + gap
        while True:
            if header is None:
                while held.startswith(b"\r\n"):
                    del held[:2]
                end = held.find(gap)
                if end < 0:
                    break
                header = bytes(held[:end])
                length = field(header, "Content-Length")
                if not header.startswith(b"WARC/") or length is None:
                    raise ValueError(f"no WARC record where one should begin: {where}")
                del held[: end + 4]
                need = int(length)
            if len(held) < need:
                break
            yield header, bytes(held[:need])
            del held[:need]
            header = None
    if header is not None or bytes(held).strip():
        raise ValueError(f"the last record is cut off: {where}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the monolithic files in source as files of one member a record in target; the index.

    The result is the sidecar index and must be written once, as staged() does.
    """

    def run(batches):
        store, folder = fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        rows: list[tuple] = []
        now: dict = {"name": None}

        def pieces():
            for batch in batches:
                for name, value in zip(batch.column(0), batch.column(1), strict=True):
                    yield name.as_py(), value.as_py()

        def streams():
            """The pieces of each file; files of a task come one after the other."""
            source_ = pieces()
            ahead = next(source_, None)
            while ahead:
                name = ahead[0]

                def one():
                    nonlocal ahead
                    while ahead and ahead[0] == name:
                        value = ahead[1]
                        ahead = next(source_, None)
                        yield value

                yield name, one()

        for name, stream in streams():
            base = re.sub(r"\.(txt|warc)?(\.gz)?$", "", name.rsplit("/", 1)[-1])
            now["name"] = f"{folder}/{base[:40]}-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(now["name"], compression=None) as out:
                offset = 0
                for header, payload in records(stream, name):
                    mark = digest(payload)
                    if field(header, "WARC-Payload-Digest") is None:
                        header += f"\r\nWARC-Payload-Digest: sha1:{mark}".encode()
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(header + BREAK.encode() + payload + BREAK.encode()) + packer.flush()
                    out.write(member)
                    page = field(header, "Page-ID")
                    rows.append((now["name"], offset, len(member), field(header, "WARC-Record-ID"), None if page is None else int(page), len(payload), mark))
                    offset += len(member)
                    if len(rows) == 2000:
                        yield _rows(rows)
                        rows = []
        if rows:
            yield _rows(rows)

    raw = spark.read.option("lineSep", BREAK).text(source).select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    return raw.mapInArrow(run, INDEX)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_indexed(index: DataFrame, target: str) -> DataFrame:
    """page_id, url, payload of the records that rows of an index (file, offset, size) name."""
    schema = pa.schema({"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary()})

    def run(batches):
        store, _ = fs.FileSystem.from_uri(target)
        for batch in batches:
            wanted = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            while at < len(wanted):
                name, first, size = wanted[at]
                end = at + 1
                while end < len(wanted) and wanted[end][0] == name and wanted[end][1] == first + size and size + wanted[end][2] <= READ_BYTES:
                    size += wanted[end][2]
                    end += 1
                with store.open_input_file(name) as file:
                    data = file.read_at(size, first)
                out: list[tuple] = []
                for _, offset, length in wanted[at:end]:
                    record = zlib.decompress(data[offset - first : offset - first + length], 31)
                    header, _, rest = record.partition(BREAK.encode())
                    page = field(header, "Page-ID")
                    out.append((None if page is None else int(page), field(header, "WARC-Target-URI"), rest[: int(field(header, "Content-Length"))]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                at = end

    return index.select("file", "offset", "size").mapInArrow(run, "page_id long, url string, payload binary")


def mark_revisits(read: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records read back.

    Of equal payloads of at least min_bytes the largest page_id is the response
    and the others revisit it (rows that repeat that page_id are responses too).
    """

    @F.pandas_udf("string")
    def base32(payloads):
        return payloads.map(digest)

    own = shared.staged(read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32("payload").alias("payload_digest")), "digests")
    repeated = own.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return own.join(repeated, "payload_digest", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to")
    )


def roundtrip(pages: DataFrame, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Archive pages (page_id, url, html), normalise the archives, read them back by their index.

    Null html is an empty payload; a null page_id stays null, is never the
    largest of a group, and revisits a group's largest id where there is one.
    Repeated rows are records of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    raw, target = shared.new_path(spark, "warc-raw"), shared.new_path(spark, "warc")
    write_monolithic(pages, raw)
    index = shared.staged(normalise(spark, raw, target, level), "warc-index")
    return mark_revisits(read_indexed(index, target), min_bytes)
