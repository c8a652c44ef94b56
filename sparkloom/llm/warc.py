"""WARC archives: a writer on Spark's text sink and a reader as a PySpark Python data source.

Writing: each page becomes one record; the text sink puts the two line ends that close a WARC record between rows, so Spark's
commit protocol makes the files, on any file system that Spark writes to. Of pages with equal payloads (by SHA-1) the one with
the least page_id is a ``response``, the others are ``revisit`` records that hold headers only and refer to it.

Reading: files are planned into partitions by size: small files share one, a file is never cut (a record's start can only be
told from the record before it). Equality and membership filters on record_type and on header columns are pushed down. Of each
record the headers are parsed first; where the pushed filters say no, the reader seeks past its block without reading it. In a
compressed file a skipped block must be inflated, as only that tells where the next record begins, but is not kept.

Damage: bytes between records are passed over up to the next line that begins a record; a length that is no number counts as
none. A block that its file cuts short, or whose compressed data are damaged, is returned as far as it goes with ``complete``
false; what follows it in a damaged compressed file can't be read. Option strict=true raises instead.

Defined results: a null html is an empty payload. A null page_id sorts after all others and is read back as null; pages with
equal payloads and the same least page_id are all responses, as is a page of a group without any page_id. Line ends in a url
are dropped, a null url writes no header. An empty table writes no records and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .common import cut, load, map_arrow, remove, shared_dir

CLOSE = "\r\n\r\n"
ID_PREFIX = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of files that a read partition takes, and of payloads that a batch handed to Spark holds, at least one of each.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: Bytes of a line between records, and of a payload, that are read at once.
LINE_BYTES, READ_BYTES = 1 << 16, 8 << 20
#: Digests of repeated payloads that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 100_000

# ---------------------------------------------------------------- writing


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are eight groups of 20, four letters each."""
    digest, letters = F.sha1(payload), []
    for k in range(8):
        group = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Column value: each page's record without the line ends that close it."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.regexp_replace(url, "[\r\n]", "").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    repeated = cut(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first"))
    known = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    rows = rows.join(known, F.col("digest") == F.col("same"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    ident = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(CLOSE))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),  # null: concat_ws leaves it out
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(CLOSE), block).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", CLOSE).text(path)


# ---------------------------------------------------------------- reading

#: Columns and the headers they hold.
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_COLUMNS) + ", content_length long, http_headers string, payload binary, complete boolean, file string, offset long"
ARROW = pa.schema([*((c, pa.string()) for c in HEADER_COLUMNS), ("content_length", pa.int64()), ("http_headers", pa.string()), ("payload", pa.binary()), ("complete", pa.bool_()), ("file", pa.string()), ("offset", pa.int64())])


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def plan(sizes: list[tuple[str, int]], at_most: int) -> list[list[str]]:
    """Files in order, packed into lists of up to at_most bytes; a larger file stands alone."""
    out, room = [], 0
    for name, size in sorted(sizes):
        if not out or size > room:
            out.append([])
            room = at_most
        out[-1].append(name)
        room -= size
    return out


def matches(row: dict[str, str | None], filters: list[Filter]) -> bool:
    for f in filters:
        value = row[f.attribute[0]]
        if value is None:
            return False
        if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
            return False
    return True


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; a line that starts with white space carries the one before it on."""
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] and text[0] in " \t" and name:
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Damaged(ValueError):
    """What a strict reader raises."""


class Records:
    """A file's records: headers first, the block only on demand."""

    def __init__(self, stream, strict: bool = False):
        self.stream, self.strict = stream, strict

    def _line(self) -> tuple[int, bytes]:
        return self.stream.tell(), self.stream.readline(LINE_BYTES)

    def head(self) -> tuple[int, dict[str, str]] | None:
        offset, line = self._line()
        begins = True  # whether the line does, and isn't the rest of a long one
        while line and not (begins and line.startswith(b"WARC/")):
            if self.strict and line not in (b"\r\n", b"\n"):
                raise Damaged(f"no WARC record at {offset}")
            begins = line.endswith(b"\n")
            offset, line = self._line()
        if not line:
            return None
        lines = []
        while (line := self.stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        return offset, parse_headers(lines)

    def skip(self, length: int) -> None:
        self.stream.seek(length, 1)


def number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.isascii() and text.isdigit() else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.strict = options.get("strict", "false").lower() == "true"
        self.at_most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = open_fs(self.path)
        one = fs.get_file_info(root)
        found = [one] if one.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        sizes = [(f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return [Files(x) for x in plan(sizes, self.at_most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        rows, held = [], 0
        for name in partition.files:
            for row in self._records(fs, name):
                rows.append(row)
                held += len(row["payload"] or b"") + 1000
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def _records(self, fs: pafs.FileSystem, name: str) -> Iterator[dict]:
        import gzip
        import io
        import zlib

        with fs.open_input_file(name) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            reader = Records(gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream, self.strict)
            row: dict | None = None
            try:
                while (found := reader.head()) is not None:
                    offset, headers = found
                    row = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
                    length = number(headers.get("content-length")) or 0
                    if not matches(row, self.filters):
                        row = None
                        reader.skip(length)
                        continue
                    row |= {"content_length": length, "http_headers": None, "payload": None, "complete": False, "file": name, "offset": offset}
                    yield self._block(reader, row, length)
                    row = None
            except (EOFError, zlib.error, gzip.BadGzipFile) as damage:
                if self.strict:
                    raise Damaged(f"{name}: {damage}") from damage
                if row is not None:
                    yield row

    def _block(self, reader: Records, row: dict, length: int) -> dict:
        """The row with its block's parts. They are put there as they come, for the case that the data end."""
        left = length
        if (row["content_type"] or "").startswith("application/http"):
            lines = []
            try:
                while left and (line := reader.stream.readline(left)):
                    left -= len(line)
                    if line in (b"\r\n", b"\n"):
                        break
                    lines.append(line)
            finally:
                row["http_headers"] = b"".join(lines).decode("utf-8", "replace")
        if self.payloads and row["record_type"] != "revisit":
            parts = []
            row["payload"] = b""
            try:
                while left and (part := reader.stream.read(min(left, READ_BYTES))):
                    parts.append(part)
                    left -= len(part)
            finally:
                row["payload"] = b"".join(parts)
            row["complete"] = not left
        else:
            # whether the block is whole is told by its last byte
            if left > 1:
                reader.skip(left - 1)
            row["complete"] = not left or bool(reader.stream.read(1))
        if self.strict and not row["complete"]:
            raise Damaged(f"{row['file']}: a record cut short at {row['offset']}")
        return row


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", folder); option payload=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, **options).load()


def payload_facts(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are measured on the payload that was read; a revisit's, and those of a payload that wasn't read, are its headers', null without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, payloads, http, digests = (batch.column(k).to_pylist() for k in range(2, 6))
            sizes, found = [], []
            for kind, payload, head, digest in zip(kinds, payloads, http, digests):
                if kind == "revisit" or payload is None:
                    sizes.append(number(parse_headers((head or "").encode().split(b"\r\n")[1:]).get("content-length")))
                    found.append(digest and digest.removeprefix("sha1:"))
                else:
                    sizes.append(len(payload))
                    found.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.string()), batch.column(2), batch.column(1)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ident = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '{ID_PREFIX}([0-9-]*)>', 1), '') as bigint)")
    wanted = archive.select(ident("record_id").alias("page_id"), ident("refers_to").alias("refers_to"), "record_type", "payload", "http_headers", "payload_digest")
    return map_arrow(wanted, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    write(load(spark, sf_dir, "pages"), folder)
    found = cut(payload_facts(read(spark, folder).where(F.col("record_type").isin("response", "revisit"))))
    remove(spark, folder)
    return found


QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL: dict[str, str] = {}
