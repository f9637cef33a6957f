"""WARC archives as a Spark data source.

Reading: one input partition per file; predicates on the record type and on header columns
go to the source, which reads a record's headers first and steps over the rest of a record
that they reject. ``payload=false`` leaves payloads out altogether: they are never decoded.
Writing: each task writes one file after the other, of about ``file_bytes`` of records, so
that no later read meets a huge file; only files named in the manifest at commit count.

A record that repeats the payload of another is a revisit: it has the HTTP headers, whose
Content-Length and the record's digest are those of the full payload, and no payload.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
                                    IsNull, StringStartsWith, WriterCommitMessage)

from gaugeline.session import join_small

from .common import filesystem, stored, utf8

SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, payload_digest string, refers_to string, "
          "payload_length long, headers map<string,string>, http_headers map<string,string>, payload binary")
# Record columns that come straight from a header; predicates on them are pushed down.
HEADER_OF = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date",
             "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_BATCH_ROWS, _BATCH_BYTES = 1000, 8 << 20
_STEP = 1 << 20


# ---- records ------------------------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(row: dict) -> bytes:
    """One record of a row with record_id, record_type, target_uri, record_date, payload_digest, refers_to, payload_length, payload."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    body += row["payload"] or b""
    head = ["WARC/1.1"]
    for column, name in HEADER_OF.items():
        value = row.get(column) or (_DATE if column == "record_date" else None)
        if value is not None:
            head.append(f"{name}: {_clean(value)}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {IDENTICAL}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:   # a folded line continues the one before
            out[last] += " " + line.strip().decode(errors="replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().decode(errors="replace")
        out[last] = value.strip().decode(errors="replace")
    return out


def _lines(stream: BinaryIO) -> list[bytes]:
    """Lines up to an empty one."""
    out = []
    while line := stream.readline():
        if not (line := line.rstrip(b"\r\n")):
            return out
        out.append(line)
    if out:
        raise ValueError("the archive ends inside a record's headers")
    return out


def _get(fields: dict[str, str], name: str) -> str | None:
    return next((v for k, v in fields.items() if k.lower() == name.lower()), None)


def _skip(stream: BinaryIO, n: int, seekable: bool) -> None:
    if seekable:
        stream.seek(n, 1)
        return
    while n > 0:
        got = len(stream.read(min(n, _STEP)))
        if not got:
            raise ValueError("the archive ends inside a record")
        n -= got


def parse(stream: BinaryIO, wanted=lambda row: True, payload: bool = True, seekable: bool = False) -> Iterator[dict]:
    """Rows of SCHEMA. ``wanted`` sees a record's headers; what it rejects is stepped over."""
    while True:
        start = stream.readline()
        while start in (b"\r\n", b"\n"):
            start = stream.readline()
        if not start:
            return
        if not start.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {start[:40]!r}")
        fields = _fields(_lines(stream))
        size = int(_get(fields, "Content-Length") or 0)
        row = {column: _get(fields, name) for column, name in HEADER_OF.items()}
        if not wanted(row):
            _skip(stream, size, seekable)
            continue
        http: dict[str, str] = {}
        if (_get(fields, "Content-Type") or "").startswith("application/http"):
            body = stream.read(size) if payload else stream.read(min(size, 1 << 16))
            head, found, rest = body.partition(b"\r\n\r\n")
            http = _fields(head.split(b"\r\n")[1:]) if found else {}
            row["payload"] = rest if payload else None
            read = len(body)
        else:
            body = stream.read(size) if payload else b""
            row["payload"], read = (body if payload else None), len(body)
        if payload and read < size:
            raise ValueError("the archive ends inside a record")
        _skip(stream, size - read, seekable)
        length = _get(http, "Content-Length")
        row |= {"headers": fields, "http_headers": http,
                "payload_length": int(length) if (length or "").isdigit() else len(row["payload"] or b"")}
        yield row


# ---- the data source ------------------------------------------------------------------------

@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class Warc(DataSource):
    """Format ``warc``. Options: ``path`` (file or folder), ``payload``, ``compress``, ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], str(self.options.get("payload", "true")).lower() == "true")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], str(self.options.get("compress", "true")).lower() == "true",
                       int(self.options.get("file_bytes", 1 << 28)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull | IsNull):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[_File]:
        """One per archive: those of the manifest, or all in the folder where there is none."""
        fs, path = filesystem(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [_File(self.path)]
        if fs.get_file_info(f"{path}/manifest.json").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/manifest.json") as f:
                return [_File(f"{self.path}/{name}") for name in json.loads(f.read())["files"]]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        names = sorted(f.path[len(path):] for f in found if f.path.endswith((".warc", ".warc.gz")))
        return [_File(f"{self.path}{name}") for name in names]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            mine = row[column]
            good = {"EqualTo": lambda: mine == value, "In": lambda: mine in value, "StringStartsWith": lambda: mine is not None and mine.startswith(value),
                    "IsNotNull": lambda: mine is not None, "IsNull": lambda: mine is None}[kind]()
            if not good:
                return False
        return True

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:   # no file: an empty table
            return
        kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("record_date", pa.string()),
                           ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()),
                           ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

        def batch(rows: list[dict]) -> pa.RecordBatch:
            columns = {n: [list(r[n].items()) if pa.types.is_map(kinds.field(n).type) else r[n] for r in rows] for n in kinds.names}
            return pa.RecordBatch.from_pydict(columns, schema=kinds)

        fs, path = filesystem(partition.path)
        packed = path.endswith(".gz")
        with fs.open_input_file(path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw)
            rows, held = [], 0
            for row in parse(stream, self._wanted, self.payload, seekable=not packed):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, compress: bool, file_bytes: int):
        self.path, self.compress, self.file_bytes = path, compress, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        names: list[str] = []
        out, left = None, 0
        try:
            for batch in batches:
                for i in range(batch.num_rows):   # one row at a time: a batch may hold very long payloads
                    data = record_bytes({n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
                    if out is None or left <= 0:
                        if out:
                            out.close()
                        names.append(f"pages-{stem}-{len(names):04d}.warc{'.gz' * self.compress}")
                        out, left = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), self.file_bytes
                    out.write(gzip.compress(data, 6, mtime=0) if self.compress else data)
                    left -= len(data)
        finally:
            if out:
                out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"files": sorted(n for m in messages if m for n in m.names)}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{folder}/{name}")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits at a time are four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _page(record_id: str) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def write_warc(records: DataFrame, path: str, **options) -> None:
    records.sparkSession.dataSource.register(Warc)
    records.write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of SCHEMA; switches predicate pushdown for Python sources on, which Spark leaves off."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The record of each page (page_id, url, html).

    Of pages with one payload of at least ``min_bytes``, those with the largest page_id are
    responses and all others revisits of it. Only payloads that occur under several ids are
    joined back, so most pages are never shuffled.
    """
    rows = pages.select("page_id", F.col("url").alias("target_uri"), utf8("html").alias("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    shared = (rows.where(F.col("payload_length") >= min_bytes).groupBy("digest", "payload_length")
              .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 AND top IS NOT NULL").select("digest", "payload_length", "top"))
    joined = join_small(rows, stored(shared, "shared-payloads"), ["digest", "payload_length"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select(
        _record_id(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(None).cast("string").alias("record_date"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, _record_id(F.col("top"))).alias("refers_to"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, **options) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and read them back, one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri. Size and digest of
    a response are taken from the payload read back; a revisit has them in its headers.

    Defined results: a null html is an empty payload; a null url has no header and comes back
    null; a null page_id is a revisit where any copy has an id, else a response; rows that repeat
    the largest page_id are all responses; an empty table gives no rows.
    """
    write_warc(page_records(pages, min_bytes), path, **options)
    back = read_warc(pages.sparkSession, path)
    whole = F.col("record_type") == "response"
    return back.select(
        _page("record_id").alias("page_id"), F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", _page("refers_to").alias("refers_to"), "target_uri")
