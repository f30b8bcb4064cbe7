"""WARC archives: a data source that reads and writes them, and pages archived with revisits for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ratewell.llm.texts import ensure_checkpoints, stored
from ratewell.sources import manifest, pushed, scratch

#: Fields of a record that stand in its WARC headers. Fixed values of the format.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "type": "WARC-Type",
    "uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "content_length": "Content-Length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/\d+\.\d+")
#: Values that stand in <> in a header.
_BRACKETED = ("record_id", "refers_to")

#: All columns; a reader fills those of its schema. payload_bytes: of the full payload, also where a revisit leaves it out.
#: http: the lines before the payload of an HTTP message. file, offset: where the record begins (in the file as it lies, or
#: in the inflated stream if its records aren't packed one by one).
SCHEMA = (
    "record_id string, type string, uri string, date string, content_type string, content_length bigint, payload_digest string, refers_to string, profile string, "
    "headers map<string,string>, http string, payload binary, payload_bytes bigint, file string, offset bigint"
)
#: What a record is written from. http: header lines of the message, ended by CRLF, null for none.
WRITTEN = "record_id string, type string, uri string, date string, content_type string, refers_to string, profile string, http string, payload binary"

#: Bytes of a member that are inflated to see a record's headers, and bytes read at once where a member's end isn't known.
PEEK, BLOCK = 4096, 1 << 16
#: Bytes of payload, and records, that a reader hands over at once.
BATCH, BATCH_ROWS = 8 << 20, 4096


class MalformedArchive(ValueError):
    """An archive that breaks its format, or a payload that isn't the one its digest names."""


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    value: list[dict]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Record:
    """Headers of a record; its block if it was asked for."""

    offset: int
    headers: dict[str, str]
    block: bytes | None = None
    fields: dict[str, object] = field(default_factory=dict)


def digest(payload: bytes) -> str:
    """SHA-1 in base 32, as archives name payloads."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- reading


def head_fields(headers: dict[str, str]) -> dict[str, object]:
    """The columns that stand in a record's headers (names in lower case), ready for filters."""
    out: dict[str, object] = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    for c in _BRACKETED:
        if out[c] is not None:
            out[c] = out[c].removeprefix("<").removesuffix(">")
    if out["payload_digest"] is not None:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    out["content_length"] = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else None
    return out


def parsed_head(lines: bytes) -> dict[str, str]:
    """Header lines by name, in lower case. A line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Wanted:
    """Which records to hand over, and whether with their blocks."""

    def __init__(self, filters: list[Filter], blocks: bool):
        self.filters, self.blocks = filters, blocks

    def record(self, offset: int, head: bytes, where: str) -> Record:
        first, _, lines = head.partition(b"\r\n")
        if not VERSION.fullmatch(first.strip()):
            raise MalformedArchive(f"no WARC record at {offset} of {where}: {first[:40]!r}")
        headers = parsed_head(lines)
        out = Record(offset, headers, fields=head_fields(headers))
        if out.fields["content_length"] is None:
            raise MalformedArchive(f"no length in the record at {offset} of {where}")
        return out

    def takes(self, record: Record) -> bool:
        return pushed.passes(self.filters, record.fields)


def _head(stream: BinaryIO) -> bytes:
    """Bytes up to the empty line; empty at the end of the stream. Empty lines before a record belong to the one before."""
    lines: list[bytes] = []
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            if lines:
                return b"".join(lines)
            continue
        lines.append(line)
    return b"".join(lines)


def _exactly(stream: BinaryIO, n: int, where: str) -> bytes:
    block = stream.read(n)
    if len(block) < n:
        raise MalformedArchive(f"{where} ends inside a record")
    return block


def plain_records(stream: BinaryIO, wanted: _Wanted, where: str) -> Iterator[Record]:
    """Records of a stream that isn't packed, or that is inflated as a whole. Blocks that nobody wants are skipped by
    seeking."""
    while True:
        at = stream.tell()
        head = _head(stream)
        if not head:
            return
        record = wanted.record(at, head, where)
        n = record.fields["content_length"]
        if not wanted.takes(record):
            stream.seek(n, io.SEEK_CUR)
        elif wanted.blocks:
            record.block = _exactly(stream, n, where)
            yield record
        else:
            stream.seek(n, io.SEEK_CUR)
            yield record


def member_sizes(start: bytes) -> tuple[int, int] | None:
    """(where the deflated bytes begin, length of the whole member) from the "sl" field that writers of archives put into a
    gzip header; None if it isn't there."""
    if len(start) < 12 or start[:3] != b"\x1f\x8b\x08" or not start[3] & 4:
        return None
    extra = struct.unpack("<H", start[10:12])[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(start)):
        size = struct.unpack("<H", start[at + 2 : at + 4])[0]
        if start[at : at + 2] == b"sl" and size == 8 and start[3] == 4:
            return end, struct.unpack("<I", start[at + 4 : at + 8])[0]
        at += 4 + size
    return None


def packed_records(stream: BinaryIO, wanted: _Wanted, where: str) -> Iterator[Record]:
    """Records of a gzip file. Where each member names its length, a record's headers are inflated first, and the rest only
    if it is wanted; otherwise the file is inflated from there on, as one stream."""
    while True:
        at = stream.tell()
        start = stream.read(PEEK)
        if not start:
            return
        sizes = member_sizes(start)
        if sizes is None:
            stream.seek(at)
            yield from plain_records(io.BufferedReader(gzip.GzipFile(fileobj=stream)), wanted, where)
            return
        begin, size = sizes
        inflate = zlib.decompressobj(-15)
        text = inflate.decompress(start[begin:size], PEEK)
        while b"\r\n\r\n" not in text:
            more = inflate.unconsumed_tail or stream.read(PEEK)
            if not more or inflate.eof:
                raise MalformedArchive(f"no end of headers at {at} of {where}")
            text += inflate.decompress(more, PEEK)
        head, _, rest = text.partition(b"\r\n\r\n")
        record = wanted.record(at, head + b"\r\n", where)
        if wanted.takes(record):
            if wanted.blocks:
                left = inflate.unconsumed_tail
                if stream.tell() < at + size:
                    left += stream.read(at + size - stream.tell())
                record.block = (rest + inflate.decompress(left))[: record.fields["content_length"]]
                if len(record.block) < record.fields["content_length"]:
                    raise MalformedArchive(f"the record at {at} of {where} is cut short")
            yield record
        stream.seek(at + size)


def split_message(record: Record) -> tuple[str | None, bytes]:
    """(HTTP header lines, payload) of a block; no lines if it is no HTTP message."""
    if not (record.fields["content_type"] or "").startswith("application/http"):
        return None, record.block
    head, _, payload = record.block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace") + "\r\n", payload


class WarcReader(DataSourceReader):
    """Plans a partition for files of about ``partitionbytes`` and filters on headers before a payload is touched."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("partitionbytes", 128 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if pushed.supported(f, frozenset(HEADERS)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Files(part) for part in manifest.packed(manifest.files(self.path, (".warc", ".warc.gz")), self.most)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        columns = set(self.schema.names)
        blocks = self.verify or bool(columns & {"http", "payload", "payload_bytes"})
        schema = to_arrow_schema(self.schema)
        rows, size = [], 0
        for entry in partition.value if partition else []:
            for record in self._records(entry["name"], _Wanted(self.filters, blocks)):
                row = record.fields | {"headers": list(record.headers.items()), "file": entry["name"], "offset": record.offset}
                if blocks:
                    row |= self._message(record, entry["name"])
                rows.append({c: row[c] for c in self.schema.names})
                size += len(record.block or b"") if "payload" in columns else 0
                if size >= BATCH or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, name: str, wanted: _Wanted) -> Iterator[Record]:
        store, _ = manifest.opened(self.path)
        with io.BufferedReader(store.open_input_file(name), BLOCK) as stream:
            yield from (packed_records if name.endswith(".gz") else plain_records)(stream, wanted, name)

    def _message(self, record: Record, name: str) -> dict[str, object]:
        http, payload = split_message(record)
        kind, said = record.fields["type"], record.headers.get("warc-payload-digest")
        if kind == "revisit":
            length = parsed_head((http or "").encode()).get("content-length", "")
            return {"http": http, "payload": None, "payload_bytes": int(length) if length.isdigit() else None}
        if self.verify and said and said.startswith("sha1:") and digest(payload) != said.removeprefix("sha1:"):
            raise MalformedArchive(f"the payload at {record.offset} of {name} isn't what its digest says")
        return {"http": http, "payload": payload, "payload_bytes": len(payload)}


# ---- writing


def _line(name: str, value: object) -> str:
    """A header line; line breaks in a value are percent-encoded, so that no value can end the header."""
    return f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def record_bytes(row: dict) -> bytes:
    """One record. The payload of a revisit stays out, but its digest is written, and its length is in the HTTP lines."""
    payload, http = row["payload"], row["http"]
    block = b"" if http is None else http.encode() + b"\r\n"
    if row["type"] != "revisit":
        block += payload or b""
    values = {c: row.get(c) for c in HEADERS} | {"content_length": len(block), "payload_digest": f"sha1:{digest(payload)}" if payload is not None else None}
    for c in _BRACKETED:
        values[c] = None if values[c] is None else f"<{values[c]}>"
    return ("WARC/1.1\r\n" + "".join(_line(h, values[c]) for c, h in HEADERS.items() if values[c] is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member whose header names its own length and that of its content, so that readers can step over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own, a new one after ``filebytes``; the driver's commit makes all of them count."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level = options["path"], int(options.get("level", 1))
        self.most, self.packed = int(options.get("filebytes", 64 << 20)), options.get("compression", "gzip") == "gzip"
        if not overwrite:
            manifest.refuse_existing(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = manifest.opened(self.path)
        store.create_dir(base, recursive=True)
        done, out, size, name = [], None, 0, ""

        def put(row: dict) -> int:
            raw = record_bytes(row)
            packed = self.packed and len(raw) < 2**31
            data = member(raw, self.level) if packed else gzip.compress(raw, self.level) if self.packed else raw
            out.write(data)
            return len(data)

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = manifest.new_name(".warc.gz" if self.packed else ".warc")
                    out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                    size = put({"record_id": f"urn:file:{name}", "type": "warcinfo", "content_type": "application/warc-fields", "http": None, "payload": b"format: WARC File Format 1.1\r\n"})
                size += put(row)
                if size >= self.most:
                    out.close()
                    done.append({"name": name, "size": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"name": name, "size": size})
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        manifest.commit(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages: list[Written | None]) -> None:
        manifest.discard(self.path, [f["name"] for m in messages if m for f in m.files])


class WarcSource(DataSource):
    """spark.read.format("warc"); options: see WarcReader and WarcWriter."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, verify: bool = False, partition_bytes: int | None = None) -> DataFrame:
    """Records of an archive: a file, or a folder of .warc and .warc.gz files.

    columns: those of SCHEMA that are needed. Without http, payload and payload_bytes among them no block is decoded.
    Filters on the columns in HEADERS are judged on a record's headers, before its block is read; others are left to Spark.
    verify: payloads are compared with their digests, and a difference is an error. A file goes to one task; small files
    share one of about partition_bytes (by default as the session reads its files).
    """
    register(spark)
    kinds = {c.split()[0]: c for c in SCHEMA.split(", ")}
    schema = ", ".join(kinds[c] for c in columns) if columns else SCHEMA
    most = partition_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("warc").schema(schema).option("verify", verify).option("partitionBytes", most).load(path)


def write(records: DataFrame, path: str, compression: str = "gzip", level: int = 1, file_bytes: int = 64 << 20, overwrite: bool = False) -> None:
    """Writes records (columns of WRITTEN, others are ignored, missing ones are null). All files appear at once, or none."""
    register(records.sparkSession)
    there = set(records.columns)
    kinds = [c.split() for c in WRITTEN.split(", ")]
    rows = records.select(*((F.col(c) if c in there else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
    rows.write.format("warc").option("compression", compression).option("level", level).option("fileBytes", file_bytes).mode("overwrite" if overwrite else "append").save(path)


# ---- pages


def page_urn(page: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))


def page_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("bigint")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record per page: of those with equal payloads of ``least`` bytes or more, the one with the largest id is a response,
    the others revisit it; smaller payloads are all responses.

    Payloads are the texts in UTF-8, a null text is empty. They are told apart by SHA-256. The largest id of each payload
    comes from partial sums, and only payloads that occur twice are joined back, from a written table, so that the payload
    of a third of all pages can be split. Rows that repeat the largest id are all responses, as are all of a payload whose
    ids are all null; other null ids revisit. A null URL is left out.
    """
    id_, url, text = (F.col(f"`{c}`") for c in (id_col, url_col, text_col))
    rows = pages.select(id_.cast("bigint").alias("page_id"), url.cast("string").alias("uri"), F.coalesce(text, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    again = stored(groups.filter("n > 1 and last is not null").select("sha", "last"))
    joined = rows.join(again, "sha", "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    return joined.select(
        page_urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.when(revisit, page_urn(F.col("last"))).alias("refers_to"), F.when(revisit, IDENTICAL).alias("profile"), http.alias("http"), "payload",
    )


def archived(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the pages written to an archive and read back, with
    every payload compared with its digest.

    path: where the archive stays; without one it is written beside the session's checkpoints and goes with the driver. An
    empty table gives an empty archive. More: see page_records().
    """
    spark = pages.sparkSession
    ensure_checkpoints(spark)
    path = path or scratch.folder(spark)
    write(page_records(pages, **how), path)
    back = read(spark, path, ("record_id", "type", "payload_digest", "refers_to", "payload_bytes"), verify=True).filter(F.col("type").isin("response", "revisit"))
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))
