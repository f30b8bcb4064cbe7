"""Record files: framed, checksummed records of named features, as a Spark data source.

A file is a run of records: length (8 bytes, little endian), checksum of the length, the record, its checksum. A record is a
message of features by name, each a list of byte strings, floats or integers. Files of one (rater, source, tag, principle)
are named after them, and the folder's manifest knows those keys, so readers that filter on keys don't open other files.
"""

from __future__ import annotations

import functools
import io
import struct
import urllib.parse
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from ratewell.sources import manifest, pushed, schemas

KEYS = ("rater", "conversation_source", "tag", "principle")
SCHEMA = schemas.EXAMPLE + ", split string"
#: Records that are checked and handed over at once.
BATCH = 2048
#: How files end that are compressed as a whole, as the format's own readers know them.
ZIPPED = ".records.gz"
#: Copies of a record that are handed to the file at once.
MOST_AT_ONCE = 64


class BrokenRecord(ValueError):
    """A checksum, a length or a feature that isn't what it has to be."""


# ---- checksums: CRC-32C, masked as the format wants it


def _table() -> np.ndarray:
    """Of CRC-32C (polynomial 82F63B78, reflected) for each byte."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(0x82F63B78), crc >> np.uint32(1)).astype(np.uint32)
    return crc


TABLE = _table()


def checksums(parts: Sequence[bytes]) -> np.ndarray:
    """Masked checksum of each part. Parts go side by side: one step per byte of the longest, whatever their number."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    data = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
    first = np.cumsum(sizes) - sizes
    crc = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    running = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # how many parts are longer than k
    for k, n in enumerate(running):
        crc[:n] = TABLE[(crc[:n] ^ data[first[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    crc = ~crc
    out = np.empty_like(crc)
    out[order] = ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
    return out


def framed_each(records: Sequence[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(r)) for r in records]
    heads, tails = checksums(lengths), checksums(records)
    return [b"".join((length, head.tobytes(), r, tail.tobytes())) for length, head, r, tail in zip(lengths, heads, records, tails, strict=True)]


def framed(records: Sequence[bytes]) -> bytes:
    return b"".join(framed_each(records))


@functools.lru_cache(4096)
def _length_checksum(length: bytes) -> bytes:
    return checksums([length])[0].astype("<u4").tobytes()


def unframed(stream: io.BufferedIOBase, name: str) -> Iterator[list[bytes]]:
    """The records of a file, some at a time; lengths and checksums are compared. Equal records are summed up once."""
    while True:
        records: list[bytes] = []
        tails: dict[tuple[bytes, bytes], None] = {}
        while len(records) < BATCH and (length := stream.read(8)):
            head = stream.read(4)
            if len(length) < 8 or head != _length_checksum(length):
                raise BrokenRecord(f"checksum of a length in {name}")
            n = struct.unpack("<Q", length)[0]
            record, tail = stream.read(n), stream.read(4)
            if len(record) < n or len(tail) < 4:
                raise BrokenRecord(f"{name} ends inside a record")
            records.append(record)
            tails[record, tail] = None
        if not records:
            return
        if (checksums([r for r, _ in tails]) != np.frombuffer(b"".join(t for _, t in tails), "<u4")).any():
            raise BrokenRecord(f"checksum of a record in {name}")
        yield records


# ---- records: features by name


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= 2**64 - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode(row: dict[str, object]) -> bytes:
    """A record of the features of a row, by name; each holds one value, and what is null isn't there."""
    out = b""
    for name, value in sorted(row.items()):
        if value is None:
            continue
        if isinstance(value, bool | int):
            feature = _field(3, _field(1, _varint(int(value))))
        elif isinstance(value, float):
            feature = _field(2, _field(1, struct.pack("<f", value)))
        else:
            feature = _field(1, _field(1, value.encode() if isinstance(value, str) else value))
        out += _field(1, _field(1, name.encode()) + _field(2, feature))
    return _field(1, out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, kind, value) of each field of a message: an integer, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise IndexError
        else:
            raise IndexError
        yield tag >> 3, kind, value


def _values(feature: bytes) -> list:
    """All values of a feature; lists of numbers may be packed or not."""
    out: list = []
    for form, _, body in _fields(feature):
        for _, kind, value in _fields(body):
            if form == 1:
                out.append(value)
            elif form == 2:
                out += struct.unpack(f"<{len(value) // 4}f", value)
            elif form == 3 and kind == 0:
                out.append(value)
            elif form == 3:
                at = 0
                while at < len(value):
                    n, at = _read_varint(value, at)
                    out.append(n)
    return [n - 2**64 if isinstance(n, int) and n >= 2**63 else n for n in out]


def decode(record: bytes, name: str) -> dict[str, list]:
    """Values of each feature of a record."""
    out: dict[str, list] = {}
    try:
        for _, _, features in _fields(record):
            for _, _, entry in _fields(features):
                parts = {number: body for number, _, body in _fields(entry)}
                out[parts[1].decode()] = _values(parts.get(2, b""))
    except (IndexError, KeyError, UnicodeDecodeError, struct.error) as e:
        raise BrokenRecord(f"no features in a record of {name}") from e
    return out


_KINDS = {StringType: bytes, BinaryType: bytes, LongType: int, IntegerType: int, FloatType: float, DoubleType: float}


def fixed(features: dict[str, list], schema: StructType, name: str) -> dict[str, object]:
    """One value for each column: a feature of a column that may not be null has to be there, with one value of its kind."""
    row = {}
    for f in schema.fields:
        values = features.get(f.name, [])
        if len(values) != 1 and not (f.nullable and not values) or values and not isinstance(values[0], _KINDS[type(f.dataType)]):
            raise BrokenRecord(f"feature {f.name} in a record of {name}: {values[:3]!r}")
        value = values[0] if values else None
        row[f.name] = value.decode() if isinstance(value, bytes) and isinstance(f.dataType, StringType) else value
    return row


# ---- the source


@dataclass
class Files(InputPartition):
    value: list[dict]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class RecordReader(DataSourceReader):
    """A partition for each file, or for several small ones; filters on keys leave files out before they are opened."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.most = schema, options["path"], int(options.get("partitionbytes", 128 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if pushed.supported(f, frozenset(KEYS)):
                self.filters.append(f)
            yield f  # a file from elsewhere may not say its keys, so Spark looks at its rows as well

    def partitions(self) -> list[InputPartition]:
        entries = manifest.files(self.path, (".records", ZIPPED))
        return [Files(part) for part in manifest.packed([e for e in entries if "keys" not in e or pushed.passes(self.filters, e["keys"])], self.most)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        store, _ = manifest.opened(self.path)
        for entry in partition.value if partition else []:
            with io.BufferedReader(store.open_input_stream(entry["name"], compression="gzip" if entry["name"].endswith(ZIPPED) else None), 1 << 20) as stream:
                for records in unframed(stream, entry["name"]):
                    rows = {r: fixed(decode(r, entry["name"]), self.schema, entry["name"]) for r in dict.fromkeys(records)}
                    yield pa.RecordBatch.from_pylist([rows[r] for r in records], schema)


class RecordWriter(DataSourceArrowWriter):
    """A file for each run of rows with equal keys in a task; all of them appear with the driver's commit, or none. A row with
    a column ``copies`` becomes as many records, which are encoded once. A file's size in the manifest is that of its records."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gzip = options["path"], options.get("compression") == "gzip"
        if not overwrite:
            manifest.refuse_existing(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = manifest.opened(self.path)
        store.create_dir(base, recursive=True)
        done: list[dict] = []
        out, keys = None, None

        def close() -> None:
            if out is not None:
                out.close()

        for batch in iterator:
            rows = batch.to_pylist()
            copies = [r.pop("copies", 1) for r in rows]
            at = 0
            while at < len(rows):
                own = {k: rows[at].get(k) for k in KEYS}
                to = at
                while to < len(rows) and to - at < BATCH and {k: rows[to].get(k) for k in KEYS} == own:
                    to += 1
                if own != keys:
                    close()
                    keys = own
                    name = ".".join(urllib.parse.quote(str(v), safe="") for v in own.values())[:150] + "-" + manifest.new_name(ZIPPED if self.gzip else ".records")
                    out = store.open_output_stream(f"{base}/{name}", compression="gzip" if self.gzip else None, buffer_size=1 << 20)
                    done.append({"name": name, "size": 0, "rows": 0, "keys": own})
                for data, n in zip(framed_each([encode(r) for r in rows[at:to]]), copies[at:to], strict=True):
                    for k in range(0, n, MOST_AT_ONCE):
                        out.write(data * min(MOST_AT_ONCE, n - k))
                    done[-1]["size"] += len(data) * n
                    done[-1]["rows"] += n
                at = to
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        manifest.commit(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages: list[Written | None]) -> None:
        manifest.discard(self.path, [f["name"] for m in messages if m for f in m.files])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def read(spark: SparkSession, path: str, schema: str | StructType = SCHEMA, partition_bytes: int | None = None) -> DataFrame:
    """Records of a file or folder. Columns of the schema are features with one value each; one that is declared ``not null``
    has to be in every record, others may be missing. Features that the schema doesn't name aren't looked at."""
    register(spark)
    most = partition_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("records").schema(schema).option("partitionBytes", most).load(path)


def write(examples: DataFrame, path: str, spread: int = 8, overwrite: bool = False, compression: str | None = None) -> None:
    """Examples as record files by KEYS. Rows meet by those keys and a part of ``spread`` of their cases, so a key with very
    many rows is several files, written by several tasks. The target must not be there, unless ``overwrite``. Rows with a
    column ``copies`` are shuffled once and written as often as it says. ``compression`` "gzip" makes compressed files: the
    prompts of one case stand together there and differ little."""
    if compression not in (None, "gzip"):
        raise ValueError(f"compression is gzip or None: {compression!r}")
    register(examples.sparkSession)
    dealt = examples.repartition(*KEYS, F.pmod(F.xxhash64("case_study_id"), F.lit(spread))).sortWithinPartitions(*KEYS, "case_study_id")
    dealt.write.format("records").mode("overwrite" if overwrite else "append").option("compression", compression or "none").save(path)
