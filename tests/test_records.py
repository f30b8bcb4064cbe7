"""Record files: checksums, features, keys that leave files unopened, and writes that fail."""

import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.sources import manifest, records

ROWS = [("sleep", f"c{i}", f"v{i}", "in\n\té" * (i % 5), "5. out<stop>", f"Primary {'AB'[i % 2]}", "base/model", ["insight", "etiology"][i % 3 == 0], "readable", i - 3, "train") for i in range(60)]


@pytest.fixture()
def examples(spark):
    return spark.createDataFrame(ROWS, records.SCHEMA).repartition(3)


def plain_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    assert plain_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF  # the check value of CRC-32C
    parts = [os.urandom(n) for n in (0, 1, 8, 300, 299, 8, 0)]
    assert records.checksums(parts).tolist() == [plain_crc(p) for p in parts]
    assert records.checksums([]).tolist() == []


def test_features():
    row = {"s": "é", "b": b"\x00\xff", "n": -3, "big": 2**62, "f": 0.5, "gone": None, "e": ""}
    assert records.decode(records.encode(row), "x") == {"s": ["é".encode()], "b": [b"\x00\xff"], "n": [-3], "big": [2**62], "f": [0.5], "e": [b""]}
    # As other writers pack numbers: a list of two integers, a list of two floats.
    packed = records._field(3, records._field(1, records._varint(7) + records._varint(-1)))
    floats = records._field(2, records._field(1, struct.pack("<ff", 1.5, -2.0)))
    record = records._field(1, records._field(1, records._field(1, b"n") + records._field(2, packed)) + records._field(1, records._field(1, b"f") + records._field(2, floats)))
    assert records.decode(record, "x") == {"n": [7, -1], "f": [1.5, -2.0]}
    # Byte by byte: the features, one entry, its key "a", its value, a list of integers, packed, 1.
    assert records.encode({"a": 1}).hex(" ") == "0a 0c 0a 0a 0a 01 61 12 05 1a 03 0a 01 01"
    with pytest.raises(records.BrokenRecord):
        records.decode(b"\x0a\xff\x01", "x")


def test_round_trip_and_pruning(spark, examples, tmp_path):
    path = str(tmp_path / "r")
    records.write(examples, path)
    back = records.read(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    listed = manifest.listed(path)
    assert sum(e["rows"] for e in listed) == 60 and {tuple(e["keys"].values()) for e in listed} == {(r[5], r[6], r[7], r[8]) for r in ROWS}
    for e in listed:  # only files of other keys are broken: they aren't opened
        if e["keys"]["tag"] != "etiology":
            with open(os.path.join(path, e["name"]), "r+b") as f:
                f.seek(14)
                f.write(b"\xff\xff")
    some = back.filter("tag = 'etiology' and rater like 'Primary%' and rating > 0")
    assert sorted(r.rating for r in some.collect()) == sorted(r[9] for r in ROWS if r[7] == "etiology" and r[9] > 0)
    with pytest.raises(Exception, match="checksum of a record"):
        back.collect()


def test_broken_files_are_errors(spark, tmp_path):
    good = records.framed([records.encode({"s": "abc", "n": 1}), records.encode({"s": "x" * 50, "n": 2})])
    for data, what in [(good[:-3], "ends inside"), (b"\x01" + good[1:], "checksum of a length"), (good[:20] + b"?" + good[21:], "checksum of a record")]:
        (tmp_path / "x.records").write_bytes(data)
        with pytest.raises(Exception, match=what):
            records.read(spark, str(tmp_path / "x.records"), "s string, n bigint").collect()
    (tmp_path / "x.records").write_bytes(good)
    assert [tuple(r) for r in records.read(spark, str(tmp_path), "n bigint, s string, other double").collect()] == [(1, "abc", None), (2, "x" * 50, None)]
    for schema in ("n bigint, other double not null", "n string", "s bigint"):
        with pytest.raises(Exception, match="feature"):
            records.read(spark, str(tmp_path), schema).collect()


def test_a_write_that_fails_leaves_no_files_that_count(spark, examples, tmp_path):
    path = str(tmp_path / "w")
    with pytest.raises(Exception, match="stop"):
        records.write(examples.withColumn("targets", F.when(F.col("rating") == 40, F.raise_error(F.lit("stop"))).otherwise(F.col("targets"))), path)
    assert manifest.listed(path) is None
    records.write(examples, path, overwrite=True)
    with pytest.raises(Exception, match="FileExistsError"):
        records.write(examples, path)
    records.write(examples.filter("rating < 0"), path, overwrite=True)
    assert records.read(spark, path).count() == 3
    records.write(examples.limit(0), str(tmp_path / "empty"))
    assert records.read(spark, str(tmp_path / "empty")).count() == 0


def test_a_key_with_many_rows_is_several_files(spark, tmp_path):
    df = spark.createDataFrame([(*r[:5], "Primary A", "base_model", "insight", "readable", *r[9:]) for r in ROWS], records.SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records.write(df, str(tmp_path / "h"), spread=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest.listed(str(tmp_path / "h"))) > 1 and np.sum([e["rows"] for e in manifest.listed(str(tmp_path / "h"))]) == 60


def test_copies_are_written_as_often_as_they_say(spark, examples, tmp_path):
    """Compressed files of rows with copies: every record is there, and equal ones take hardly any room."""
    path = str(tmp_path / "z")
    records.write(examples.withColumn("inputs", F.concat("inputs", F.repeat(F.md5("case_study_id"), 60))).withColumn("copies", F.lit(200).cast("bigint")), path, compression="gzip")
    back = records.read(spark, path)
    assert back.count() == 60 * 200 and back.distinct().count() == 60
    listed = manifest.listed(path)
    assert sum(e["rows"] for e in listed) == 60 * 200 and all(e["name"].endswith(".records.gz") for e in listed)
    stored = sum(os.path.getsize(os.path.join(path, e["name"])) for e in listed)
    assert sum(e["size"] for e in listed) > 60 * 200 * 32 * 60 and stored < sum(e["size"] for e in listed) / 50
    with open(os.path.join(path, listed[0]["name"]), "rb") as f:
        assert len(gzip.decompress(f.read())) == listed[0]["size"]
    with pytest.raises(ValueError, match="compression"):
        records.write(examples, str(tmp_path / "y"), compression="lz4")
