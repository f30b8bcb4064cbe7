"""Archives: round trips, files written elsewhere, filters on headers, broken files; and revisits against a plain version."""

import base64
import gzip
import hashlib
import os

import pytest

from ratewell.llm import warc

SCHEMA = "page_id bigint, url string, html string, `a.b` string, sha string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA).repartition(parts)


def plain(rows, least=0):
    out, last = [], {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in rows:
        body = (h or "").encode()
        top = last.get(h or "")
        again = len(body) >= least and top is not None and (i is None or i < top)
        out.append((-1 if i is None else i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else -1))
    return sorted(out)


def found(df):
    return sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in df.collect())


ROWS = [
    (1, "http://a/1", "one"), (2, "http://a/2", "one"), (3, None, "ünï\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (4, "http://a/x\r\nWARC-Type: revisit\r\n\r\n", None), (5, "", ""), (6, "http://b", "one"),
    (6, "http://b", "one"), (None, "http://c", "one"), (None, "http://c", "alone"), (None, "http://c", "alone"), (-7, "http://d", "x" * 300_000), (8, "http://d", "x" * 300_000), *((100 + i, "http://hot", "hot") for i in range(400)),
]


@pytest.mark.parametrize("least", [0, 4])
def test_pages_equal_plain_version(spark, tmp_path, least):
    df = frame(spark, ROWS)
    assert found(warc.archived(df, str(tmp_path / "a"), least=least)) == plain(ROWS, least)
    responses = warc.read(spark, str(tmp_path / "a"), ("record_id", "uri", "payload", "type")).filter("type = 'response'").collect()
    texts = {(f"urn:page:{'' if i is None else i}", (h or "").encode()) for i, _, h in ROWS}
    kept = {(f"urn:page:{'' if i == -1 else i}", n) for i, n, _, kind, _ in plain(ROWS, least) if kind == "response"}
    assert {(r.record_id, bytes(r.payload)) for r in responses} == {t for t in texts if (t[0], len(t[1])) in kept}
    assert warc.read(spark, str(tmp_path / "a"), ("uri", "record_id")).filter("record_id = 'urn:page:4'").head().uri == "http://a/x%0D%0AWARC-Type: revisit%0D%0A%0D%0A"


def test_empty_table(spark, tmp_path):
    assert warc.archived(frame(spark, []), str(tmp_path / "e")).collect() == []


def test_files_roll_and_share_partitions(spark, tmp_path):
    path = str(tmp_path / "r")
    warc.write(warc.page_records(frame(spark, [(i, "u", f"page {i}") for i in range(200)], 1)), path, file_bytes=2000, compression="none")
    names = [f for f in os.listdir(path) if f.endswith(".warc")]
    assert len(names) > 10
    few, many = (warc.read(spark, path, ("record_id", "type"), partition_bytes=b).filter("type = 'response'") for b in (1 << 30, 1))
    assert few.count() == many.count() == 200 and few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == len(names)


def test_filters_are_judged_on_headers(spark, tmp_path):
    path = str(tmp_path / "f")
    warc.write(warc.page_records(frame(spark, ROWS)), path)
    df = warc.read(spark, path, ("record_id", "type", "uri", "refers_to", "payload"))
    plan = df.filter("type = 'revisit' and uri like 'http://hot%' and refers_to in ('urn:page:499', 'x') and not record_id = 'urn:page:100' and length(payload) > 9")._jdf.queryExecution().executedPlan().toString()
    assert "length(payload" in plan and "hot" not in plan and "revisit" not in plan
    assert df.filter("type = 'revisit' and uri like 'http://hot%' and not record_id = 'urn:page:100'").count() == 398
    assert df.filter("uri is null and type = 'response'").count() == 1
    assert df.filter("uri <> 'http://hot' and type <> 'warcinfo'").count() == len(ROWS) - 401


def test_payloads_nobody_wants_are_not_inflated(spark, tmp_path):
    path = str(tmp_path / "s.warc.gz")
    first = warc.member(warc.record_bytes({"record_id": "a", "type": "response", "content_type": "text/html", "http": None, "payload": os.urandom(50_000)}), 1)
    second = warc.member(warc.record_bytes({"record_id": "b", "type": "response", "content_type": "text/html", "http": None, "payload": b"good"}), 1)
    broken = bytearray(first)
    broken[20_000:40_000] = b"\xff" * 20_000
    with open(path, "wb") as f:
        f.write(bytes(broken) + second)
    assert [r.record_id for r in warc.read(spark, path, ("record_id",)).collect()] == ["a", "b"]
    assert [bytes(r.payload) for r in warc.read(spark, path, ("record_id", "payload")).filter("record_id = 'b'").collect()] == [b"good"]
    with pytest.raises(Exception, match="error|cut short|invalid"):
        warc.read(spark, path, ("record_id", "payload")).collect()


RECORD = (
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\n y\r\nContent-Type: application/http; msgtype=response\r\n"
    b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()) + b"\r\nContent-Length: 35\r\n\r\nHTTP/1.1 200 OK\r\nServer: z\r\n\r\nhello\r\n\r\n"
)


@pytest.mark.parametrize("name, data", [("a.warc", RECORD * 3), ("b.warc.gz", gzip.compress(RECORD) * 3), ("c.warc.gz", gzip.compress(RECORD * 3))])
def test_archives_from_elsewhere(spark, tmp_path, name, data):
    path = str(tmp_path / name)
    with open(path, "wb") as f:
        f.write(data)
    rows = warc.read(spark, path, verify=True).collect()
    assert [(r.type, r.uri, bytes(r.payload), r.payload_bytes, r.http, r.headers["warc-record-id"]) for r in rows] == [("response", "http://x/ y", b"hello", 5, "HTTP/1.1 200 OK\r\nServer: z\r\n", "<urn:uuid:1>")] * 3
    assert warc.read(spark, path, ("record_id",)).filter("record_id <> 'urn:uuid:1'").count() == 0


@pytest.mark.parametrize("data, what", [(RECORD.replace(b"hello", b"hallo"), "digest"), (b"junk\r\n\r\n" + RECORD, "no WARC record"), (RECORD[:-20], "ends inside"), (RECORD.replace(b"Content-Length: 35", b"Content-Length: x"), "no length")])
def test_broken_archives_are_errors(spark, tmp_path, data, what):
    path = str(tmp_path / "x.warc")
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match=what):
        warc.read(spark, path, verify=True).collect()


def test_a_failing_write_leaves_nothing_that_counts(spark, tmp_path):
    path, rows = str(tmp_path / "w"), warc.page_records(frame(spark, [(i, "u", f"p{i}") for i in range(50)]))
    failing = rows.withColumn("uri", warc.F.when(warc.F.col("record_id") == "urn:page:49", warc.F.raise_error(warc.F.lit("stop"))).otherwise(warc.F.col("uri")))
    with pytest.raises(Exception, match="stop"):
        warc.write(failing, path)
    assert not os.path.exists(f"{path}/_manifest.json")
    warc.write(rows, path, overwrite=True)
    assert warc.read(spark, path, ("type",)).filter("type = 'response'").count() == 50
    with pytest.raises(Exception, match="FileExistsError"):
        warc.write(rows, path)
    before = set(os.listdir(path))
    warc.write(rows.limit(5), path, overwrite=True)
    assert warc.read(spark, path, ("type",)).filter("type = 'response'").count() == 5
    listed = {e["name"] for e in warc.manifest.listed(path)}
    assert not listed & before
