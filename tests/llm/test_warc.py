import gzip
import hashlib

import duckdb
import pytest

from reviewloom.llm import warc
from reviewloom.llm.queries import PAGES_SQL, REGISTRY

ROWS = [
    (1, "http://a", "x" * 2000), (2, "http://b\r\nc %0A", "x" * 2000), (3, None, None), (4, "u", ""), (5, "u", "é" * 600),
    (7, "u", "é" * 600), (6, "u", "short"), (8, "u", "short"), (9, "v", "z" * 3_000_000), (1, "dup", "x" * 2000),
    (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (13, " é", "a\x00b" * 500),
]


@pytest.fixture(scope="module")
def folder(spark, table, tmp_path_factory):
    df = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id long, url string, html string, digest string, n int")
    return table(tmp_path_factory.mktemp("pages"), pages=df.repartition(3))


def plain(rows):
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in rows)


def test_query_against_sql(spark, folder):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    cursor = connection.execute(PAGES_SQL)
    columns = [d[0] for d in cursor.description]
    got = REGISTRY["op4_warc"](spark, folder).select(*columns).collect()
    assert plain(got) == plain(cursor.fetchall())


def test_round_trip(spark, folder):
    at = warc.archive(spark.read.parquet(f"{folder}/pages.parquet"))
    got = warc.load(spark, at).collect()
    kept = {r.record_id: r for r in got if r.warc_type == "response"}
    # A header's value has no line ends; all else comes back as it was.
    uris = {"http://b\r\nc %0A": "http://bc %0A"}
    for page, url, html in ROWS:
        row = kept.get(f"<urn:page:{page}>")
        if row is not None and page != 1:
            assert (row.target_uri, row.payload.decode()) == (uris.get(url, url), html or "")
            assert row.payload_digest == hashlib.sha1((html or "").encode()).hexdigest()
    revisits = [r for r in got if r.warc_type == "revisit"]
    assert {r.refers_to for r in revisits} == {"<urn:page:2>", "<urn:page:7>"} and all(r.payload is None for r in revisits)


def test_predicates_are_pushed_down(spark, folder):
    at = warc.archive(spark.read.parquet(f"{folder}/pages.parquet"))
    some = warc.load(spark, at).where("warc_type = 'revisit' and record_id in ('<urn:page:1>', '<urn:page:5>')")
    assert "revisit" not in some._jdf.queryExecution().executedPlan().toString()  # no filter is left above the scan
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:1>", "<urn:page:1>", "<urn:page:5>"]
    assert warc.load(spark, at).where("payload_bytes > 2000").count() == 1
    assert all(r.payload is None for r in warc.load(spark, at, payload=False).collect())


def test_unwanted_payloads_are_not_read(tmp_path):
    rows = [{"warc_type": t, "record_id": t, "target_uri": None, "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"q" * 9_000_000} for t in ("response", "resource")]
    packed = [warc.member(warc.record(r)) for r in rows]
    packed[0] = packed[0][:3000] + bytes(len(packed[0]) - 3000)  # no inflating gets through this
    (tmp_path / "x.warc.gz").write_bytes(b"".join(packed))
    reader = warc.Reader(str(tmp_path), True)
    reader.tests = [("warc_type", frozenset(["resource"]))]
    (piece,) = reader.partitions()
    (batch,) = reader.read(piece)
    assert batch["payload"].to_pylist() == [b"q" * 9_000_000]


def test_foreign_archives(spark, tmp_path):
    row = {"warc_type": "response", "record_id": "r", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"p" * 200_000}
    other = row | {"record_id": "s", "payload": b""}
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.record(row)) + gzip.compress(warc.record(other)))
    (tmp_path / "b.warc").write_bytes(warc.record(other) + warc.record(row))
    got = warc.load(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == [("r", 200_000)] * 2 + [("s", 0)] * 2
    assert warc.load(spark, str(tmp_path)).where("record_id = 's'").count() == 2


def test_packed_records_are_plain_gzip():
    row = {"warc_type": "response", "record_id": "r", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"abc"}
    assert gzip.decompress(warc.member(warc.record(row))) == warc.record(row)


def test_empty_and_broken(spark, tmp_path, folder):
    at = warc.archive(spark.read.parquet(f"{folder}/pages.parquet").limit(0))
    assert warc.load(spark, at).count() == 0
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nno end")
    with pytest.raises(Exception, match="no WARC record in x.warc at 0"):
        warc.load(spark, str(tmp_path)).collect()


def test_large_files_are_split(monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SPLIT", 300)
    writer = warc.Writer(str(tmp_path))
    rows = [{"warc_type": "response", "record_id": str(i), "target_uri": None, "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"p"} for i in range(20)]
    import pyarrow as pa

    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    batch = pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(warc.COLUMNS, types)], warc.COLUMNS)
    writer.write(iter([batch]))  # a failed attempt: its file is in no list
    writer.commit([writer.write(iter([batch])), None])
    reader = warc.Reader(str(tmp_path), True)
    pieces = reader.partitions()
    assert len(pieces) > 5
    assert [r for p in pieces for b in reader.read(p) for r in b["record_id"].to_pylist()] == [str(i) for i in range(20)]


def foreign(fields, block, version="WARC/1.1"):
    return f"{version}\r\n{fields}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_addresses_are_not_altered(spark, tmp_path):
    uris = ["http://a/?x=100%25", "http://a/%0A%0D%250A", "http://a/%25c?u=%7E", "http://é/ü%zz"]
    at = str(tmp_path)
    rows = [("response", f"<r:{i}>", u, None, None, None, b"x") for i, u in enumerate(uris)]
    spark.createDataFrame(rows, warc.SCHEMA).write.format("warc").mode("append").save(at)
    assert {r.target_uri for r in warc.load(spark, at).collect()} == set(uris)
    inside = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("*.gz"))
    assert all(f"WARC-Target-URI: {u}\r\n".encode() in inside for u in uris)
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "f.warc").write_bytes(b"".join(foreign(f"WARC-Type: resource\r\nWARC-Target-URI: {u}", b"") for u in uris))
    assert {r.target_uri for r in warc.load(spark, str(tmp_path / "foreign")).collect()} == set(uris)


def test_other_records_keep_their_blocks(spark, tmp_path):
    block = b"software: x\r\nformat: WARC\r\n\r\nrest: \xff\r\n"
    kinds = ["warcinfo", "resource", "metadata", "conversion"]
    own, other = tmp_path / "own", tmp_path / "foreign"
    spark.createDataFrame([(k, k, None, None, None, None, block) for k in kinds], warc.SCHEMA).write.format("warc").mode("append").save(str(own))
    other.mkdir()
    data = [foreign(f"WARC-Type: {k}\r\nWARC-Record-ID: {k}\r\nContent-Type: text/plain", block) for k in kinds]
    (other / "f.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    for folder in (own, other):
        got = warc.load(spark, str(folder)).collect()
        assert {r.record_id: (bytes(r.payload), r.payload_bytes) for r in got} == {k: (block, len(block)) for k in kinds}
        sizes = warc.load(spark, str(folder), payload=False).collect()
        assert all(r.payload is None and r.payload_bytes == len(block) for r in sizes)


def test_header_variants(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"h" * 9000 + b"\r\n\r\n"
    hexed = hashlib.sha1(b"body").hexdigest()
    first = "warc-type:response\r\nWARC-RECORD-ID: \t<a> \r\nwarc-target-uri: http://a/\r\n\tb\r\nContent-type:application/http;msgtype=response"
    data = [
        foreign(first + f"\r\nWARC-Payload-Digest: sha1:{hexed.upper()}", http + b"body"),
        foreign("WARC-Type: response\r\nWARC-Record-ID: <b>\r\nWARC-Target-URI: <http://b/>\r\nContent-Type: application/http"
                "\r\nWARC-Payload-Digest: md5:00", b"HTTP/1.1 304 Not Modified\r\n", "WARC/1.0"),
        foreign("WARC-Type: revisit\r\nWARC-Record-ID: <c>\r\nContent-Type: application/http", b"HTTP/1.1 200 OK\r\ncontent-length:77\r\n\r\n"),
    ]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(warc.member(d) for d in data))
    got = {r.record_id: r for r in warc.load(spark, str(tmp_path)).collect()}
    assert (got["<a>"].target_uri, bytes(got["<a>"].payload), got["<a>"].payload_digest) == ("http://a/ b", b"body", hexed)
    assert (got["<b>"].target_uri, bytes(got["<b>"].payload), got["<b>"].payload_digest) == ("http://b/", b"", "md5:00")
    assert (got["<c>"].payload, got["<c>"].payload_bytes) == (None, 77)
    sizes = warc.load(spark, str(tmp_path), payload=False).collect()
    assert {r.record_id: r.payload_bytes for r in sizes} == {"<a>": 4, "<b>": 0, "<c>": 77}
    with pytest.raises(Exception, match="no WARC record"):
        (tmp_path / "bad.warc").write_bytes(b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n")
        warc.load(spark, str(tmp_path)).collect()
