"""WARC archives as a PySpark data source.

Writing takes rows of SCHEMA. Digests are bare hex SHA-1 in rows, ``sha1:`` and base 32 in archives.
Each task writes one file of gzip members, one per record, each with its own compressed
size in the member's extra field (subfield ``sl``), so that a reader can skip it unread. The names of the
files whose tasks succeeded, with a place to start about every ``SPLIT`` bytes, go into a list when the job commits; files
of failed attempts aren't in it and are never read.

Reading plans a partition per listed piece of a file (or per file, for archives without a list). For each record only the
headers are inflated first. Equality and membership filters on ``warc_type`` and on the other header columns
are pushed down: a record that fails them is skipped by its stated size, its payload neither read nor inflated (a
foreign member without a stated size is inflated to find its end, but not decoded). ``payload=false`` leaves payloads out too.

Null payloads are written as empty ones, null header fields left out; values are written as they are, but for line ends, which are
dropped. Repeated rows are repeated records. Header names are read without regard to case, folded lines are joined, and HTTP headers are
cut off blocks of ``application/http`` alone; any other block is its own payload. A record with broken headers ends the task with an
error that names file and place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from reviewloom.llm.common import bounded, shared_folder

SCHEMA = (
    "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns and the WARC headers that hold them.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LIST, SPLIT = "records.json", 8 << 20
SMALLEST_REVISIT = 1000
CHUNK = 1 << 16


def one_line(value: str) -> str:
    """A header's value: as it is, but for line ends, which would end the header, and blanks around it."""
    return value.replace("\r", "").replace("\n", "").strip(" \t")


def named_fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name: any blanks around the value, folded lines joined, the first of a repeated name."""
    joined: list[str] = []
    for line in lines:
        if line[:1] in (" ", "\t") and joined:
            joined[-1] += " " + line.strip(" \t")
        else:
            joined.append(line)
    found: dict[str, str] = {}
    for line in joined:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip(" \t").lower(), value.strip(" \t"))
    return found


def bare_digest(stated: str) -> str:
    """Lower-case hex of a SHA-1 stated in base 32 or hex; other algorithms as stated."""
    algorithm, colon, value = stated.partition(":")
    if not colon or algorithm.lower() != "sha1":
        return stated
    return base64.b32decode(value, casefold=True).hex() if len(value) == 32 else value.lower()


def place(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url else f"file://{url}")


def member(record: bytes) -> bytes:
    """A gzip member with its sizes in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = 10 + 2 + 4 + 8
    extra = b"sl" + struct.pack("<HII", 8, head + len(body) + 8, len(record) & 0xFFFFFFFF)
    start = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return start + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


#: Content types of blocks that are not HTTP messages; other types than these are written as octets.
CONTENT_TYPES = {"warcinfo": "application/warc-fields", "metadata": "application/warc-fields"}


def record(row: dict) -> bytes:
    """A response with its payload, a revisit with the HTTP headers alone, or a record of another type with its block as it is."""
    payload, kind = bytes(row["payload"] or b""), row["warc_type"]
    revisit = kind == "revisit"
    block, content_type = payload, CONTENT_TYPES.get(kind, "application/octet-stream")
    if kind in ("response", "revisit", None):
        size = row["payload_bytes"] if revisit and row["payload_bytes"] is not None else len(payload)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        block, content_type = http if revisit else http + payload, "application/http; msgtype=response"
    digest = row["payload_digest"] or hashlib.sha1(payload).hexdigest()
    if ":" not in digest:  # one with its algorithm is written as it is
        digest = f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
    lines = ["WARC/1.1"]
    lines += [f"{HEADERS[c]}: {one_line(row[c])}" for c in HEADERS if c != "payload_digest" and row[c] is not None]
    lines += [f"WARC-Payload-Digest: {one_line(digest)}", f"WARC-Date: {DATE}"]
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = place(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        store.create_dir(folder)
        starts, size = [], 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for row in (row for batch in batches for row in batch.to_pylist()):
                if not starts or size - starts[-1] >= SPLIT:
                    starts.append(size)
                packed = member(record(row))
                out.write(packed)
                size += len(packed)
        return Written(name, starts, size)

    def commit(self, messages: list) -> None:
        store, folder = place(self.path)
        store.create_dir(folder)
        listed = [{"name": m.name, "starts": m.starts, "size": m.size} for m in messages if m and m.size]
        with store.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps(listed).encode())


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    stop: int | None

    def __init__(self, file: str, start: int, stop: int | None):
        self.file, self.start, self.stop = file, start, stop


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        store, folder = place(self.path)
        if store.get_file_info(f"{folder}/{LIST}").type == fs.FileType.File:
            with store.open_input_stream(f"{folder}/{LIST}") as file:
                listed = json.loads(file.read())
            return [
                Piece(x["name"], a, b)
                for x in listed
                for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)
            ]
        found = store.get_file_info(fs.FileSelector(folder))
        return [Piece(f.base_name, 0, None) for f in found if f.base_name.endswith((".warc.gz", ".warc"))]

    def wanted(self, row: dict) -> bool:
        return all(row[name] in values for name, values in self.tests)

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # an archive without files
            return
        store, folder = place(self.path)
        rows, size = [], 0
        with store.open_input_file(f"{folder}/{piece.file}") as file:
            stop = file.size() if piece.stop is None else piece.stop
            at = piece.start
            while at < stop:
                try:
                    row, at = self.one(file, at)
                except (ValueError, KeyError, zlib.error, struct.error) as e:
                    raise ValueError(f"no WARC record in {piece.file} at {at}: {e}") from e
                if row is None:
                    continue
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def one(self, file, at: int) -> tuple[dict | None, int]:
        """The record at ``at`` (None if it isn't wanted), and where the next one is."""
        file.seek(at)
        data = file.read(CHUNK)
        inflater, packed_size = None, None
        if data[:2] == b"\x1f\x8b":
            inflater = zlib.decompressobj(31)
            if data[3] & 4:
                extra = data[12 : 12 + struct.unpack("<H", data[10:12])[0]]
                if extra[:2] == b"sl":
                    packed_size = struct.unpack("<I", extra[4:8])[0]
        plain, pending = b"", data
        while (end := plain.find(b"\r\n\r\n")) < 0:  # headers first, a little at a time
            if inflater is None:
                plain, pending = plain + pending, file.read(CHUNK)
            else:
                plain += inflater.decompress(pending or file.read(CHUNK), 2048)
                pending = inflater.unconsumed_tail
            if not pending and file.tell() >= file.size() and plain.find(b"\r\n\r\n") < 0:
                raise ValueError("the headers don't end")
        version, *lines = plain[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"it begins with {version[:20]!r}")
        fields = named_fields(lines)
        length, head = int(fields["content-length"]), end + 4
        row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
        if version == "WARC/1.0" and (row["target_uri"] or "")[:1] == "<":  # that version's grammar has brackets
            row["target_uri"] = row["target_uri"].strip("<>")
        if row["payload_digest"]:
            row["payload_digest"] = bare_digest(row["payload_digest"])
        is_http = fields.get("content-type", "").lower().startswith("application/http")
        need = head + length + 4
        wanted = self.wanted(row)
        if inflater is None:
            following = at + need
            if not wanted:
                return None, following
            file.seek(at)
            plain = file.read(need)
        elif not wanted and packed_size:
            return None, at + packed_size
        else:
            parts, got = [plain], len(plain)
            enough = need if self.payload or not packed_size else head
            # Without payloads, only the HTTP headers of the block are still of interest.
            while not inflater.eof and (got < enough or not packed_size or (enough < need and is_http and b"\r\n\r\n" not in b"".join(parts)[head:])):
                more = inflater.decompress(pending or file.read(CHUNK), 1 << 20)
                pending = inflater.unconsumed_tail
                got += len(more)
                if wanted:
                    parts.append(more)
            plain = b"".join(parts)
            following = at + packed_size if packed_size else file.tell() - len(inflater.unused_data)
            if not wanted:
                return None, following
        http_end = plain.find(b"\r\n\r\n", head, head + length) if is_http else -1
        body = http_end + 4 if http_end >= 0 else head + length if is_http else head
        row["payload_bytes"] = head + length - body
        if row["warc_type"] == "revisit":  # its block has no payload; its headers may say how long that was
            http = named_fields(plain[head : max(http_end, head)].decode("latin-1").split("\r\n"))
            stated = http.get("content-length", "")
            row["payload_bytes"] = int(stated) if stated.isascii() and stated.isdigit() else None
        row["payload"] = None
        if self.payload and row["warc_type"] != "revisit":
            row["payload"] = plain[body : head + length]
        return row, following


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.record_batch({c: pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in COLUMNS})


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounded(spark).dataSource.register(Warc)
    return spark


def page_records(pages: DataFrame, smallest: int = SMALLEST_REVISIT, salts: int = 32) -> DataFrame:
    """Records for rows of ``pages`` (page_id, url, html): of equal payloads the one with the largest id is kept whole.

    Only payloads that repeat are joined with their groups, over ``salts`` parts each, so that a payload
    which a third of the pages have is dealt to many tasks.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    groups = (
        rows.where(F.col("payload_bytes") >= smallest)
        .groupBy(F.col("digest"))
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    rows = rows.join(groups, ["digest", "salt"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, name("kept")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str | None = None) -> str:
    """Write a record per page below ``folder`` (a fresh shared one by default), and say where."""
    spark = registered(pages.sparkSession)
    folder = folder or shared_folder(spark)
    page_records(pages).write.format("warc").mode("append").save(folder)
    return folder


def load(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    return registered(spark).read.format("warc").option("payload", str(payload).lower()).load(folder)
