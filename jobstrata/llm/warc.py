"""Web archives as a PySpark data source named `warc`.

Reading: path is an archive that this source wrote, any other folder (all .warc and .warc.gz files below it) or one file; each file is a
partition. Equality and IN predicates on record_type and on header columns are pushed down; headers are parsed first, and
the block of a record that a predicate drops is passed over by its length, never decoded. With option payload=false no
block is. In plain files such blocks aren't read either; .gz files (a member for each record, or one for all) are read through.
Headers that a record lacks are null, record_id and refers_to_id hold any writer's ids, page_id and refers_to those of this source.
A file that ends within a record, or has something else where a record should begin, is an error, never a shorter result.
Writing: each task writes files of its own; the list of the
files of tasks that succeeded is the commit, so files of lost tasks are never read.

A payload that has come before is written as a revisit: headers alone, with the digest and length of the whole payload.
Records are plain (no gzip of whole files, so that blocks can be passed over); payloads are gzip-coded HTTP bodies.

A null html is empty. Repeated rows of pages: both are written; of one page_id with equal payloads neither revisits the other.
An empty table gives an archive without records. Other columns of pages are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, stored

LEAST = 100
SCHEMA = "record_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long, record_id string, refers_to_id string, date string, content_type string, payload binary"
#: column -> WARC header
HEADERS = {"record_type": "WARC-Type", "page_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "record_id": "WARC-Record-ID", "refers_to_id": "WARC-Refers-To", "date": "WARC-Date", "content_type": "Content-Type"}
_TYPES = pa.schema([(c, pa.int64() if c in ("page_id", "refers_to", "payload_bytes") else pa.string()) for c in HEADERS] + [("payload", pa.binary())])
#: Digests met more than once that may be broadcast (some 200 bytes each).
BROADCAST_DIGESTS = 500_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n\r\n"
_BATCH = 8 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _number(urn: str | None) -> int | None:
    """The id in an urn of this source; none in any other."""
    kind, _, tail = (urn or "").strip("<>").rpartition(":")
    return int(tail) if kind == "urn:page" and tail.removeprefix("-").isdecimal() else None


def record_bytes(row: dict) -> bytes:
    """One record; a revisit has no payload."""
    block = b"" if row["record_type"] == "revisit" else _HTTP + gzip.compress(bytes(row["payload"] or b""), 1, mtime=0)
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["target_uri"] or "")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise EOFError("an HTTP body ends within a chunk")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes, content_type: str | None = "application/http") -> bytes:
    """The body of an HTTP message, decoded as its headers say (chunks, gzip, deflate; other codings stay); of other records the block."""
    if not (content_type or "").lower().startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if said.get(b"transfer-encoding") == b"chunked":
        body = _unchunked(body)
    if said.get(b"content-encoding") in (b"gzip", b"x-gzip", b"deflate") and body:
        return zlib.decompress(body, 47)
    return body


def _head(stream) -> dict | None:
    """The headers of the next record, by lower-case names; none at the end of the file."""
    while (line := stream.readline()) and not line.strip():
        pass
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    got, name = {}, None
    while (line := stream.readline()).strip():
        value = line.decode("utf-8", "replace")
        if value[0] in " \t" and name:
            got[name] += " " + value.strip()
        else:
            name, _, value = value.partition(":")
            name = name.strip().lower()
            got[name] = value.strip()
    if not line.endswith(b"\n") or not got.get("content-length", "").isdecimal():
        raise EOFError(f"the headers of a record are cut off or say no length: {got}")
    return got


def _whole(stream, length: int) -> bytes:
    """So many bytes, though a stream may give fewer at a time."""
    parts = []
    while length and (part := stream.read(length)):
        parts.append(part)
        length -= len(part)
    if length:
        raise EOFError(f"a record lacks {length} bytes")
    return b"".join(parts)


def records(stream, size: int | None, wanted, payload: bool) -> Iterator[dict]:
    """The records of a file, headers first; blocks that aren't wanted are passed over. size: of a plain file, None of a compressed one."""
    while (got := _head(stream)) is not None:
        length = int(got["content-length"])
        row = {c: got.get(h.lower()) for c, h in HEADERS.items()}
        ids = {c: row[c] and row[c].strip("<>") for c in ("record_id", "refers_to_id")}
        stated = row["payload_bytes"] or ""
        row |= ids | {"page_id": _number(row["page_id"]), "refers_to": _number(row["refers_to"]), "payload_digest": (row["payload_digest"] or "").removeprefix("sha256:") or None, "payload_bytes": int(stated) if stated.isdecimal() else None, "payload": None}
        keep = wanted(row)
        if keep and payload and length:
            row["payload"] = payload_of(_whole(stream, length), row["content_type"])
        elif size is not None:
            stream.seek(length, 1)
        else:
            for at in range(0, length, _BATCH):
                _whole(stream, min(_BATCH, length - at))
        if _whole(stream, 4) != b"\r\n\r\n":
            raise ValueError(f"no end where the length of record {row['record_id']} says")
        if keep:
            yield row


@dataclass
class Piece(InputPartition):
    path: str
    size: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "true").lower() == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        store, root = _place(self.path)
        here, list_ = store.get_file_info([root, f"{root}/_COMMITTED"])
        if list_.type == fs.FileType.File:
            with store.open_input_stream(list_.path) as s:
                found = [Piece(f"{root}/{name}", size) for name, size in json.loads(s.read())]
        elif here.type == fs.FileType.File:
            found = [Piece(here.path, here.size)]
        else:
            files = store.get_file_info(fs.FileSelector(root, recursive=True))
            found = [Piece(x.path, x.size) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        return found or [Piece("", 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.size:
            return
        store, _ = _place(self.path)
        wanted = lambda row: all(row[c] in values for c, values in self.tests)
        rows, mass = [], 0
        packed = piece.path.endswith(".gz")
        with store.open_input_file(piece.path) as raw, gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 16) as stream:
            for row in records(stream, None if packed else piece.size, wanted, self.payload):
                rows.append(row)
                mass += len(row["payload"] or b"") + 200
                if mass >= _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _TYPES)
                    rows, mass = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TYPES)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows) -> Written:
        store, root = _place(self.path)
        name, size, out = f"part-{uuid.uuid4().hex}.warc", 0, None
        for row in rows:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
            size += out.write(record_bytes(row.asDict()))
        if out is None:
            return Written([])
        out.close()
        return Written([(name, size)])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_COMMITTED") as s:
            s.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _place(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The records of pages: of equal payloads of `least` bytes or more, that with the smallest page_id is the response.

    Payloads never meet: minima are taken of narrow rows, and digests that come more than once are broadcast. If these are too many, the ids
    that have one are found by digest, and joined with the payloads by page_id and digest, so that a frequent page is spread.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("payload")).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    often = own.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    often = stored(often, "payloads")
    if often.count() <= BROADCAST_DIGESTS:
        both = own.join(F.broadcast(often), "payload_digest", "left")
    else:
        ids = own.select("page_id", "payload_digest").distinct().join(often, "payload_digest").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "first")
        both = own.join(ids, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return both.select(F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri", F.when(again, F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def archived(pages: DataFrame, path: str | None = None, least: int = LEAST) -> str:
    """Writes the archive of pages; the path of its folder."""
    path = path or new_path(pages.sparkSession, "warc")
    registered(pages.sparkSession)
    plan(pages, least).write.format("warc").mode("append").option("path", path).save()
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return registered(spark).read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def digest(archive: DataFrame) -> DataFrame:
    """What the archive says of each page; length and digest of a response are taken from its payload as read."""
    own = F.col("record_type") == "response"
    return archive.select("page_id", F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
