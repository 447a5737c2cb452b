"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: a partition is one archive file; writers roll over at ``max_file_bytes``, so files stay small enough. Of every
record the headers are read first. Equality, ``IN`` and prefix predicates on record_type, record_id, target_uri,
refers_to and payload_digest are pushed down (``register`` switches that on) and decided on the headers; a record that
fails, and with option ``payload=false`` every record, is passed over without its payload being decoded: plain
archives by Content-Length, compressed ones by the member length that this writer puts into the gzip extra field.
Members of other writers without that field are inflated to find their end, but not kept.

Writing: a gzip member per record, files under unique names in a staging folder, moved into place at commit; a lost or
repeated task leaves nothing in the result. Paths go through pyarrow's file systems, so any shared store it knows will
do. Null payloads are empty, null target URIs and null identifiers leave their header out, control characters in URIs
are percent-encoded.
"""

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    StringStartsWith, WriterCommitMessage)

from tallysift.llm.common import small_side, stored
from tallysift.session import scratch_dir

SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, headers map<string,string>, payload binary")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([*((n, pa.string()) for n in NAMES[:5]), ("payload_length", pa.int64()),
                   ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Fixed names of the format.
HEADER = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
          "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header of the payload's full length, which a revisit record has no body to tell.
LENGTH = "X-Payload-Length"
HEAD_BYTES, BATCH_BYTES = 4096, 8 << 20


def hex_digest(value: str | None) -> str | None:
    """``sha1:BASE32`` as lower-case hex; other digests as they are."""
    if value and value.startswith("sha1:") and len(value) == 37:
        return base64.b32decode(value[5:]).hex()
    return value


def clean_uri(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def record(row: dict) -> bytes:
    """A WARC record, uncompressed. ``row``: columns of SCHEMA; further headers in ``headers``."""
    kind, payload = row["record_type"], row["payload"] or b""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["target_uri"] is not None:
        lines.append(("WARC-Target-URI", clean_uri(row["target_uri"])))
    if row["payload_digest"]:
        digest = row["payload_digest"]
        lines.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if kind == "revisit":
        lines += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", row["refers_to"])]
        payload = b""
    lines += [(LENGTH, str(length)), *((k, v) for k, v in row["headers"] or [] if v is not None)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ML holds the member's own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHQ", 12, b"ML", 8, size) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def member_length(head: bytes) -> int | None:
    """What the extra field ML says, if there is one."""
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    extra = head[12:12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        name, size = extra[:2], struct.unpack_from("<H", extra, 2)[0]
        if name == b"ML" and size == 8:
            return struct.unpack_from("<Q", extra, 4)[0]
        extra = extra[4 + size:]
    return None


def parse_headers(head: bytes) -> dict[str, str]:
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return out


def body_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a record's block: without the HTTP header where there is one."""
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(f, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records whose headers are ``wanted``. ``f``: a seekable file."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        head = f.read(min(HEAD_BYTES, size - at))
        if head[:2] == b"\x1f\x8b":
            inflate, length = zlib.decompressobj(31), member_length(head)
            data = inflate.decompress(head, HEAD_BYTES)
            # nothing is read beyond the headers' end: the body goes on with the unconsumed rest
            while b"\r\n\r\n" not in data and not inflate.eof and (raw := inflate.unconsumed_tail or f.read(HEAD_BYTES)):
                data += inflate.decompress(raw, HEAD_BYTES)
            if b"\r\n\r\n" not in data:
                raise ValueError(f"broken record at byte {at}")
            head, _, data = data.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            need = wanted(headers)
            keep = need and with_payload
            if length is None or keep:
                block = [data]
                while not inflate.eof:
                    raw = inflate.unconsumed_tail or f.read(1 << 16)
                    if not raw:
                        raise ValueError(f"the record at byte {at} ends too early")
                    part = inflate.decompress(raw, 1 << 20)
                    if keep:
                        block.append(part)
                if length is None:
                    length = f.tell() - len(inflate.unused_data) - at
                data = b"".join(block) if keep else b""
            at += length
            if need:
                n = int(headers.get("Content-Length", 0))
                yield headers, body_of(headers, data[:n]) if keep else None
        elif not head.strip():
            at += len(head)
        else:
            at += len(head) - len(head.lstrip())
            head = head.lstrip()
            while b"\r\n\r\n" not in head:
                more = f.read(HEAD_BYTES)
                if not more:
                    raise ValueError(f"broken record at byte {at}")
                head += more
            head, _, data = head.partition(b"\r\n\r\n")
            headers, begin = parse_headers(head), at + len(head) + 4
            n = int(headers.get("Content-Length", 0))
            if wanted(headers):
                if with_payload:
                    f.seek(begin)
                yield headers, body_of(headers, f.read(n)) if with_payload else None
            at = begin + n


def column(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(HEADER[name])
    return hex_digest(value) if name == "payload_digest" else value


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = dict(options), []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        where, path = fs.FileSystem.from_uri(self.options["path"])
        files = where.get_file_info(fs.FileSelector(path))
        return [ArchiveFile(f.path) for f in sorted(files, key=lambda f: f.path)
                if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))] or [ArchiveFile("")]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = column(headers, name)
            if own is None or not (own == value if kind == "EqualTo" else own in value if kind == "In"
                                   else own.startswith(value)):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        where, _ = fs.FileSystem.from_uri(self.options["path"])
        with_payload = self.options.get("payload", "true").lower() != "false"
        rows, held = [], 0
        with where.open_input_file(partition.path) as f:
            for headers, payload in records(f, self.wanted, with_payload):
                length = headers.get(LENGTH)
                rows.append({**{n: column(headers, n) for n in HEADER}, "headers": list(headers.items()), "payload": payload,
                             "payload_length": int(length) if length else None})
                held += len(payload or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options, self.run = dict(options), uuid.uuid4().hex

    def place(self):
        where, path = fs.FileSystem.from_uri(self.options["path"])
        return where, path.rstrip("/"), f"{path.rstrip('/')}/_staging-{self.run}"

    def write(self, iterator):
        where, _, staging = self.place()
        where.create_dir(staging, recursive=True)
        limit, level = int(self.options.get("max_file_bytes", 256 << 20)), int(self.options.get("level", 6))
        task, files, out, size = TaskContext.get(), [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= limit:
                    if out:
                        out.close()
                    files.append(f"part-{task.partitionId():06d}-{len(files):04d}-{uuid.uuid4().hex[:8]}.warc.gz")
                    out, size = where.open_output_stream(f"{staging}/{files[-1]}", compression=None), 0
                data = member(record(row), level)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        where, path, staging = self.place()
        where.create_dir(path, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                where.move(f"{staging}/{name}", f"{path}/{name}")
        self.abort(messages)
        where.open_output_stream(f"{path}/_SUCCESS", compression=None).close()

    def abort(self, messages):
        where, _, staging = self.place()
        if where.get_file_info(staging).type != fs.FileType.NotFound:
            where.delete_dir(staging)


class WarcDataSource(DataSource):
    """Format ``warc``. Options: path; payload (read: false leaves payloads out); max_file_bytes and level (write)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are never overwritten: write to a new folder")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least_bytes: int = 1000) -> DataFrame:
    """Pages as rows of SCHEMA. Of equal payloads of at least ``least_bytes`` the largest id is the response and the
    others revisit it; rows that repeat that id are responses too, null ids revisits unless all are null."""
    body = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    key = F.sha2("payload", 256)
    same = stored(body.where(F.octet_length("payload") >= least_bytes).groupBy(key.alias("key"))
                  .agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("key", "first"), "same")
    joined = body.withColumn("key", key).join(small_side(same), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def urn(c: str):
        return F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))

    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn("page_id"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.when(again, urn("first")).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"),
        F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string"),
                     F.lit("X-Refers-To-Page"), F.when(again, F.col("first").cast("string"))).alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None, level: int = 1, **columns) -> str:
    """Write the pages as archives; returns the folder (by default a new one on the shared scratch folder)."""
    register(pages.sparkSession)
    path = path or scratch_dir(pages.sparkSession, "warc")
    with_revisits(pages, **columns).write.format("warc").mode("append").option("level", level).save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
