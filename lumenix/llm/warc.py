"""WARC archives as a Spark data source: planned file partitions, header predicates, payloads decoded on demand.

Writing: one gzip member per record, so that records can be skipped; each member's extra field ``SL`` holds its
compressed and full length. Files roll over at ``roll_bytes``. A task writes under a temporary name and the
commit renames, so lost or repeated tasks leave nothing a reader sees.

Reading: files are packed into partitions of about ``split_bytes``; predicates on ``record_type``, ``record_id``,
``target_uri``, ``refers_to``, ``payload_digest``, ``payload_bytes`` are pushed down and tested on the headers
alone; only then (and only with option ``payload`` true) is the rest of a record decompressed. Archives by other
writers (no extra field, or not compressed) are read too.

Edge cases: null payloads are empty ones; null fields are left out of the header and read as null; an archive
folder without files gives no rows; truncated records raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenix.llm import common, groups

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
_FIELD = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length"}
_DATE = "2000-01-01T00:00:00Z"
_BLANKS = re.compile(r"[\r\n]+")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: bytes, body: bytes) -> bytes:
    """A gzip member with its own length in the extra field."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(head) + z.compress(body) + z.flush()
    size = 12 + 12 + len(packed) + 8
    extra = b"SL" + struct.pack("<HII", 8, size & 0xFFFFFFFF, (len(head) + len(body)) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(body, zlib.crc32(head)), (len(head) + len(body)) & 0xFFFFFFFF)


def render(record: dict) -> bytes:
    payload = record.get("payload") or b""
    kind = record.get("record_type") or "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    digest = record.get("payload_digest") or sha1_base32(payload)
    size = record["payload_bytes"] if record.get("payload_bytes") is not None else len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}"]
    for name in ("record_id", "target_uri", "refers_to"):
        if record.get(name) is not None:
            lines.append(f"{_FIELD[name]}: {_BLANKS.sub(' ', str(record[name]))}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return _member("\r\n".join(lines).encode(), block + b"\r\n\r\n")


# -- reading


class _Inflated:
    """The text of one gzip member, decompressed only as far as asked."""

    def __init__(self, source: "_Buffered"):
        self.source, self.z, self.out = source, zlib.decompressobj(31), b""

    def more(self, n: int) -> bool:
        """Get up to ``n`` more bytes; false at the end."""
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.source.take(1 << 14)
        if not data:
            raise EOFError("the archive ends within a record")
        self.out += self.z.decompress(data, n)
        return True

    def until(self, mark: bytes) -> int:
        at = self.out.find(mark)
        while at < 0:
            if not self.more(2048):
                raise EOFError("the archive ends within a record header")
            at = self.out.find(mark)
        return at

    def upto(self, n: int) -> bytes:
        parts = [self.out]
        have = len(self.out)
        while have < n:
            self.out = b""
            if not self.more(n - have):
                break
            parts.append(self.out)
            have += len(self.out)
        self.out = b"".join(parts)
        return self.out

    def drop(self) -> None:
        """Pass over the rest of the member without keeping it."""
        while not self.z.eof:
            self.out = b""
            self.more(1 << 16)
        self.source.back(self.z.unused_data)


class _Buffered:
    """A file with a position, read in large pieces."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.data, self.at, self.base = file, b"", 0, 0

    def take(self, n: int) -> bytes:
        if self.at >= len(self.data):
            self.base += len(self.data)
            self.data, self.at = self.file.read(1 << 20), 0
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def back(self, rest: bytes) -> None:
        if len(rest) <= self.at:
            self.at -= len(rest)
        else:
            self.seek(self.tell() - len(rest))

    def tell(self) -> int:
        return self.base + self.at

    def seek(self, to: int) -> None:
        if self.base <= to <= self.base + len(self.data):
            self.at = to - self.base
        else:
            self.file.seek(to)
            self.data, self.at, self.base = b"", 0, to

    def peek(self, n: int) -> bytes:
        here = self.tell()
        out = b""
        while len(out) < n and (x := self.take(n - len(out))):
            out += x
        self.seek(here)
        return out


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _fields(h: dict[str, str]) -> dict:
    digest = h.get("warc-payload-digest")
    size = h.get("warc-payload-length")
    return {
        "record_type": h.get("warc-type"),
        "record_id": h.get("warc-record-id"),
        "target_uri": h.get("warc-target-uri"),
        "refers_to": h.get("warc-refers-to"),
        "payload_digest": digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else digest,
        "payload_bytes": int(size) if size and size.isdigit() else None,
    }


def _payload(block: bytes, h: dict[str, str]) -> bytes:
    if h.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


def records(file: pa.NativeFile, wanted: list[tuple], payload: bool) -> Iterator[dict]:
    """Records whose headers meet ``wanted``; others are passed over undecoded."""
    source = _Buffered(file)
    while True:
        here = source.tell()
        lead = source.peek(24)
        if not lead:
            return
        if lead[:2] == b"\x1f\x8b":
            size = struct.unpack("<I", lead[16:20])[0] if lead[3] & 4 and lead[12:14] == b"SL" else 0
            member = _Inflated(source)
            end = member.until(b"\r\n\r\n")
            h = _headers(member.out[:end])
            row = _fields(h)
            if _meets(row, wanted):
                row["payload"] = None
                if payload:
                    n = int(h.get("content-length", 0))
                    block = member.upto(end + 4 + n)[end + 4 :][:n]
                    if len(block) < n:
                        raise EOFError("the archive ends within a record")
                    row["payload"] = _payload(block, h) if row["record_type"] != "revisit" else None
                yield row
            if size:
                source.seek(here + size)
            else:
                member.drop()
        else:
            raw = b""
            while (end := raw.find(b"\r\n\r\n")) < 0:
                if not (x := source.take(4096)):
                    if raw.strip():
                        raise EOFError("the archive ends within a record header")
                    return
                raw += x
            skip = len(raw) - len(raw.lstrip(b"\r\n"))
            if skip:
                source.seek(here + skip)
                continue
            h = _headers(raw[:end])
            n = int(h.get("content-length", 0))
            row = _fields(h)
            if _meets(row, wanted):
                row["payload"] = None
                if payload:
                    source.seek(here + end + 4)
                    parts = []
                    while n > sum(map(len, parts)) and (x := source.take(n - sum(map(len, parts)))):
                        parts.append(x)
                    block = b"".join(parts)
                    if len(block) < n:
                        raise EOFError("the archive ends within a record")
                    row["payload"] = _payload(block, h) if row["record_type"] != "revisit" else None
                yield row
            source.seek(here + end + 4 + n)


_TESTS = {
    "EqualTo": lambda a, b: a is not None and a == b,
    "In": lambda a, b: a is not None and a in b,
    "GreaterThan": lambda a, b: a is not None and a > b,
    "GreaterThanOrEqual": lambda a, b: a is not None and a >= b,
    "LessThan": lambda a, b: a is not None and a < b,
    "LessThanOrEqual": lambda a, b: a is not None and a <= b,
    "StringStartsWith": lambda a, b: a is not None and a.startswith(b),
    "StringEndsWith": lambda a, b: a is not None and a.endswith(b),
    "StringContains": lambda a, b: a is not None and b in a,
    "IsNull": lambda a, _: a is None,
    "IsNotNull": lambda a, _: a is not None,
}


def _meets(row: dict, wanted: list[tuple]) -> bool:
    return all(_TESTS[kind](row[name], value) for kind, name, value in wanted)


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.wanted: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            kind, name = type(f).__name__, f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if kind in _TESTS and name in _FIELD:
                self.wanted.append((kind, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [] if info.type == fs.FileType.NotFound else store.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Files] = []
        now, size = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path)), key=lambda f: f.path):
            if now and size + f.size > self.split:
                out.append(Files(tuple(now)))
                now, size = [], 0
            now.append(f.path)
            size += f.size
        return [*out, Files(tuple(now))] if now or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in records(file, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class Written(ds.WriterCommitMessage):
    paths: tuple[str, ...]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", 128 << 20))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        task, paths, out, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for batch in iterator:
                names = batch.schema.names
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or size > self.roll:
                        if out is not None:
                            out.close()
                        paths.append(f"{root}/part-{task:06d}-{len(paths):04d}-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(paths[-1] + ".tmp", compression=None), 0
                    data = render(dict(zip(names, values)))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(paths))

    def commit(self, messages: list) -> None:
        store, _ = self._store()
        for m in messages:
            for p in m.paths if m else ():
                store.move(p + ".tmp", p)

    def abort(self, messages: list) -> None:
        store, _ = self._store()
        for m in messages:
            for p in m.paths if m else ():
                if store.get_file_info(p + ".tmp").type == fs.FileType.File:
                    store.delete_file(p + ".tmp")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known and let its predicates be pushed down."""
    common.ensure_importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("warc").mode("append").save(path)


# -- pages

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex_sha1: Column) -> Column:
    """Bare base32 of 40 hexadecimal digits, in the JVM."""
    parts = []
    for k in range(4):
        v = F.conv(F.substring(hex_sha1, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(_ALPHABET), (F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*parts)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One record to be written per page: equal payloads of at least ``least_bytes`` revisit the one with the largest page_id.

    Groups are found on digests of the full payload (SHA-256 with its length), so payloads move once, to meet
    their record's type. Of repeated rows of the page that responds, all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    slim = common.materialize(keyed.distinct(), "digests")
    typed = groups.attach(slim, ["digest", "payload_bytes"], [F.max("page_id").alias("first_page")], row_salt=["page_id"])
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    typed = typed.select(
        F.col("page_id").alias("planned_page"),
        F.col("digest").alias("planned_digest"),
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first_page").cast("string"), F.lit(">"))).alias("refers_to"),
    )
    own = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    joined = own.join(typed, F.col("page_id").eqNullSafe(F.col("planned_page")) & (F.col("digest") == F.col("planned_digest")))
    return joined.select(
        "record_type",
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")).alias("record_id"),
        "target_uri",
        "refers_to",
        F.sha1("payload").alias("hex"),
        "payload_bytes",
        F.when(revisit_type(), F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    ).withColumn("payload_digest", base32_of_hex(F.col("hex"))).drop("hex")


def revisit_type() -> Column:
    return F.col("record_type") == "revisit"


def archive_round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as an archive under ``path``, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of responses are taken from the payloads read back; revisits are read by a second scan,
    whose predicate is pushed down and which decodes no payload.
    """
    spark = pages.sparkSession
    write(plan_records(pages, least_bytes), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    got = read(spark, path).where(F.col("record_type") == "response")
    got = got.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    again = read(spark, path, payload=False).where(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return got.unionByName(again).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
