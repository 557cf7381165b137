"""WARC archives as a Spark data source, and an archive of pages without repeated payloads.

``spark.read.format("warc")`` plans partitions from whole files, small ones packed together. A record's WARC headers
are read first; pushed filters on the record type and on header columns are decided on them, and the rest of a record
that is not wanted, or whose payload no column asks for, is stepped over: plain records by their length, compressed
ones by the length in their gzip header (our writer sets it; elsewhere the record is inflated and thrown away).
Files are opened with Arrow's file systems, so a path may be local or in any store that Arrow opens.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..session import cut_lineage, shared_folder
from .common import ship_by_value

#: Columns taken from WARC headers alone, then those that need the start or the whole of a record's block.
HEADER_COLUMNS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_COLUMNS) + ", status int, payload_length bigint, payload binary, file string, offset bigint"
#: A file is closed at about this size; files are packed into partitions of this size; bytes and rows of a batch.
ROLL_BYTES, PACK_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 64 << 20, 8 << 20, 500
#: Bytes read at once; payloads shorter than this are always stored whole.
CHUNK, LEAST_REVISIT = 1 << 16, 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ----------------------------------------------------------------- records as bytes


def _value(text: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC/1.1 record; headers that are None are left out."""
    lines = [f"{k}: {_value(v)}\r\n" for k, v in headers.items() if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)


def member(data: bytes) -> bytes:
    """A gzip member that says its own length: extra field ``GL``, 8 bytes."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return struct.pack("<4BIBBH2sHQ", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"GL", 8, 24 + len(body) + len(tail)) + body + tail


def http_block(payload: bytes | None, length: int) -> bytes:
    """Response headers with the length of the whole payload; a revisit has the headers only."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")


class Tape:
    """A file read forward, in chunks, with steps over what is not wanted."""

    def __init__(self, file):
        self.file, self.size, self.at, self.buffer = file, file.size(), 0, b""

    def peek(self, n: int) -> bytes:
        if len(self.buffer) < n:
            self.buffer += self.file.read(max(n - len(self.buffer), CHUNK))
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at, self.buffer = self.at + len(out), self.buffer[len(out) :]
        if len(out) < n:
            raise EOFError
        return out

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise EOFError
        held = min(n, len(self.buffer))
        self.buffer = self.buffer[held:]
        if n > held:
            self.file.seek(self.at + n)
        self.at += n


class Plain:
    """Bytes of one uncompressed record."""

    def __init__(self, tape: Tape):
        self.tape = tape

    def start(self, n: int) -> bytes:
        return self.tape.peek(n)

    def finish(self, length: int) -> None:
        self.tape.skip(length)

    def whole(self, length: int) -> bytes:
        return self.tape.take(length)


class Squeezed:
    """Bytes of one record in a gzip member, inflated as far as somebody asks."""

    def __init__(self, tape: Tape):
        self.tape, self.inflate, self.got, self.fed = tape, zlib.decompressobj(31), b"", 0
        first = tape.peek(24)
        told = len(first) == 24 and first[3] & 4 and first[12:16] == b"GL\x08\0"
        self.length = struct.unpack("<Q", first[16:24])[0] if told else None

    def _more(self, most: int) -> bytes:
        """Up to ``most`` further bytes of the record; none at its end."""
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                left = CHUNK if self.length is None else self.length - self.fed
                raw = self.tape.peek(min(CHUNK, left)) if left else b""
                if not raw:
                    raise EOFError
                self.tape.take(len(raw))
                self.fed += len(raw)
            out = self.inflate.decompress(raw, most)
            if self.inflate.eof and (rest := self.inflate.unused_data):
                self.tape.buffer, self.tape.at = rest + self.tape.buffer, self.tape.at - len(rest)
            if out:
                return out
        return b""

    def start(self, n: int) -> bytes:
        while len(self.got) < n and (more := self._more(n - len(self.got))):
            self.got += more
        return self.got[:n]

    def finish(self, length: int) -> None:
        if self.length is not None:
            self.tape.skip(self.length - self.fed)
        else:
            while self._more(CHUNK):
                pass

    def whole(self, length: int) -> bytes:
        parts, n = [self.got], len(self.got)
        while n < length and (more := self._more(length - n)):
            parts.append(more)
            n += len(more)
        if n < length:
            raise EOFError
        while self._more(CHUNK):  # to the check sum behind the last byte
            pass
        self.finish(0)
        return b"".join(parts)


def _head(source: Plain | Squeezed, skip: int = 0) -> tuple[bytes, int]:
    """Header lines that begin ``skip`` bytes in, and where they end."""
    n = 1024
    while True:
        data = source.start(skip + n)
        end = data.find(b"\r\n\r\n", skip)
        if end >= 0:
            return data[skip:end], end + 4
        if len(data) < skip + n:
            return b"", -1
        n *= 2


def fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def plain_digest(value: str | None) -> str | None:
    """``sha1:`` in Base32 or hexadecimal as bare lower-case hexadecimal; others as they stand."""
    if value and value.lower().startswith("sha1:"):
        value = value[5:]
        if len(value) == 32:
            return base64.b32decode(value.upper()).hex()
        return value.lower()
    return value


def read_records(tape: Tape, wanted, columns: list[str]) -> Iterator[list]:
    """Values of ``columns`` of the records whose header columns ``wanted`` accepts."""
    block_start = {"status", "payload_length", "payload"} & set(columns)
    while tape.peek(2):
        if tape.peek(2) == b"\r\n":  # between plain records
            tape.skip(2)
            continue
        offset = tape.at
        source = Squeezed(tape) if tape.peek(2) == b"\x1f\x8b" else Plain(tape)
        try:
            head, at = _head(source)
            if not head.startswith(b"WARC/"):
                raise ValueError("no record begins")
            got = fields(head)
            row = {c: got.get(h.lower()) for c, h in HEADER_COLUMNS.items()}
            row["record_id"], row["refers_to"] = (x and x.strip("<>") for x in (row["record_id"], row["refers_to"]))
            row["payload_digest"] = plain_digest(row["payload_digest"])
            length = int(got["content-length"])
            whole = at + length + 4
            if not wanted(row):
                source.finish(whole)
                continue
            row |= {"status": None, "payload_length": length, "payload": None, "offset": offset}
            if block_start:
                is_http = (row["content_type"] or "").lower().startswith("application/http")
                inner, begin = _head(source, at) if is_http and length else (b"", at)
                if is_http and 0 <= begin <= at + length:
                    line = inner.split(b"\r\n", 1)[0].split()
                    row["status"] = int(line[1]) if len(line) > 1 and line[1].isdigit() else None
                    told = fields(inner).get("content-length", "")
                    row["payload_length"] = int(told) if told.isdigit() else at + length - begin
                else:
                    begin = at
                if "payload" in columns:
                    row["payload"] = source.whole(whole)[begin : at + length]
                else:
                    source.finish(whole)
            else:
                source.finish(whole)
        except (EOFError, KeyError, ValueError, zlib.error) as bad:
            raise ValueError(f"damaged record at byte {offset}: {bad!r}") from bad
        yield [row.get(c) for c in columns]


# ----------------------------------------------------------------- the data source


_COMPARE = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
    StringContains: lambda a, b: b in a,
}


def decided(f: Filter, row: dict) -> bool | None:
    """Value of a filter on header columns, NULL like in SQL."""
    if isinstance(f, Not):
        inner = decided(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull | IsNotNull):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    return None if value is None else _COMPARE[type(f)](value, f.value)


def on_headers(f: Filter) -> bool:
    if isinstance(f, Not):
        return on_headers(f.child)
    known = isinstance(f, IsNull | IsNotNull | EqualNullSafe) or type(f) in _COMPARE
    return known and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS and getattr(f, "value", "") is not None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def archive_files(path: str) -> list[tuple[str, int]]:
    """Files of an archive with their sizes: those that finished jobs have listed, else all WARC files below the path."""
    store, base = opened(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    lists = [f.path for f in found if f.base_name.startswith("_files-")]
    if lists:
        return sorted((f"{base}/{name}", size) for x in lists for name, size in json.loads(store.open_input_stream(x).readall()))
    return sorted((f.path, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if on_headers(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, held = [], 0
        for path, size in archive_files(self.path):
            if not out or held + size > PACK_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = opened(self.path)[0]
        columns = self.schema.names
        kinds = {"status": pa.int32(), "payload_length": pa.int64(), "payload": pa.binary(), "offset": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in columns])
        rows, held = [], 0
        blob = columns.index("payload") if "payload" in columns else None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in read_records(Tape(file), lambda r: all(decided(f, r) for f in self.filters), columns):
                    if "file" in columns:
                        row[columns.index("file")] = path
                    rows.append(row)
                    held += len(row[blob] or b"") if blob is not None else 0
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, record_id, target_uri, date, payload_digest, refers_to, payload_length, payload) as records.

    Every attempt of a task writes files of its own; the list that the finished job leaves names those that count.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{base}/{name}", compression=None), 0
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row["date"], "Content-Type": "application/warc-fields"}
                    size += out.write(member(record(info, b"format: WARC File Format 1.1\r\n")))
                size += out.write(member(self.one(row)))
                if size >= ROLL_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    @staticmethod
    def one(row: dict) -> bytes:
        revisit = row["record_type"] == "revisit"
        payload = row["payload"] or b""
        length = row["payload_length"] if row["payload_length"] is not None else len(payload)
        return record(
            {
                "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"],
                "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "WARC-Profile": REVISIT if revisit else None,
                "WARC-Refers-To": f"<{row['refers_to']}>" if row["refers_to"] is not None else None, "Content-Type": "application/http;msgtype=response",
            },
            http_block(None if revisit else payload, length),
        )

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        older = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("_files-")] if self.overwrite else []
        with store.open_output_stream(f"{base}/_files-{uuid.uuid4().hex}") as out:
            out.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for path in older:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            store.delete_file(f"{base}/{name}")


class WarcSource(DataSource):
    """``warc``; a schema given by the reader of a subset of the columns keeps the others from being decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session and let its filters reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def read_warc(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Records of an archive; with ``columns`` only what these need is read."""
    reader = register(spark).read.format("warc")
    if columns:
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows with the columns that ``WarcWriter`` names (others are left out); a task writes its own files."""
    register(records.sparkSession)
    names = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload_length", "payload")
    records.select(*names).write.format("warc").mode("append").save(path)


# ----------------------------------------------------------------- pages


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One record per page; of equal payloads of ``LEAST_REVISIT`` bytes and more the one with the largest page_id is kept.

    Payloads are equal when their SHA-256 is. Groups are found on hashes alone, and only those with two rows and
    more are joined back, so payloads move only where such groups are too many to broadcast.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("bigint"))
    long = rows.filter(F.col("payload_length") >= LEAST_REVISIT).select(F.sha2("payload", 256).alias("same"), "page_id")
    kept = long.groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 AND kept IS NOT NULL")
    kept = cut_lineage(kept.select("same", "kept"))
    rows = rows.join(kept, (F.sha2("payload", 256) == F.col("same")) & (F.col("payload_length") >= LEAST_REVISIT), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.sha1("payload").alias("payload_digest"), F.when(revisit, name("kept")).alias("refers_to"), "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive and read it back: one row per page.

    ``page_id``, ``payload_bytes`` and ``payload_digest`` (of the bytes read for a response, of the headers for a
    revisit, whose payload is not stored), ``record_type``, ``refers_to``. A NULL html is an empty payload. Rows with the
    largest page_id of their group are all responses, should that id be repeated; a NULL page_id never is the largest
    and comes back as NULL, and a group of such rows alone has only responses. A NULL url has no header. Other columns
    are ignored. An empty table gives an archive without records. ``path`` defaults to a new folder among the
    intermediate tables.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/growthlens/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path)
    back = read_warc(spark, path, "record_type", "record_id", "payload_digest", "refers_to", "payload_length", "payload")
    back = back.filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    response = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


ship_by_value(__name__)
