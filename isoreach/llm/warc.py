"""WARC archives as a Spark data source: a file planner, a header-first reader and a writer.

    register(spark)
    spark.read.format("warc").load(folder).filter("warc_type = 'response'").select("target_uri", "payload")
    records.write.format("warc").mode("append").save(folder)

The folder is anything that Arrow's file systems open: a path or a URI.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from isoreach.llm.locators import join_counted, located, place, split_by_filter
from isoreach.llm.storage import written

SCHEMA = (
    "warc_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, http_headers string, payload_length long, payload binary"
)

#: The named fields of the format that are columns of their own.
HEADER_OF = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
_COLUMN_OF = {name.lower(): column for column, name in HEADER_OF.items()}
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_FLUSH = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


# ---------------------------------------------------------------- writing


def header_value(value: str) -> str:
    """A field's value on one line: control characters and blanks percent-encoded."""
    return _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", value)


def record_bytes(row: dict[str, Any]) -> bytes:
    """One record. Its block is an HTTP response head that states the length of the full payload, followed by
    the payload unless the record is a revisit."""
    payload = row["payload"] or b""
    whole = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = row["http_headers"] or (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {whole}\r\n\r\n"
    )
    block = http.encode() + (b"" if row["warc_type"] == "revisit" else payload)
    fields = [f"{name}: {header_value(row[column])}" for column, name in HEADER_OF.items() if row[column] is not None]
    if row["warc_type"] == "revisit":
        fields.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *fields, "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field ``sl`` states its own length and the record's, so readers can pass over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return (
        b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body
        + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    )


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


#: Files of a write, which count if the manifest of that write names them, and manifests.
_OF_WRITE = re.compile(r"part-([0-9a-f]{32})-[0-9a-f]{32}\.warc\.gz")
_MANIFEST = re.compile(r"_written-([0-9a-f]{32})")


class WarcWriter(DataSourceArrowWriter):
    """Tasks write files under their last names; the driver adds one manifest of those that count.

    No file is renamed, which object stores could only do by copying. Files of failed or repeated attempts
    are named by no manifest, so the reader passes over them.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path = options["path"]
        self.limit = int(options.get("maxfilebytes", 1 << 28))
        self.level = int(options.get("compressionlevel", 3))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    member = gzip_member(record_bytes(row), self.level)
                    if out is not None and size + len(member) > self.limit:
                        out.close()
                        out = None
                    if out is None:
                        names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(names)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        old = []
        if self.overwrite:
            there = [(f.path, f.base_name) for f in system.get_file_info(pafs.FileSelector(folder)) if self.job not in f.base_name]
            old = [path for path, name in there if _MANIFEST.fullmatch(name)]
            old += [path for path, name in there if name.startswith("part-")]
        names = [name for message in messages if message for name in message.names]
        with system.open_output_stream(f"{folder}/_written-{self.job}", compression=None) as out:
            out.write("".join(f"{name}\n" for name in names).encode())
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        system, folder = _open(self.path)
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            for f in system.get_file_info(pafs.FileSelector(folder)):
                if f.base_name.startswith(f"part-{self.job}-"):
                    system.delete_file(f.path)


# ---------------------------------------------------------------- reading


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        self.paths = paths
        self.value = paths


class _Members:
    """Reads records from a file, compressed per record or not, telling whether the payload is wanted."""

    def __init__(self, stream: Any) -> None:
        self.raw = io.BufferedReader(stream, 1 << 20)

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes, bytes | None]]:
        """(fields, HTTP head, payload or null) of each record that ``wanted(fields)`` does not refuse.

        ``wanted`` says None to pass over a record, False to leave its payload and True for all of it.
        """
        while magic := self.raw.peek(2)[:2]:
            if magic == b"\x1f\x8b":
                yield from self._member(wanted)
            elif magic[:1] in b"\r\n":
                self.raw.read(1)
            else:
                yield from self._one(self.raw, wanted, self._skip)

    def _skip(self, size: int) -> None:
        self.raw.seek(size, 1)

    def _member(self, wanted) -> Iterator[tuple[dict[str, str], bytes, bytes | None]]:
        begin = self.raw.tell()
        head = self.raw.read(10)
        length = 0
        if head[3] & 4:
            extra = self.raw.read(struct.unpack("<H", self.raw.read(2))[0])
            at = 0
            while at + 4 <= len(extra):
                size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if extra[at : at + 2] == b"sl" and size == 8:
                    length = struct.unpack("<I", extra[at + 4 : at + 8])[0]
                at += 4 + size
        if head[3] & ~4 or not length:
            # Written elsewhere: no length of the member is known, so it is inflated to find its end. What is
            # refused is dropped as it comes, and a member may hold many records.
            self.raw.seek(begin)
            body = _Inflater(self.raw, None)
            while not body.at_end():
                yield from self._one(body, wanted, body.skip)
            return
        body = _Inflater(self.raw, begin + length - 8 - self.raw.tell())
        yield from self._one(body, wanted, lambda _: None)
        self.raw.seek(begin + length)

    @staticmethod
    def _one(stream, wanted, skip) -> Iterator[tuple[dict[str, str], bytes, bytes | None]]:
        if not stream.readline().startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, str] = {}
        last = None
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        size, answer = int(fields.get("content-length", 0)), wanted(fields)
        if answer is None:
            if skip:
                skip(size + 4)
            return
        http = b""
        if fields.get("content-type", "").startswith("application/http"):
            lines = []
            while size - sum(map(len, lines)) > 0:
                lines.append(stream.readline())
                if lines[-1] in (b"\r\n", b"\n"):
                    break
            http = b"".join(lines)
        rest = size - len(http)
        if answer:
            yield fields, http, stream.read(rest)
            rest = 0
        else:
            yield fields, http, None
        if skip:
            skip(rest + 4)


class _Inflater:
    """A compressed member, inflated only as far as it is read.

    ``size`` is the length of its compressed body, from whose start ``raw`` is read; None reads a whole member,
    head and all, up to its own end, behind which ``raw`` then stands.
    """

    def __init__(self, raw: io.BufferedReader, size: int | None) -> None:
        self.raw, self.left, self.held = raw, size, b""
        self.inflate = zlib.decompressobj(16 + zlib.MAX_WBITS if size is None else -zlib.MAX_WBITS)

    def _next(self, limit: int) -> bytes | None:
        """At most ``limit`` more bytes, perhaps none yet; None at the end."""
        if self.inflate.eof:
            return None
        tail = self.inflate.unconsumed_tail
        if not tail:
            tail = self.raw.read(1 << 16 if self.left is None else min(self.left, 1 << 16))
            if not tail:
                # A last call may hold inflated bytes back that take no more input.
                rest = self.inflate.decompress(b"", limit)
                if not rest and self.left is None and not self.inflate.eof:
                    raise EOFError("a compressed record is cut off")
                return rest or None
            if self.left is not None:
                self.left -= len(tail)
        data = self.inflate.decompress(tail, limit)
        if self.inflate.eof and self.left is None:
            self.raw.seek(-len(self.inflate.unused_data), 1)
        return data

    def readline(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0:
            data = self._next(1 << 12)
            if data is None:
                at = len(self.held) - 1
                break
            self.held += data
        line, self.held = self.held[: at + 1], self.held[at + 1 :]
        return line

    def read(self, size: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < size and (data := self._next(size - have)) is not None:
            parts.append(data)
            have += len(data)
        whole = b"".join(parts)
        self.held = whole[size:]
        return whole[:size]

    def skip(self, size: int) -> None:
        """Passes over bytes without holding more than a piece of them."""
        while size > 0:
            if not self.held:
                self.held = self._next(1 << 16)
                if self.held is None:
                    self.held = b""
                    return
            part = min(size, len(self.held))
            self.held, size = self.held[part:], size - part

    def at_end(self) -> bool:
        """Whether nothing but line ends follows, over which it passes."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return False
            data = self._next(1 << 12)
            if data is None:
                return True
            self.held = data


class WarcReader(DataSourceReader):
    """Plans partitions of whole files of some ``partitionbytes`` together. Of files that a ``WarcWriter`` wrote into
    a folder, those that a manifest there names are read; a file that is named itself is read in any case.

    Filters ``column = value`` and ``column IN (values)`` on the columns of ``HEADER_OF`` are decided on the
    header of a record alone; the rest of a refused record is passed over unread. The option ``payload``
    set to ``false`` leaves all payloads out, and ``types`` names the record types to read.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", 1 << 25))
        self.payload = options.get("payload", "true").lower() != "false"
        self.allowed: dict[str, set[str]] = {}
        if types := options.get("types"):
            self.allowed["warc_type"] = {t.strip() for t in types.split(",")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in HEADER_OF:
                yield f
                continue
            values = {str(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
            self.allowed[name] = values & self.allowed[name] if name in self.allowed else values

    def partitions(self) -> list[Files]:
        system, folder = _open(self.path)
        info = system.get_file_info(folder)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(folder, recursive=True))
        found = [f for f in found if f.type == pafs.FileType.File]
        named = set()
        for f in found:
            if _MANIFEST.fullmatch(f.base_name):
                with system.open_input_stream(f.path, compression=None) as manifest:
                    named.update(f.path.removesuffix(f.base_name) + name for name in manifest.read().decode().split())
        files = sorted(
            (f.path, f.size)
            for f in found
            if f.base_name[0] not in "_."
            and f.base_name.endswith((".warc", ".warc.gz"))
            and (f.path in named or info.type == pafs.FileType.File or not _OF_WRITE.fullmatch(f.base_name))
        )
        parts: list[list[str]] = []
        room = 0
        for path, size in files:
            if not parts or room < size:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(path)
            room -= size
        return [Files(tuple(p)) for p in parts] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        system, _ = _open(self.path)

        def wanted(fields: dict[str, str]) -> bool | None:
            for column, values in self.allowed.items():
                if fields.get(HEADER_OF[column].lower()) not in values:
                    return None
            return self.payload and fields.get("warc-type") != "revisit"

        rows: list[dict[str, Any]] = []
        held = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for fields, http, payload in _Members(file).records(wanted):
                    row = {column: fields.get(name) for name, column in _COLUMN_OF.items()}
                    row |= {"http_headers": http.decode("utf-8", "replace") or None, "payload": payload}
                    row["payload_length"] = _stated_length(fields, http)
                    rows.append(row)
                    held += len(payload or b"") + 500
                    if held > _FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _stated_length(fields: dict[str, str], http: bytes) -> int:
    """Length of the full payload: what follows the HTTP head, or for a revisit what the head says."""
    if fields.get("warc-type") == "revisit":
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return int(stated[1]) if stated else 0
    return int(fields.get("content-length", 0)) - len(http)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in SCHEMA.split(", "))])


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``warc`` known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages

#: Rows of Parquet that a task holds at once, and bytes of rows that go to Python at once. By itself Spark takes 4,096
#: and 10,000 rows, whatever their size: of long pages more than a task's memory. Vectored reads take a whole column of
#: a row group a second time, outside the heap.
_BOUNDS = {
    "spark.sql.parquet.columnarReaderBatchSize": 128,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "parquet.hadoop.vectored.io.enabled": "false",
}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts tasks hold a few pages at once; bounds that the session sets itself stay as they are."""
    unset = [name for name in _BOUNDS if spark.conf.get(name, None) is None]
    for name in unset:
        spark.conf.set(name, _BOUNDS[name])
    try:
        yield
    finally:
        for name in unset:
            spark.conf.unset(name)


def page_records(pages: DataFrame, *, least_bytes: int = 1000, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Records of (page_id, url, html): of equal payloads of at least ``least_bytes`` one response, else revisits.

    The response is the row with the largest page_id; rows that repeat that very id are responses as well,
    and so are rows without an id that share a payload with no other. A null html is an empty payload, a
    null url a record without a target; a payload of any length is one value. Other columns are not read, whatever their names.

    Revisits are found on ids, digests and locators, which are stored when this is called. Payloads stay
    where they are, but for the revisits and few others that pass a filter of their locators; these are dealt
    by locator, so that a payload which many rows share goes to many tasks. Where pages are long, call this and
    write its rows within ``small_batches``.
    """
    there = located(pages.select("page_id", "url", "html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    file, row = place(there)
    narrow = written(
        there.select(F.col("page_id").alias("page"), F.sha1(payload).alias("digest"), F.length(payload).alias("n"), file.alias("file"), row.alias("row"))
        .filter(F.col("n") >= least_bytes)
        .drop("n"),
        "digests",
    )
    shared = written(
        narrow.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("many"))
        .filter((F.col("many") > 1) & F.col("first").isNotNull()),
        "shared",
    )
    total = shared.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    some, _ = split_by_filter(narrow, shared.select("digest"), "digest")
    met = join_counted(some, shared, "digest", "many", total)
    revisits = written(met.filter(~F.col("first").eqNullSafe(F.col("page"))).select("file", "row", "first"), "revisits")
    rows = there.select(F.col("page_id").alias("page"), "url", payload.alias("payload"), file.alias("file"), row.alias("row"))
    maybe, responses = split_by_filter(rows, revisits.select("file", "row"), "file", "row")
    joined = maybe.join(revisits.withColumn("revisit", F.lit(True)), ["file", "row"], "left").unionByName(
        responses, allowMissingColumns=True
    )
    revisit = F.coalesce("revisit", F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        name(F.col("page")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.sha1("payload")).alias("payload_digest"),
        F.lit(None).cast("string").alias("http_headers"),
        F.length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(record_id: str | Column) -> Column:
    """The page_id that ``page_records`` has put into a record id; null if there was none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
