"""WARC archives as a Spark data source.

    register(spark)
    table.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").schema("record_id string, payload binary").load(folder).filter("record_type = 'response'")

The driver plans groups of files of about equal bytes. A task reads each record's header
first and tests the pushed predicates (record type and any other header column) on it; of a
record that fails them, or whose payload no column asks for, the block is passed over: by a
seek in plain archives and in gzip members that carry the skip-lengths field, by inflating
without keeping anything in others. Columns are chosen by the schema given to the reader.

A writer task rolls gzip files (a member per record) and reports their names; the commit is
one manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import sized_side

READ_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1000
PLAN_BYTES = 64 << 20  # of archive a task reads, where files are no larger
ROLL_BYTES = 128 << 20
HEAD_LIMIT = 1 << 20
LINE_ENDS = 4  # bytes that close a record
MANIFEST = "_manifest-"

# fixed names of the format
FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type", "content_length": "content-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = T.StructType([
    *[T.StructField(c, T.LongType() if c == "content_length" else T.StringType()) for c in FIELDS],
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("http_headers", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())])
FROM_BLOCK = {"http_headers", "payload_bytes", "payload"}


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a local path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


class Source:
    """Bytes of one archive in order; `member` and `at` tell where the current record starts in the file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.held, self.place = file, bytearray(), 0

    def more(self) -> bool:
        """Adds bytes to `held`; false at the end."""
        got = self.file.read(READ_BYTES)
        self.held += got
        self.place += len(got)
        return bool(got)

    def at(self) -> int:
        return self.place - len(self.held)

    def skip(self, n: int) -> None:
        """Passes over n bytes of a record."""
        passed = min(n, len(self.held))
        del self.held[:passed]
        if n > passed:
            self.place += n - passed
            if self.place > self.file.size():
                raise ValueError("the archive ends inside a record")
            self.file.seek(self.place)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError(f"the archive ends inside a record, near byte {self.place}")
        got = bytes(self.held[:n])
        del self.held[:n]
        return got

    def until(self, mark: bytes, limit: int) -> bytes | None:
        """Everything before `mark`, which goes too; None if the archive, or `limit`, ends first."""
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if start > limit or not self.more():
                return None
        if found > limit:
            return None
        got = bytes(self.held[:found])
        del self.held[:found + len(mark)]
        return got

    def at_end(self) -> bool:
        """Passes line ends between records; true if nothing follows."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if self.held:
                return False
            if not self.more():
                return True


class GzipSource(Source):
    """The inflated bytes of a file of gzip members."""

    def __init__(self, file: pa.NativeFile):
        super().__init__(file)
        self.raw, self.raw_place = b"", 0  # unread compressed bytes, and how many lie before their end
        self.inflate = None
        self.member, self.member_end, self.member_left = 0, None, None

    def at(self) -> int:
        return self.member

    def feed(self, n: int) -> bool:
        while len(self.raw) < n:
            got = self.file.read(READ_BYTES)
            if not got:
                return False
            self.raw += got
            self.raw_place += len(got)
        return True

    def start(self) -> bool:
        """Reads a member's header; its skip-lengths field, if any, tells both lengths."""
        if not self.feed(18):
            if self.raw.strip(b"\0"):
                raise ValueError(f"no whole gzip member at byte {self.raw_place - len(self.raw)}")
            return False
        if self.raw[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {self.raw_place - len(self.raw)}")
        self.member, self.member_end, self.member_left = self.raw_place - len(self.raw), None, None
        if self.raw[3] & 4:
            length = struct.unpack("<H", self.raw[10:12])[0]
            self.feed(12 + length)
            extra, i = self.raw[12:12 + length], 0
            while i + 4 <= len(extra):
                size = struct.unpack("<H", extra[i + 2:i + 4])[0]
                if extra[i:i + 2] == b"sl" and size == 8:
                    packed, self.member_left = struct.unpack("<II", extra[i + 4:i + 12])
                    self.member_end = self.member + packed
                i += 4 + size
        self.inflate = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        while True:
            if self.inflate is None and not self.start():
                return False
            if not self.feed(1):
                raise ValueError(f"gzip member at byte {self.member} is cut off")
            got = self.inflate.decompress(self.raw, READ_BYTES)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.member_left is not None:
                self.member_left -= len(got)
            if self.inflate.eof:
                self.inflate = None
            if got:
                self.held += got
                return True

    def skip(self, n: int) -> None:
        while n > 0:
            passed = min(n, len(self.held))
            del self.held[:passed]
            n -= passed
            if n and self.inflate is not None and self.member_end is not None and self.member_left - LINE_ENDS <= n <= self.member_left:
                self.raw, self.raw_place, self.inflate = b"", self.member_end, None
                self.file.seek(self.member_end)
                return
            if n and not self.more():
                raise ValueError("the archive ends inside a record")


def header_fields(head: bytes) -> dict[str, str]:
    """Field names in lower case, with their values; folded lines are joined, a repeated field keeps its first value."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            if name in fields:
                name = None
            else:
                fields[name] = value.strip()
    return fields


def column_value(fields: dict[str, str], column: str) -> str | int | None:
    value = fields.get(FIELDS[column])
    if column == "content_length":
        return int(value) if value and value.isdigit() else None
    return value


def holds(test: D.Filter, fields: dict[str, str]) -> bool | None:
    """SQL's answer of a predicate on header columns; None is unknown."""
    if isinstance(test, D.Not):
        inner = holds(test.child, fields)
        return None if inner is None else not inner
    value = column_value(fields, test.attribute[0])
    if isinstance(test, D.IsNull):
        return value is None
    if isinstance(test, D.IsNotNull):
        return value is not None
    if isinstance(test, D.EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    if isinstance(test, D.In):
        return True if value in test.value else None if None in test.value else False
    if test.value is None:
        return None
    if isinstance(test, D.EqualTo):
        return value == test.value
    if isinstance(test, D.StringStartsWith):
        return value.startswith(test.value)
    if isinstance(test, D.StringEndsWith):
        return value.endswith(test.value)
    if isinstance(test, D.StringContains):
        return test.value in value
    a, b = (value.encode(), test.value.encode()) if isinstance(value, str) else (value, test.value)  # Spark orders texts by their bytes
    return a > b if isinstance(test, D.GreaterThan) else a >= b if isinstance(test, D.GreaterThanOrEqual) else a < b if isinstance(test, D.LessThan) else a <= b


def can_test(test: D.Filter) -> bool:
    if isinstance(test, D.Not):
        return can_test(test.child)
    known = (D.EqualTo, D.EqualNullSafe, D.In, D.IsNull, D.IsNotNull, D.StringStartsWith, D.StringEndsWith, D.StringContains,
             D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)
    return isinstance(test, known) and len(test.attribute) == 1 and test.attribute[0] in FIELDS


@dataclass
class Files(D.InputPartition):
    paths: list[str]


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path = options["path"]
        self.plan_bytes = int(options.get("bytespertask", PLAN_BYTES))
        self.schema = schema
        self.tests: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for test in filters:
            if can_test(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        """Files in name order, as many together as stay below the bytes of a task."""
        system, root = open_folder(self.path)
        found = committed_files(system, root)
        groups, size = [], None
        for path, n in sorted(found):
            if size is None or size + n > self.plan_bytes:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(path)
            size += n
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        columns = self.schema.names
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                source = (GzipSource if path.endswith(".gz") else Source)(file)
                for record in read_records(source, self.tests, set(columns)):
                    record["file"] = path
                    rows.append(tuple(record.get(c) for c in columns))
                    size += len(record.get("payload") or b"") + 300
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self.batch(rows)
                        rows, size = [], 0
        yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
        columns = list(zip(*rows)) if rows else [()] * len(self.schema)
        arrays = [pa.array(c, kinds.get(f.dataType, pa.map_(pa.string(), pa.string()))) for c, f in zip(columns, self.schema)]
        return pa.RecordBatch.from_arrays(arrays, self.schema.names)


def committed_files(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that manifests name; without any manifest, of all archives below the folder, or the file itself."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no archive at {root}")
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    names = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(MANIFEST)]
    if names:
        out = []
        for f in names:
            with system.open_input_stream(f.path) as file:
                out += [(f"{root}/{name}", size) for name, size in json.loads(file.read())]
        return out
    below = system.get_file_info(fs.FileSelector(root, recursive=True))
    return [(f.path, f.size) for f in below if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name[0] not in "._"]


def read_records(source: Source, tests: list[D.Filter], columns: set[str]) -> Iterator[dict]:
    """The records that pass all tests, as the asked columns."""
    while not source.at_end():
        at = source.at()
        head = source.until(b"\r\n\r\n", HEAD_LIMIT)
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC header at byte {at}")
        fields = header_fields(head)
        length = column_value(fields, "content_length")
        if length is None:
            raise ValueError(f"no Content-Length in the record at byte {at}")
        if not all(holds(test, fields) for test in tests):
            source.skip(length)
            continue
        record = {c: column_value(fields, c) for c in FIELDS}
        record |= {"headers": list(fields.items()), "offset": at}
        if columns & FROM_BLOCK:
            read_block(source, fields, length, columns, record)
        else:
            source.skip(length)
        yield record


def read_block(source: Source, fields: dict[str, str], length: int, columns: set[str], record: dict) -> None:
    """HTTP head and payload of a record; the payload of an HTTP message starts after its head.

    payload_bytes is the payload's length, in a revisit that of the payload it stands for
    (its HTTP Content-Length), and a revisit has no payload.
    """
    revisit = record["record_type"] == "revisit"
    http = None
    if (record["content_type"] or "").lower().startswith("application/http") or revisit:
        found = source.until(b"\r\n\r\n", min(length - LINE_ENDS, HEAD_LIMIT))
        http = found or b""
        length -= 0 if found is None else len(found) + LINE_ENDS
        record["http_headers"] = http.decode("utf-8", "replace")
    told = header_fields(http).get("content-length") if http else None
    record["payload_bytes"] = (int(told) if told and told.isdigit() else None) if revisit else length
    if "payload" in columns and not revisit:
        record["payload"] = source.take(length)
    else:
        source.skip(length)


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, int]]


def member(data: bytes, level: int) -> bytes:
    """A gzip member; lengths below 4 GB stand in its skip-lengths field."""
    code = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = code.compress(data) + code.flush()
    total = 24 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(total, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(6) + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(data)) + body + tail


def header_text(value: str) -> str:
    """A header value stays on one line."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: urllib.parse.quote(m[0]), value)


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record; a response carries its payload behind an HTTP head, a revisit the head only."""
    payload = row["payload"] or b""
    kind = row["record_type"]
    http = b""
    if kind in ("response", "revisit"):
        size = row.get("payload_bytes")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {header_text(row['record_id'])}", f"WARC-Date: {row.get('date') or date}"]
    for name, column in (("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest")):
        if row.get(column) is not None:
            head.append(f"{name}: {header_text(row[column])}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head.append("Content-Type: application/http; msgtype=response" if http else f"Content-Type: {row.get('content_type') or 'application/octet-stream'}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(D.DataSourceArrowWriter):
    """Rows with record_type, record_id and payload, and any of target_uri, date, refers_to, payload_digest, payload_bytes, content_type."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        missing = {"record_type", "record_id", "payload"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.path, self.overwrite = options["path"], overwrite
        self.roll = int(options.get("bytesperfile", ROLL_BYTES))
        self.level = int(options.get("level", 6))
        self.packed = options.get("compression", "gzip") == "gzip"
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        file, size, name = None, 0, ""
        for batch in iterator:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                data = record_bytes(row, self.date)
                if self.packed:
                    data = member(data, self.level)
                if file is None:
                    name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
                    file, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                file.write(data)
                size += len(data)
                if size >= self.roll:
                    file.close()
                    files.append((name, size))
                    file = None
        if file is not None:
            file.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """One new manifest; when overwriting, the older ones go, and then their files."""
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        older = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(MANIFEST)] if self.overwrite else []
        gone = [path for path, _ in committed_files(system, root)] if older else []
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as file:
            file.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for path in older + gone:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(f"{root}/{name}")


class WarcSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        unknown = set(schema.names) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return WarcReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archive(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of an archive; predicates on header columns among them are pushed down."""
    register(spark)
    return spark.read.format("warc").schema(T.StructType([SCHEMA[c] for c in columns])).load(path)


def row_id(record: str) -> Column:
    """The row id inside a record id that archive_rows gave (null: none)."""
    return F.regexp_extract(F.col(record), r"^<urn:row:(-?\d+):", 1).try_cast("long")


def archive_rows(rows: DataFrame, path: str, id: str = "page_id", url: str = "url", body: str = "html", least: int = 100) -> None:
    """Writes one record for each row, payload `body` in UTF-8 (null: empty), to a new folder.

    Of rows with equal payloads of at least `least` bytes the one with the smallest id (a
    null id comes after all others) is a response, the others are revisits that refer to it;
    shorter payloads are all responses. Of repeated rows with that id, one is the response:
    by a hash of the url, then any of rows that agree in both. Payloads are equal when their
    SHA-256 are. A null url is left out of the header. Other columns are left out.

    Payloads stay where they are read if the table of repeated digests is small enough to be
    sent (session.sized_side), else rows meet it by digest in a join that splits hot digests.
    """
    spark = rows.sparkSession
    register(spark)
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    plain = rows.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload")).withColumns(
        {"digest": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.octet_length("payload").cast("long"), "link": F.xxhash64("target_uri")})
    alike = plain.filter(F.col("payload_bytes") >= least).groupBy("digest", "id", "link").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "link", "n"))
    repeated = alike.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("all")).filter("all > 1").select(
        "digest", F.lit(True).alias("again"), F.col("first.id").alias("first_id"), F.col("first.link").alias("first_link"), F.col("first.n").alias("first_n"))
    repeated = sized_side(repeated)
    met = plain.withColumn("long", F.col("payload_bytes") >= least).join(repeated, "digest", "left")
    chosen = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("link") == F.col("first_link"))
    met = met.withColumn("role", F.when(~F.col("long") | F.col("again").isNull(), "single").when(chosen & (F.col("first_n") > 1), "one of several")
                         .when(chosen, "first").otherwise("revisit"))
    names = ["id", "target_uri", "digest", "payload_bytes", "payload", "long", "first_id", "role"]
    records = met.filter("role <> 'one of several'").select(names)
    several = repeated.filter("first_n > 1")
    if not several.isEmpty():  # rows that repeat id, link and payload: one of them, found map-side, and the rest from their count
        one = met.filter("role = 'one of several'").groupBy("digest", "id").agg(*[F.min(c).alias(c) for c in ("target_uri", "payload_bytes", "payload", "long", "first_id")])
        one = one.withColumn("role", F.lit("first"))
        rest = one.drop("role").join(several.select("digest", "first_n"), "digest").withColumns({"role": F.lit("revisit"), "_copy": F.explode(F.sequence(F.lit(2), "first_n"))})
        records = records.unionByName(one.select(names)).unionByName(rest.select(names))
    hexed = F.lower(F.hex("digest"))

    def name(who: str) -> Column:
        return F.concat(F.lit("<urn:row:"), F.coalesce(F.col(who).cast("string"), F.lit("null")), F.lit(":"), hexed)

    revisit = F.col("role") == "revisit"
    named_once = F.col("long") & ~revisit
    records.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(named_once, F.concat(name("id"), F.lit(">"))).otherwise(F.concat(name("id"), F.lit(":"), F.uuid(), F.lit(">"))).alias("record_id"),
        "target_uri", F.when(revisit, F.concat(name("first_id"), F.lit(">"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), hexed).alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload")).write.format("warc").mode("append").save(path)


def archived_rows(spark: SparkSession, path: str, id: str = "page_id") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of what archive_rows wrote, read in two passes.

    Responses are measured and digested anew from their payloads; of revisits no more than the heads is read.
    """
    bodies = read_archive(spark, path, ["record_type", "record_id", "payload"]).filter("record_type = 'response'")
    heads = read_archive(spark, path, ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"]).filter("record_type = 'revisit'")
    measured = bodies.select(row_id("record_id").alias(id), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
                             "record_type", F.lit(None).cast("long").alias("refers_to"))
    told = heads.select(row_id("record_id").alias(id), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
                        "record_type", row_id("refers_to").alias("refers_to"))
    return measured.unionByName(told)
