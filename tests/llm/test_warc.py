import gzip
import hashlib
import io
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faultline.llm import warc
from faultline.session import scratch_path

PAGES = "page_id long, url string, html string"


def brute(rows):
    """Rows as multisets: which of equal rows is the response cannot be told from outside."""
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = n > 0 and len(body) >= 100
            out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def round_trip(spark, rows, schema=PAGES):
    path = scratch_path(spark, "archive")
    warc.archive_rows(spark.createDataFrame(rows, schema), path)
    return sorted([tuple(r) for r in warc.archived_rows(spark, path).collect()], key=str)


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert round_trip(spark, rows) == brute(rows)


def test_nulls_copies_repeats_and_lengths(spark):
    long = "é" * 50 + "x" * 600_000
    rows = [(5, "u", "a" * 100), (3, None, "a" * 100), (4, "u\r\nWARC-Type: x", "a" * 100), (9, "u", "b" * 99), (8, "u", "b" * 99), (7, "v", "é" * 50), (6, "w", "é" * 50),
            (1, "u", None), (2, "u", ""), (None, "n", "c" * 200), (10, "c", "c" * 200), (None, None, "d" * 200), (None, None, "d" * 200), (11, "u", long), (12, "u", long),
            (20, "r", "e" * 300), (20, "r", "e" * 300), (20, "r", "e" * 300), (20, "s", "e" * 300), (21, "r", "e" * 300), (30, "\r\n\r\n", "WARC/1.1\r\n\r\n" * 20)]
    assert round_trip(spark, rows) == brute(rows)


def test_a_third_are_copies_and_no_row_is_sent(spark, monkeypatch):
    rows = [(i, f"u{i}", "copy" * 40 if i % 3 else f"own {i} " * 30) for i in range(600)]
    assert round_trip(spark, rows) == brute(rows)
    monkeypatch.setattr(warc, "sized_side", lambda df: df)  # the join for a table too large to be sent
    assert round_trip(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    schema = PAGES + ", digest string, id string, payload int, role string, record_type string"
    assert round_trip(spark, [], schema) == []
    rows = [(i, "u", "same" * 30 if i else "own") for i in range(6)]
    assert round_trip(spark, [r + ("x", "y", 1, "z", "w") for r in rows], schema) == brute(rows)


def record(kind, body, *fields, http=True):
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if http else b"") + body
    kind_field = b"Content-Type: application/http; msgtype=response\r\n" if http else b""
    head = b"WARC/1.0\r\nwarc-type: " + kind + b"\r\n" + b"".join(f + b"\r\n" for f in fields) + kind_field
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


FOREIGN = [record(b"warcinfo", b"software: x\r\n", http=False),
           record(b"response", b"<p>one</p>" * 50_000, b"WARC-Target-URI: http://a.example/1", b"WARC-Record-ID: <urn:uuid:1>", b"X-Long: first\r\n  second"),
           record(b"request", b"", b"WARC-Target-URI: http://a.example/1"),
           record(b"response", b"two\r\n\r\nWARC/1.0\r\n\r\n", b"WARC-Target-URI: http://b.example/2", b"WARC-Record-ID: <urn:uuid:2>"),
           record(b"resource", b"plain", b"WARC-Target-URI: http://b.example/3", http=False),
           record(b"response", b"", b"WARC-Target-URI: http://c.example/4", b"WARC-Record-ID: <urn:uuid:4>")]


@pytest.fixture(scope="module", params=["plain", "member each", "one member", "own members"])
def foreign(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("foreign")
    half = {"plain": b"".join, "member each": lambda rs: b"".join(map(gzip.compress, rs)), "one member": lambda rs: gzip.compress(b"".join(rs)),
            "own members": lambda rs: b"".join(warc.member(r, 6) for r in rs)}[request.param]
    suffix = "" if request.param == "plain" else ".gz"
    (folder / "sub").mkdir()
    (folder / f"a.warc{suffix}").write_bytes(half(FOREIGN[:4]))
    (folder / "sub" / f"b.warc{suffix}").write_bytes(half(FOREIGN[4:]))
    (folder / f"_part.warc{suffix}").write_bytes(b"not finished")
    return str(folder)


def test_foreign_archives(spark, foreign):
    got = warc.read_archive(spark, f"file://{foreign}", ["record_type", "target_uri", "payload", "headers", "http_headers"]).collect()
    by = {(r.record_type, r.target_uri): r for r in got}
    assert len(got) == len(by) == 6
    assert bytes(by["response", "http://a.example/1"].payload) == b"<p>one</p>" * 50_000
    assert by["response", "http://a.example/1"].headers["x-long"] == "first second"
    assert by["response", "http://a.example/1"].http_headers == "HTTP/1.1 200 OK\r\nContent-Type: text/html"
    assert bytes(by["response", "http://b.example/2"].payload) == b"two\r\n\r\nWARC/1.0\r\n\r\n"
    assert bytes(by["resource", "http://b.example/3"].payload) == b"plain"
    assert bytes(by["warcinfo", None].payload) == b"software: x\r\n"
    assert bytes(by["response", "http://c.example/4"].payload) == b""


@pytest.mark.parametrize("test", ["record_type = 'response'", "record_type <> 'response'", "target_uri IS NULL", "target_uri LIKE 'http://b%'", "target_uri LIKE '%/1' AND record_type = 'response'",
                                  "record_type IN ('request', 'resource')", "NOT record_type IN ('request', 'resource')", "content_length > 100", "target_uri >= 'http://b.example/3'",
                                  "target_uri <=> NULL", "record_type = 'response' AND payload_bytes = 0", "record_type = 'response' OR target_uri IS NULL"])
def test_pushed_predicates_agree_with_spark(spark, foreign, test):
    columns = ["record_type", "target_uri", "content_length", "payload_bytes"]
    pushed = warc.read_archive(spark, foreign, columns).filter(test)
    plain = spark.createDataFrame(warc.read_archive(spark, foreign, columns).collect(), pushed.schema).filter(test)
    assert sorted(map(str, pushed.collect())) == sorted(map(str, plain.collect()))


class Counted(io.BytesIO):
    """A file that counts the bytes read, with a size as the reader's files have."""

    def __init__(self, data):
        super().__init__(data)
        self.n = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        got = super().read(n)
        self.n += len(got)
        return got


@pytest.mark.parametrize("packed", [False, True])
def test_unwanted_payloads_are_passed_over(packed, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1024)
    bodies = [random.Random(i).randbytes(60_000) for i in range(8)]
    data = [record(b"response" if i % 4 == 0 else b"other", b) for i, b in enumerate(bodies)]
    file = Counted(b"".join(warc.member(d, 1) for d in data) if packed else b"".join(data))
    source = (warc.GzipSource if packed else warc.Source)(file)
    got = list(warc.read_records(source, [warc.D.EqualTo(("record_type",), "response")], {"payload"}))
    assert [g["payload"] for g in got] == bodies[::4]
    assert file.n < file.size() * 0.45
    file = Counted(file.getvalue())
    assert len(list(warc.read_records((warc.GzipSource if packed else warc.Source)(file), [], {"record_type"}))) == 8
    assert file.n < file.size() * 0.2


def test_predicates_and_schema_reach_the_source(spark, foreign, capsys):
    df = warc.read_archive(spark, foreign, ["record_type", "record_id"]).filter("record_type = 'response'")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(record_type,response)" in plan and "ReadSchema: struct<record_type:string,record_id:string>" in plan
    assert "Filter (" not in plan
    assert df.columns == ["record_type", "record_id"] and df.count() == 3


def test_damaged_archives_are_refused(spark, tmp_path):
    for name, data in {"cut": FOREIGN[1][:2000], "none": b"hello\r\n\r\n", "length": b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"}.items():
        for suffix, packed in (("", data), (".gz", gzip.compress(data)), (".gz", gzip.compress(FOREIGN[3])[:-20])):
            folder = tmp_path / f"{name}{suffix}{len(packed)}"
            folder.mkdir()
            (folder / f"x.warc{suffix}").write_bytes(packed)
            for columns in (["payload"], ["record_type"]):
                with pytest.raises(PySparkException):
                    warc.read_archive(spark, str(folder), columns).collect()
    with pytest.raises(PySparkException):
        warc.read_archive(spark, str(tmp_path / "absent"), ["payload"]).collect()


def test_only_committed_files_are_read_and_files_are_rolled(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.register(spark)
    rows = spark.range(300).select(F.lit("resource").alias("record_type"), F.concat(F.lit("<urn:x:"), "id", F.lit(">")).alias("record_id"),
                                   F.repeat(F.sha2(F.col("id").cast("string"), 512), 20).cast("binary").alias("payload"))
    rows.write.format("warc").option("bytesPerFile", 20_000).mode("append").save(path)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 5
    (tmp_path / "out" / "part-lost.warc.gz").write_bytes(files[0].read_bytes())

    def ids():
        return sorted(int(r[0][7:-1]) for r in spark.read.format("warc").schema("record_id string").option("bytesPerTask", 50_000).load(path).collect())

    assert ids() == list(range(300))
    rows.limit(7).write.format("warc").option("compression", "none").mode("append").save(path)
    assert ids() == sorted([*range(300), *range(7)])
    rows.limit(9).write.format("warc").mode("overwrite").save(path)
    assert ids() == list(range(9))
    assert spark.read.format("warc").load(path).columns == warc.SCHEMA.names


def test_reader_plans_groups_of_files(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.warc").write_bytes(FOREIGN[3])
    reader = warc.WarcReader({"path": str(tmp_path), "bytespertask": str(3 * len(FOREIGN[3]))}, warc.SCHEMA)
    assert [len(p.paths) for p in reader.partitions()] == [3, 3, 3, 1]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    assert isinstance(next(reader.read(reader.partitions()[0])), pa.RecordBatch)
