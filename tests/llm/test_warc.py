from __future__ import annotations

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from isoreach.llm import warc
from isoreach.llm.queries import op1_warc
from isoreach.llm.warc import page_of, page_records

LONG = "x" * 1200
ROWS = [
    (1, "http://a/1", LONG, "e"),
    (2, "http://a/2", LONG, "e"),
    (9, "http://a/9\r\nWARC-Type: forged", LONG, None),
    (9, "http://a/9 again", LONG, None),
    (3, "http://a/3", "short", "e"),
    (4, None, "short", "e"),
    (5, "http://a/5", None, "e"),
    (6, "http://a/6", "", "e"),
    (7, "http://a/7", "é" * 600 + "\r\n\r\nWARC/1.1\r\n", "e"),
    (8, "http://a/8", "y" * 300_000, "e"),
    (None, "http://a/none", "z" * 1500, "e"),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    warc.register(spark)
    folder = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    page_records(pages).write.format("warc").mode("append").option("path", folder).option("maxfilebytes", 2000).save()
    return folder


def test_round_trip(spark, archive):
    found = spark.read.format("warc").load(archive).withColumn("page", page_of("record_id")).collect()
    assert len(found) == len(ROWS)
    texts = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in found:
        want = texts[r.page]
        assert r.payload_length == len(want)
        assert r.payload_digest == "sha1:" + hashlib.sha1(want).hexdigest()
        if r.page in (1, 2):
            assert (r.warc_type, r.refers_to, r.payload) == ("revisit", "<urn:page:9>", None)
        else:
            assert (r.warc_type, r.refers_to, bytes(r.payload)) == ("response", None, want)
    assert {r.target_uri for r in found if r.page == 4} == {None}
    assert "http://a/9%0D%0AWARC-Type:%20forged" in {r.target_uri for r in found}


def test_filters_and_options(spark, archive):
    df = spark.read.format("warc").load(archive)
    revisits = df.filter("warc_type = 'revisit' AND payload_length > 5")
    assert sorted(r.record_id for r in revisits.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    rest = plan.split("Filter")[1].split("\n")[0]
    assert "payload_length" in rest and "revisit" not in rest
    two = df.filter(df.record_id.isin("<urn:page:3>", "<urn:page:8>", "<urn:page:77>"))
    assert sorted(len(r.payload) for r in two.collect()) == [5, 300_000]
    bare = spark.read.format("warc").option("payload", "false").option("types", "response").load(archive)
    assert {r.payload for r in bare.collect()} == {None} and bare.count() == len(ROWS) - 2


def test_refused_records_are_not_inflated(archive, tmp_path, monkeypatch):
    read = []
    original = warc._Inflater.read
    monkeypatch.setattr(warc._Inflater, "read", lambda self, n: read.append(n) or original(self, n))
    reader = warc.WarcReader({"path": archive})
    reader.allowed["record_id"] = {"<urn:page:3>"}
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == [b"short"] and read == [5]


def test_foreign_archives(spark, tmp_path):
    """Uncompressed records, folded fields, and compressed ones without the extra field."""
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhello"
    record = lambda n: (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Target-URI: http://a\r\n /b\r\n"
        f"Content-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
    ).encode() + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + record(1) + record(2))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record(3)) + gzip.compress(record(4)))
    (tmp_path / "_hidden.warc").write_bytes(b"junk")
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r.record_id, bytes(r.payload), r.target_uri) for r in df.filter("warc_type = 'response'").collect()) == [
        (f"<urn:x:{n}>", b"hello", "http://a /b") for n in (1, 2, 3, 4)
    ]
    assert [bytes(r.payload) for r in df.filter("warc_type = 'warcinfo'").collect()] == [b"abcd"] * 2


def test_empty_table(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    page_records(pages).write.format("warc").mode("append").option("path", str(tmp_path / "w")).save()
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 0


def test_overwrite_replaces(spark, tmp_path):
    warc.register(spark)
    for page in (1, 2):
        pages = spark.createDataFrame([(page, "u", "t")], "page_id long, url string, html string")
        page_records(pages).write.format("warc").mode("overwrite").option("path", str(tmp_path / "w")).save()
    assert [r.record_id for r in spark.read.format("warc").load(str(tmp_path / "w")).collect()] == ["<urn:page:2>"]


def test_foreign_members_are_not_held(tmp_path, monkeypatch):
    """A refused record of a member without a length is dropped piece by piece; one member may hold many records."""
    big = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 30000000\r\n\r\n" + b"q" * 30_000_000 + b"\r\n\r\n"
    small = lambda n: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\n%02d\r\n\r\n" % n
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(small(1) + big + small(2)) + gzip.compress(big) + gzip.compress(small(3)))
    held = []
    original = warc._Inflater._next

    def watched(self, limit):
        held.append(len(self.held))
        return original(self, limit)

    monkeypatch.setattr(warc._Inflater, "_next", watched)
    reader = warc.WarcReader({"path": str(tmp_path), "types": "response"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == [b"01", b"02", b"03"] and max(held) < 1 << 17
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(big)[:-2000])
    with pytest.raises(EOFError):
        reader = warc.WarcReader({"path": str(tmp_path / "b.warc.gz")})
        list(reader.read(reader.partitions()[0]))


def test_only_files_of_a_manifest_count(spark, tmp_path):
    """What a failed or repeated attempt leaves is no part of the archive; foreign files next to it are."""
    folder = tmp_path / "w"
    writer = warc.WarcWriter({"path": str(folder)}, False)
    row = dict.fromkeys([*warc.HEADER_OF, "http_headers", "payload_length"], None) | {"warc_type": "response", "payload": b"p"}
    batch = warc.pa.RecordBatch.from_pylist([row | {"record_id": "<urn:page:1>"}])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    warc.register(spark)
    read = lambda: sorted(r.record_id for r in spark.read.format("warc").load(str(folder)).collect())
    assert read() == []
    writer.commit([kept, None])
    assert read() == ["<urn:page:1>"] and len(list(folder.glob("part-*"))) == 2
    other = warc.WarcWriter({"path": str(folder)}, False)
    other.abort([other.write(iter([batch]))])
    (folder / "foreign.warc.gz").write_bytes((folder / lost.names[0]).read_bytes())
    assert read() == ["<urn:page:1>"] * 2 and len(list(folder.glob("part-*"))) == 2


def test_payloads_shared_by_many_rows(spark, tmp_path):
    """Rows with null ids and clashing columns, a payload that most rows share, against a plain pass."""
    rows = [(i if i % 11 else None, f"u{i}", LONG if i % 3 else ["a", "b" * 1500, None][i // 3 % 3], i, "x") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long, file string")
    pages.repartition(5).write.parquet(str(tmp_path / "pages"))
    best = {}
    for page, _, html, *_ in rows:
        if page is not None:
            best[html] = max(best.get(html, page), page)
    for df in (pages, spark.read.parquet(str(tmp_path / "pages"))):
        got = {r.target_uri: r for r in page_records(df).collect()}
        assert len(got) == len(rows)
        for page, url, html, *_ in rows:
            again = len(html or "") >= 1000 and page != best[html]
            want = ("revisit", f"<urn:page:{best[html]}>", None) if again else ("response", None, (html or "").encode())
            r = got[url]
            assert (r.warc_type, r.refers_to, None if r.payload is None else bytes(r.payload)) == want
            assert r.payload_digest == "sha1:" + hashlib.sha1((html or "").encode()).hexdigest()


@pytest.mark.parametrize("own", [None, "64"])
def test_tasks_hold_few_long_pages_at_once(spark, tmp_path, monkeypatch, own):
    """30 MB of pages in one task: no batch that reaches Python is much over 4 MB, and Parquet is read in few rows."""
    rows, size = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    vectored = "parquet.hadoop.vectored.io.enabled"
    (tmp_path / "sizes").mkdir()

    class Weighed(warc.WarcWriter):
        def write(self, iterator):
            def weighed():
                for n, batch in enumerate(iterator):
                    (tmp_path / "sizes" / f"{os.getpid()}-{id(self)}-{n}").write_text(str(batch.nbytes))
                    yield batch

            return warc.WarcWriter.write(self, weighed())

    class Source(warc.WarcSource):
        def writer(self, schema, overwrite):
            return Weighed(dict(self.options), overwrite)

    html = F.concat(F.col("id").cast("string"), F.lit("x" * 100_000))
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), html.alias("html"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    before, seen = {name: spark.conf.get(name, None) for name in (rows, size)}, []
    made = warc.page_records
    try:
        for name, value in ((rows, own), (size, None)):
            spark.conf.set(name, value) if value else spark.conf.unset(name)
        monkeypatch.setattr(warc, "WarcSource", Source)
        monkeypatch.setattr(warc, "page_records", lambda *a, **k: (seen.extend(map(spark.conf.get, (rows, vectored))), made(*a, **k))[1])
        found = op1_warc(spark, str(tmp_path)).collect()
        assert [spark.conf.get(name, None) for name in (rows, size, vectored)] == [own, None, None]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
        monkeypatch.undo()
        warc.register(spark)
    sizes = [int(f.read_text()) for f in (tmp_path / "sizes").iterdir()]
    assert sum(sizes) > 30_000_000 and max(sizes) < 6_000_000
    assert int(seen[0]) == int(own or 128) and seen[1] == "false"
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in found) == [(k, 100_000 + len(str(k)), "response") for k in range(300)]
