import gzip
import io

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tidelane.llm import warc

FIELDS = "page_id long, url string, html string, payload string, record_type int"
ROWS = [(3, "http://a/x", "<p>same</p>", "z", 1), (1, "http://b/\r\nX-Bad: 1", "<p>same</p>", None, None), (2, None, None, None, None), (7, "u", "", None, None), (9, "v", "é" * 3000, None, None), (9, "v", "é" * 3000, None, None), (None, "w", "<p>same</p>", None, None)]


@pytest.fixture(scope="module", params=["gzip", "none"])
def path(request, spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('warc')}/out"
    warc.archive_pages(spark.createDataFrame(ROWS, FIELDS), at, compression=request.param, rollBytes="200")
    return at


def key(r):
    return (-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])


def test_round_trip(spark, path):
    digest = warc.payload_digest
    same, none, long = b"<p>same</p>", b"", ("é" * 3000).encode()
    want = [(1, 11, digest(same), "response", None), (3, 11, digest(same), "revisit", 1), (-1, 11, digest(same), "revisit", 1), (2, 0, digest(none), "response", None), (7, 0, digest(none), "revisit", 2), *[(9, 6000, digest(long), "response", None)] * 2]
    assert sorted(map(key, warc.read_pages(spark, path).collect()), key=str) == sorted(want, key=str)


def test_predicates_reach_the_reader_and_payloads_are_skipped(spark, path):
    reader = warc.WarcReader({"path": path, "payload": "false"})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.StringStartsWith(("record_id",), "<urn:page:"), warc.EqualTo(("content_length",), 3)]))
    assert [type(x) for x in rest] == [warc.EqualTo] and rest[0].attribute == ("content_length",)
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(rows) == 3 and all(r["record_type"] == "revisit" and r["payload"] is None for r in rows)
    found = spark.read.format(warc.NAME).load(path).where(F.col("record_type").isin("response") & F.col("target_uri").isNull())
    assert [r["record_id"] for r in found.collect()] == ["<urn:page:2>"]


def test_files_are_valid_and_foreign_members_are_read(path):
    store, root = fs.FileSystem.from_uri(path)
    names = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.is_file]
    assert len(names) > 1
    raw = [store.open_input_stream(n, compression=None).read() for n in names]
    plain = b"".join(gzip.decompress(b) if n.endswith(".gz") else b for n, b in zip(names, raw, strict=True))
    assert plain.count(b"WARC/1.1\r\n") == 7 and b"\nX-Bad" not in plain
    foreign = b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n)) for n in (3, 70000))

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    assert [len(r["payload"]) for r in warc.read_records(Sized(foreign), True, lambda r: True, True)] == [3, 70000]
    assert [r["payload"] for r in warc.read_records(Sized(foreign), True, lambda r: False, True)] == []


def test_empty_table(spark, tmp_path):
    at = f"file://{tmp_path}/none"
    warc.archive_pages(spark.createDataFrame([], FIELDS), at)
    assert warc.read_pages(spark, at).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    at = f"file://{tmp_path}/least"
    warc.archive_pages(spark.createDataFrame(ROWS, FIELDS), at, min_bytes=12)
    assert {r["record_type"] for r in warc.read_pages(spark, at).collect()} == {"response"}


def test_only_what_a_commit_lists_is_read(spark, tmp_path):
    """Leftovers of failed tasks don't count, appended archives do, files of other writers stand, and overwriting clears the folder."""
    import os
    import shutil

    at = f"file://{tmp_path}/w"
    warc.archive_pages(spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string"), at)
    own = next(x for x in os.listdir(tmp_path / "w") if x.startswith("part-"))
    shutil.copy(tmp_path / "w" / own, tmp_path / "w" / "part-lost.warc.gz")
    assert [r["page_id"] for r in warc.read_pages(spark, at).collect()] == [1]
    warc.archive_pages(spark.createDataFrame([(2, "u", "two")], "page_id long, url string, html string"), at)
    assert sorted(r["page_id"] for r in warc.read_pages(spark, at).collect()) == [1, 2]
    shutil.copy(tmp_path / "w" / own, tmp_path / "w" / "crawl.warc.gz")
    assert sorted(r["page_id"] for r in warc.read_pages(spark, at).collect()) == [1, 1, 2]
    rows = spark.createDataFrame([("response", "<urn:page:5>", b"five")], "record_type string, record_id string, payload binary")
    full = rows.selectExpr(*[f"`{c}`" if c in rows.columns else f"CAST(NULL AS {k}) AS {c}" for c, k in (x.split() for x in warc.SCHEMA.split(", "))])
    full.write.format(warc.NAME).mode("overwrite").save(at)
    assert [(r["record_id"], bytes(r["payload"])) for r in spark.read.format(warc.NAME).load(at).collect()] == [("<urn:page:5>", b"five")]


def test_a_payload_larger_than_a_batch(spark, tmp_path):
    at = f"file://{tmp_path}/w"
    large = "abcdefgh" * (1 << 20)
    warc.archive_pages(spark.createDataFrame([(1, "u", large), (2, "u", "x"), (3, "u", large)], "page_id long, url string, html string"), at)
    assert sorted(map(key, warc.read_pages(spark, at).collect())) == [(1, 8 << 20, warc.payload_digest(large.encode()), "response", None), (2, 1, warc.payload_digest(b"x"), "response", None), (3, 8 << 20, warc.payload_digest(large.encode()), "revisit", 1)]
