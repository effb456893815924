"""WARC archives as a PySpark Python data source (``spark.read.format("tidelane_warc")``), and page archiving with revisit records.

Reading plans whole files as partitions, small ones together. Equality, IN, prefix and null predicates on record type and header
columns are pushed into the scan: headers are parsed first, and the payload of a record that fails them - or every payload, with
option ``payload=false`` - is skipped without being decoded. Gzip members written here carry their length in the ``sl`` extra field,
so skipping is a seek; members of other writers are inflated to their end. Plain ``.warc`` files are read by Content-Length.

Writing rolls files at ``rollBytes``. Tasks write files of new names, and a commit writes one manifest of those that finished tasks returned: until
it is there, none of them is read, and what failed or repeated tasks left never is. Files of other names are read as they stand.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from tidelane.storage import materialize, open_store, scratch

NAME = "tidelane_warc"
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, profile string, content_type string, content_length long, http_length long, file string, file_offset long, payload binary"

# Fixed values of the format.
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile", "content_type": "Content-Type"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http; msgtype=response"
_GZIP_HEAD = struct.Struct("<2sBBIBBH2sHII")  # magic, method, flags, time, extra flags, system, extra length, 'sl', its length, compressed, plain


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: object) -> str:
    """A header value: line breaks would end the header."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def gzip_member(block: bytes, level: int = 6) -> bytes:
    """A gzip member whose ``sl`` extra field holds its compressed and plain length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    size = _GZIP_HEAD.size + len(body) + 8
    head = _GZIP_HEAD.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record_block(row: dict) -> bytes:
    """A WARC/1.1 record of ``row``: its HTTP response header and, but for revisits, its payload."""
    payload = row["payload"] or b""
    length = row["http_length"] if row["http_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(row['content_type'] or 'application/octet-stream')}\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (b"" if row["record_type"] == "revisit" else payload)
    named = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Target-URI": row["target_uri"], "WARC-Date": row["date"], "WARC-Payload-Digest": f"sha1:{row['payload_digest']}" if row["payload_digest"] else None, "WARC-Refers-To": row["refers_to"], "WARC-Profile": row["profile"]}
    head = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in named.items() if v is not None), f"Content-Type: {_HTTP}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_OWN, _MANIFEST = "part-", "_manifest-"


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


def _listing(store, root: str) -> tuple[list, list]:
    """The archive files of a folder that count, by path, and its manifests."""
    from pyarrow import fs

    found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file]
    manifests = [x for x in found if x.base_name.startswith(_MANIFEST) and x.base_name.endswith(".json")]
    listed: set[str] = set()
    for x in manifests:
        with store.open_input_stream(x.path) as f:
            listed.update(json.loads(f.read()))
    archives = [x for x in found if x.base_name.endswith((".warc", ".warc.gz")) and (x.base_name in listed or not x.base_name.startswith(_OWN))]
    return sorted(archives, key=lambda x: x.path), manifests


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.roll = int(options.get("rollBytes", 64 << 20))
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = open_store(self.path)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 256):
                for values in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in names), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        files.append(f"{_OWN}{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    block = record_block(dict(zip(names, values, strict=True)))
                    size += out.write(gzip_member(block) if self.gzip else block)
                    if size >= self.roll:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        files = [x for message in messages if message for x in message.files]
        if self.overwrite:
            archives, manifests = _listing(store, root)
            for x in [*manifests, *archives]:
                store.delete_file(x.path)
        name = f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{name}.unfinished") as f:
            f.write(json.dumps(files).encode())
        store.move(f"{name}.unfinished", name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.path)
        for message in messages:
            for x in message.files if message else ():
                store.delete_file(f"{root}/{x}")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", 64 << 20))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for x in filters:
            column = x.attribute[0] if hasattr(x, "attribute") and len(x.attribute) == 1 else None
            if column in _HEADERS and isinstance(x, EqualTo):
                self.filters.append((column, "in", frozenset([x.value])))
            elif column in _HEADERS and isinstance(x, In):
                self.filters.append((column, "in", frozenset(x.value)))
            elif column in _HEADERS and isinstance(x, StringStartsWith):
                self.filters.append((column, "prefix", x.value))
            elif column in _HEADERS and isinstance(x, IsNull | IsNotNull):
                self.filters.append((column, "null", isinstance(x, IsNull)))
            else:
                yield x

    def partitions(self):
        out, size = [], self.split
        for x in _listing(*open_store(self.path))[0]:
            if size + x.size > self.split:
                out.append(_Files([]))
                size = 0
            out[-1].value.append(x.path)
            size += x.size
        return out or [_Files([])]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            have = row[column]
            if kind == "null":
                if (have is None) != value:
                    return False
            elif have is None or (kind == "in" and have not in value) or (kind == "prefix" and not have.startswith(value)):
                return False
        return True

    def read(self, partition):
        store, _ = open_store(self.path)
        rows, size = [], 0
        for path in partition.value:
            with store.open_input_file(path) as f:
                for row in read_records(f, path.endswith(".gz"), self._wanted, self.payload):
                    row["file"] = path.rpartition("/")[2]
                    rows.append(row)
                    size += 256 + len(row["payload"] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


class _Plain:
    """A record's bytes in a plain file."""

    def __init__(self, f):
        self.f, self.start = f, f.tell()

    def read(self, n: int) -> bytes:
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.f.seek(n, io.SEEK_CUR)

    def finish(self) -> None:
        self.f.seek(4, io.SEEK_CUR)  # the blank lines after a record


class _Member:
    """A record's bytes in a gzip member; only what is read is inflated if the member tells its length."""

    def __init__(self, f):
        self.f, self.start = f, f.tell()
        head = f.read(_GZIP_HEAD.size)
        told = len(head) == _GZIP_HEAD.size and head[3] == 4 and head[10:14] == b"\x0c\x00sl"
        self.end = self.start + struct.unpack_from("<I", head, 16)[0] if told else None
        f.seek(self.start)
        self.inflate, self.held = zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        out = b""
        while n > len(out) and not self.inflate.eof:
            source = self.held or self.f.read(4096 if n < 4096 else 1 << 16)
            if not source:
                break
            out += self.inflate.decompress(source, n - len(out))
            self.held = self.inflate.unconsumed_tail
        return out

    def skip(self, n: int) -> None:
        if self.end is None:
            while n > 0 and (got := len(self.read(min(n, 1 << 16)))):
                n -= got

    def finish(self) -> None:
        if self.end is None:
            while not self.inflate.eof and self.read(1 << 16):
                pass
            self.end = self.f.tell() - len(self.inflate.unused_data)
        self.f.seek(self.end)


def read_records(f, gzip: bool, wanted, with_payload: bool) -> Iterator[dict]:
    """Rows of the records of an open archive for which ``wanted`` holds of their header columns."""
    size = f.size()
    while f.tell() < size:
        record = (_Member if gzip else _Plain)(f)
        head = b""
        while b"\r\n\r\n" not in head:
            more = record.read(1024)
            if not more:
                break
            head += more
        if not head.strip():
            break
        head, _, rest = head.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at {record.start}: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        row = {c: fields.get(h.lower()) for c, h in _HEADERS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").partition(":")[2] or row["payload_digest"]
        length = int(fields["content-length"])
        row |= {"content_length": length, "http_length": None, "file_offset": record.start, "payload": None}
        body = rest[:length]
        if not wanted(row):
            record.skip(length - len(body)) if gzip or length > len(body) else record.f.seek(len(body) - len(rest), io.SEEK_CUR)
            record.finish()
            continue
        http = (row["content_type"] or "").startswith("application/http")
        while http and b"\r\n\r\n" not in body and len(body) < length:
            body += record.read(min(1024, length - len(body)))
        if http:
            for line in body.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                if k.strip().lower() == b"content-length":
                    row["http_length"] = int(v)
        if with_payload and row["record_type"] != "revisit":
            while len(body) < length and (more := record.read(length - len(body))):
                body += more
            row["payload"] = body.partition(b"\r\n\r\n")[2] if http else body
        if gzip:
            record.skip(length - len(body))
        else:
            record.f.seek(record.start + len(head) + 4 + length)
        record.finish()
        yield row


class WarcDataSource(DataSource):
    """``path``: a folder. Read options: payload, splitBytes; write options: compression (gzip or none), rollBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark push predicates into Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, _key, refers_to) of the pages that revisit a smaller page_id with an equal payload of ``min_bytes`` at least.

    Only ids and digests move. Groups are reduced before the shuffle, and the join back to the pages of a large group is one that
    Spark can split, as both of its sides are stored tables.
    """
    keys = materialize(pages.select("page_id", "_key").where(F.col("_bytes") >= min_bytes), "warc-keys")
    groups = materialize(keys.groupBy("_key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "warc-groups")
    return keys.join(groups, "_key").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", **options: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``path``.

    A null html is an empty payload. Of equal payloads of at least ``min_bytes``, the smallest page_id is a response and the others
    revisit it; rows that repeat both page_id and payload are responses each. A null page_id never is the smallest, unless there is
    no other. Null urls leave out the target URI. An empty table writes no file.
    """
    spark = pages.sparkSession
    register(spark)
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("_payload"))
    rows = rows.withColumns({"_bytes": F.length("_payload").cast("long"), "_key": F.unhex(F.sha2("_payload", 256))})
    found = revisits(rows, min_bytes).select(F.col("page_id").alias("_id"), F.col("_key").alias("_again"), "refers_to")
    joined = rows.join(found, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_again")), "left")
    again = F.col("_again").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    out = joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.sha1("_payload").alias("payload_digest"),
        F.when(again, urn("refers_to")).alias("refers_to"),
        F.when(again, F.lit(_REVISIT)).alias("profile"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit(0).cast("long").alias("content_length"),
        F.col("_bytes").alias("http_length"),
        F.lit(None).cast("string").alias("file"),
        F.lit(0).cast("long").alias("file_offset"),
        F.when(~again, F.col("_payload")).alias("payload"),
    )
    out.mapInArrow(_base32_digests, SCHEMA).write.format(NAME).mode("append").options(**options).save(path)


def _base32_digests(batches):
    for batch in batches:
        i = batch.schema.names.index("payload_digest")
        digests = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(i).to_pylist()], pa.string())
        yield batch.set_column(i, "payload_digest", digests)


def _page_rows(batches):
    """Contract columns of records read back; a payload that does not match its header's digest is an error."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
    page = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["record_type"] == "revisit":
                size, digest = r["http_length"], r["payload_digest"]
            else:
                size, digest = len(r["payload"]), payload_digest(r["payload"])
                if (size, digest) != (r["http_length"], r["payload_digest"]):
                    raise ValueError(f"damaged payload of {r['record_id']} in {r['file']}")
            rows.append((page(r["record_id"]), size, digest, r["record_type"], page(r["refers_to"]), r["target_uri"]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)] if rows else [pa.array([], t) for t in kinds.types], schema=kinds)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each archived page: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    register(spark)
    return spark.read.format(NAME).load(path).mapInArrow(_page_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path).drop("target_uri")


SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
k AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM k""",
}
