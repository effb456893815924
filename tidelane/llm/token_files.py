"""Token-ID binary output: flat unsigned integer files with 64-bit document offsets.

Layout of a written folder (any shared URI):

* ``<shard>.ids``  token ids, little-endian, ``uint16`` if the vocabulary fits, else ``uint32``; nothing else, so a reader maps it as an array.
* ``<shard>.idx``  three little-endian 64-bit columns, one after another: doc_id, its start in the shard (with one entry more for the end), null flags of doc_id.
* ``manifest.json``  dtype and, in order, each shard's name, documents, ids and base.

Documents are dealt by range of (doc_id, text hash), so shards follow one another
in ascending doc_id order; equal doc_ids may span shards. A shard's base is the
prefix sum of ids over the shards before it. Tasks name their files by attempt and
only names that a finished task returned enter the manifest, so retried, lost or
speculative tasks leave at most orphans.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import tokens
from tidelane.storage import open_store, scratch, shuffle_partitions

END_ID = 2
_SHARD = "shard int, name string, docs long, ids long"
_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def _writer(path: str, tokenizer: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer)
        dtype = np.dtype("<u2") if max(enc.vocab_size - 1, end_id) < 1 << 16 else np.dtype("<u4")
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = open_store(path)
        tail = np.array([end_id], "<u4").tobytes()
        doc_ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[int] = []
        out = None
        for batch in tokens.trimmed(batches):
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.ids")
            ids = batch.column("doc_id")
            nulls.append(np.asarray(ids.is_null(), np.int64))
            doc_ids.append(np.asarray(ids.fill_null(0), np.int64))
            texts = batch.column("text").to_pylist()
            for a, b in tokens.groups(texts):
                for x in enc.encode(texts[a:b]):
                    block = np.frombuffer(x + tail, "<u4")
                    lengths.append(len(block))
                    out.write(block.astype(dtype).tobytes())
        if out is None:
            return
        out.close()
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            for column in (np.concatenate(doc_ids), offsets, np.concatenate(nulls)):
                f.write(column.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "docs": [len(lengths)], "ids": [int(offsets[-1])]})

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> dict:
    """Encode ``docs`` (doc_id, text; others are ignored) below ``path`` and return the manifest.

    A null text is empty (only the end id). Null doc_ids come first and stay null. Repeated rows and repeated doc_ids are all
    written, ordered by doc_id and then by a hash of the text and the text. An empty table gives a manifest without shards.
    Each text is encoded whole; a worker holds one shard's offsets and one batch of texts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = sorted((r["shard"], r["name"], r["docs"], r["ids"]) for r in ordered.mapInArrow(_writer(path, tokenizer, end_id), _SHARD).collect())  # one row a partition
    vocab = max(tokens.encoder(tokenizer).vocab_size - 1, end_id)
    manifest = {"dtype": "<u2" if vocab < 1 << 16 else "<u4", "end_id": end_id, "shards": []}
    base = 0
    for shard, name, n, ids in shards:
        manifest["shards"].append({"shard": shard, "name": name, "docs": n, "ids": ids, "base": base})
        base += ids
    store, root = open_store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> dict:
    store, root = open_store(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class RangedFile:
    """A file of a store that can't be mapped, as an array whose slices are read when they are asked for."""

    def __init__(self, store, path: str, dtype: str):
        self.file, self.dtype = store.open_input_file(path), np.dtype(dtype)
        self.size = self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at(max(0, b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def map_file(path: str, dtype: str) -> np.ndarray | RangedFile:
    """A file as an array: memory-mapped where the store is a file system, else read by ranges."""
    store, at = open_store(path)
    if store.type_name == "local":
        return np.memmap(at, dtype, "r") if store.get_file_info(at).size else np.zeros(0, dtype)
    return RangedFile(store, at, dtype)


def open_shard(path: str, shard: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, doc_ids, offsets, null flags)`` of a shard of the manifest."""
    n = shard["docs"]
    index = map_file(f"{path}/{shard['name']}.idx", "<i8")
    return map_file(f"{path}/{shard['name']}.ids", dtype), index[:n], index[n : 2 * n + 1], index[2 * n + 1 :]


def _reader(path: str, dtype: str, rows_a_batch: int = 4096):
    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                ids, doc_ids, offsets, nulls = open_shard(path, shard, dtype)
                for a in range(0, shard["docs"], rows_a_batch):
                    b = min(a + rows_a_batch, shard["docs"])
                    block, first = ids[int(offsets[a]) : int(offsets[b])], int(offsets[a])
                    crc = [zlib.crc32(block[int(offsets[i]) - first : int(offsets[i + 1]) - first].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc_ids[a:b]), pa.int64(), mask=np.asarray(nulls[a:b]) == 1),
                            pa.array(np.asarray(offsets[a:b]) + shard["base"]),
                            pa.array(np.diff(offsets[a : b + 1])),
                            pa.array(crc, pa.int64()),
                            pa.array([shard["shard"]] * (b - a), pa.int32()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    return read


def read_token_files(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """A row for each document of the files below ``path``: doc_id, start, n_tokens, ids_crc32, shard."""
    manifest = manifest or read_manifest(path)
    shards = [(x["shard"], x["name"], x["docs"], x["ids"], x["base"]) for x in manifest["shards"]]
    listed = spark.createDataFrame(shards, _SHARD + ", base long").repartition(max(1, len(shards)), "name")
    return listed.mapInArrow(_reader(path, manifest["dtype"]), _DOC)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path, manifest).drop("shard")


__all__ = ["RangedFile", "map_file", "op1_token_files", "open_shard", "read_manifest", "read_token_files", "write_token_files"]
