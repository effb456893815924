"""Best-fit packing of token sequences into fixed-length training sequences.

Best-fit decreasing over the whole corpus needs no document in one place: what it
decides depends on lengths alone, and there are at most ``capacity`` of them. So
the corpus is reduced to a histogram of lengths; a segment tree over remaining
capacities finds the tightest open bin for each length, taking equal bins and
equal lengths in runs; and the resulting list of runs (at most a few for each pair
of a length and a bin level, whatever the corpus' size) turns each piece's rank
among pieces of its length into a sequence and a place in it. Ranks come from a
range-partitioned sort by (length, doc_id, piece) and prefix sums over partitions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import tokens
from tidelane.storage import materialize, shuffle_partitions

CAPACITY = 4096
END_ID = 1
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity, holding which of them open bins have."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)

    def set(self, remaining: int, some: bool) -> None:
        i = self.size + remaining
        self.some[i] = some
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is ``length`` at least."""
        i = self.size + length
        if i >= 2 * self.size:
            return None
        if self.some[i]:
            return i - self.size
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin): the piece of rank ``first rank + i``
    goes to bin ``first bin + i // pieces a bin`` at ``offset + i % pieces a bin * length``. It places pieces exactly as
    one-at-a-time best-fit decreasing does, up to the choice among bins of equal room.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining -> [(first bin, bins)]
    runs, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_bins[remaining].append((first, n))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
                room = capacity
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
                each = room // length
            full, over = divmod(left, each)
            if n <= full:
                full, over = n, 0
            used = full + bool(over)
            count = full * each + over
            runs.append((length, rank, count, first, each, capacity - room))
            put(room - each * length, first, full)
            if over:
                put(room - over * length, first + full, 1)
            put(room, first + used, n - used)
            rank += count
            left -= count
    return runs


def _cut(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def cut(batches):
        enc = tokens.encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in tokens.trimmed(batches):
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in tokens.groups(texts):
                out = [[], [], [], [], [], []]
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for column, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out[:n], kinds, strict=False)], names=names[:n])

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, append the end id, and cut what is longer than ``capacity``; ``with_ids`` adds the ids as little-endian unsigned 32-bit binary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer or tokens.default_tokenizer(), end_id, capacity, with_ids), _PIECE + ", ids binary" * with_ids)


def _local_ranks(batches):
    """Adds _part and _local, a row's rank among those of its length in a partition sorted by length."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(batch.column("length"))
        local = np.empty(len(lengths), np.int64)
        cuts = np.flatnonzero(np.diff(lengths, prepend=lengths[0] - 1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(lengths)], strict=True):
            local[a:b] = seen[int(lengths[a])] + np.arange(b - a)
            seen[int(lengths[a])] += b - a
        batch = batch.append_column("_part", pa.array(np.full(len(lengths), part, np.int32)))
        yield batch.append_column("_local", pa.array(local))


def _place(plan):
    """``plan``, broadcast: bases by (partition, length), the rank of its first row, and runs, sorted by (length, first rank)."""

    def place(batches):
        bases, runs = plan.value
        lengths, first = np.unique(runs[:, 0], return_index=True)
        at = {x: (a, b) for x, a, b in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(runs)], strict=True)} if len(runs) else {}
        for batch in batches:
            n = batch.num_rows
            lengths, parts, local = (np.asarray(batch.column(c)) for c in ("length", "_part", "_local"))
            sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
            key = parts.astype(np.int64) << 32 | lengths
            for k in np.unique(key).tolist():
                own = np.flatnonzero(key == k)
                length = k & 0xFFFFFFFF
                rank = local[own] + bases[k >> 32, length]
                a, b = at[length]
                run = runs[a + np.searchsorted(runs[a:b, 1], rank, "right") - 1]
                i = rank - run[:, 1]
                sequence[own] = run[:, 3] + i // run[:, 4]
                offset[own] = run[:, 5] + i % run[:, 4] * length
            kept = batch.drop_columns(["_part", "_local"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ids_crc32 and any others), each of 1 to ``capacity`` tokens.

    Repeated rows are pieces of their own; null doc_ids are packed like others; an empty table gives an empty result. What reaches
    the driver: a row for each partition and length in it, of a table range-partitioned by length: partitions + lengths rows at
    most, apart from ties at partition bounds. The broadcast runs are bounded by pairs of lengths and bin levels.
    """
    spark = pieces.sparkSession
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    ordered = pieces.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = materialize(ordered.mapInArrow(_local_ranks, fields + ", _part int, _local long"), "pack-ranked")
    histogram: dict[int, int] = defaultdict(int)
    bases: dict[tuple[int, int], int] = {}
    for part, length, n in sorted(map(tuple, dealt.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")).collect())):
        if not 0 < length <= capacity:
            raise ValueError(f"pieces must have 1 to {capacity} tokens")
        bases[part, length] = histogram[length]
        histogram[length] += n
    runs = np.array(sorted(plan_runs(histogram, capacity)), np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast((bases, runs))
    return dealt.mapInArrow(_place(plan), fields + ", sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(cut_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pack-pieces"))
