"""Periodic runs of words: stretches that repeat a few words at least so many times.

A text is a sequence of words. Texts are handled some megabytes at a time in numpy: a batch is one sequence of symbols - a number for each word of
each text, and an end mark for each text that equals nothing else - so nothing is shared between texts.

* Prefix doubling gives the suffix array; what it passes through, the classes of all stretches of 1, 2, 4 ... words, is kept as the
  table in which two positions' common words, forward or backward, are found by halving.
* Adjacent suffixes' common prefixes (LCP) and the nearest suffixes in order that begin earlier in the text give the longest previous factor (LPF) of
  each position, and its greedy walk the LZ blocks.
* Main's extensions at each boundary: a run that touches a boundary of blocks and ends in the block behind it has a period below a third of both blocks'
  length, since a longer one would have made the block in front longer. All such periods are tried, one stretch back and one forth.
* A run inside a block stands in the block's earlier copy too: it is copied from there, from buckets of runs by their start, block by block.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import textops

LEAST_WORDS, LEAST_PERIODS = 6, 4
CHUNK_BYTES = 1 << 20
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``(words, first)``: the words as binary values, and for each text the number of its first word; one entry more than texts."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    bounds = offsets - base
    inside = np.append(~textops._SPACE[part], False)
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    head[bounds] = inside[bounds]
    starts = np.flatnonzero(head)
    upto = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside, out=upto[1:])
    ends = np.append(upto[starts], upto[-1])  # words in the text without its white space
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(part[inside[:-1]])])
    return words, np.searchsorted(starts, bounds)


class Suffixes:
    """Suffix array of ``symbols`` with its LCP and the classes of stretches of 2^k symbols. The last symbol, and that of each text's end, is like no other."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        ranked = symbols[self.order]
        fresh = np.ones(n, bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        made = np.where(fresh, 0, -1).astype(np.int8)  # the level that told a suffix from the one before it in order
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        self.levels, step = [rank], 1
        while len(open_):
            at = self.order[open_]
            key = rank[at].astype(np.int64) * n + rank[at + step]
            place = np.argsort(key, kind="stable")
            at, key = at[place], key[place]
            self.order[open_] = at
            fresh = np.ones(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            told = open_[fresh]
            made[told[made[told] < 0]] = len(self.levels)
            rank = rank.copy()
            rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            self.levels.append(rank)
            open_ = open_[~(fresh & np.append(fresh[1:], True))]
            step *= 2
        self.lcp = np.zeros(n + 1, np.int64)  # of each suffix with the one before it in order
        near = np.flatnonzero(made > 0)
        level = made[near].astype(np.int64)
        long = np.left_shift(1, level - 1)
        for k in range(len(self.levels) - 3, -1, -1):
            own = np.flatnonzero(level - 2 >= k)
            a, b = self.order[near[own] - 1] + long[own], self.order[near[own]] + long[own]
            long[own[self.levels[k][a] == self.levels[k][b]]] += 1 << k
        self.lcp[near] = long

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out[self.levels[k][a + out] == self.levels[k][b + out]] += 1 << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those before ``b``; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            i = a - out - (1 << k)
            own = np.flatnonzero(i >= 0)
            i = i[own]
            out[own[self.levels[k][i] == self.levels[k][i + (b - a)[own]]]] += 1 << k
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the length of the longest stretch from it on that also begins earlier, and where that is (-1: nowhere)."""
        n = len(self.order)
        length, source = np.zeros(n, np.int64), np.full(n, -1)
        for side in (-1, 1):
            common = (self.lcp[:-1] if side < 0 else self.lcp[1:]).copy()
            link = np.arange(n) + side  # to the nearest suffix in order that begins earlier: all in between begin later
            own = np.flatnonzero(common > 0)
            own = own[self.order[link[own]] > self.order[own]]
            while len(own):
                via = link[own]
                common[own] = np.minimum(common[own], common[via])
                link[own] = link[via]
                own = own[common[own] > 0]
                own = own[self.order[link[own]] > self.order[own]]
            better = np.flatnonzero(common > length[self.order])
            at = self.order[better]
            length[at], source[at] = common[better], self.order[link[better]]
        return length, source


def lz_blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the blocks: the longest stretch that begins earlier too, else a single symbol."""
    starts, at, step = [], 0, np.maximum(length, 1).tolist()
    while at < len(step):
        starts.append(at)
        at += step[at]
    return np.array(starts, np.int64)


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, 1 ... count) for each count."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def boundary_runs(own: Suffixes, starts: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Main's extensions: (start, end, period) of the runs that touch a boundary of blocks, each with its smallest period."""
    n = len(own.order)
    size = np.diff(starts, append=n)
    before = np.append(0, size[:-1])
    share = max(1, periods - 1)  # a run of so many periods has one less before or behind the boundary
    found = []
    for back in (False, True):
        index, period = _expand((size + before * back) // share)
        a = starts[index] - period * back
        inside = (a >= 0) & (a + period < n)
        a, period = a[inside], period[inside]
        word = own.levels[0]
        likely = (word[a] == word[a + period]) | ((a > 0) & (word[a - 1] == word[a + period - 1]))
        a, period = a[likely], period[likely]
        reach = own.forward(a, a + period) + period
        first = a - own.backward(a, a + period)
        length = a + reach - first
        good = length >= np.maximum(least, periods * period)
        found.append(np.stack([first[good], (a + reach)[good], period[good]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort(runs.T[::-1])]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


def copied_runs(runs: np.ndarray, starts: np.ndarray, size: np.ndarray, source: np.ndarray, least: int) -> np.ndarray:
    """``runs`` and those inside blocks, from the blocks' earlier copies."""
    buckets: dict[int, dict[int, int]] = {}
    for start, end, period in runs.tolist():
        buckets.setdefault(start, {})[end] = period
    order = sorted(buckets)
    for i in np.flatnonzero(size >= least + 2).tolist() if order else ():
        start, shift = int(starts[i]), int(starts[i] - source[starts[i]])
        low, high = start - shift, start - shift + int(size[i])
        at = bisect_right(order, low)
        while at < len(order) and order[at] < high:  # what is added stands behind, and is met if the copy reaches into the block
            for end, period in list(buckets[order[at]].items()):
                if end < high:
                    to = order[at] + shift
                    if to not in buckets:
                        buckets[to] = {}
                        insort(order, to, lo=bisect_left(order, to))
                    buckets[to].setdefault(end + shift, period)
            at += 1
    return np.array([(s, e, p) for s in order for e, p in buckets[s].items()], np.int64).reshape(-1, 3)


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, runs)`` over texts of word numbers: for each run its text, and (start, end, period) in numbers of ``words``; by text, start and period."""
    texts = len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    span = int(words.max(initial=0)) + 2
    symbols = np.empty(len(words) + texts, np.int64)
    symbols[np.arange(len(words)) + text] = words + 1 + text * span
    ends = first[1:] + np.arange(texts)
    symbols[ends] = np.arange(texts) * span
    if not len(words):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    own = Suffixes(symbols)
    length, source = own.previous_factors()
    starts = lz_blocks(length)
    runs = boundary_runs(own, starts, least, periods)
    runs = copied_runs(runs, starts, np.diff(starts, append=len(symbols)), source, least)
    of = np.searchsorted(ends, runs[:, 0])
    runs[:, :2] -= of[:, None]
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    return of[order], runs[order]


def _found(column: pa.Array, least: int, periods: int):
    """For row ranges of a text column: n_words, runs and collapsed texts."""
    data, offsets = textops.utf8(column)
    for a, b in textops.chunks(offsets, CHUNK_BYTES):
        words, first = split_words(data, offsets[a : b + 1])
        text, runs = runs_of(np.asarray(words.dictionary_encode().indices).astype(np.int64), first, least, periods)
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(kept, out=upto[1:])
        left = words if kept.all() else words.filter(pa.array(kept))
        collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto[first]), left).cast(pa.large_list(pa.large_binary())), pa.scalar(b" ", pa.large_binary()))
        spans = np.stack([runs[:, 0] - first[text], runs[:, 1] - runs[:, 0], runs[:, 2]]) if len(runs) else np.zeros((3, 0), np.int64)
        fields = pa.StructArray.from_arrays([pa.array(x) for x in spans], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)), fields)
        yield a, b, pa.array(np.diff(first)), lists, collapsed


def _search(least: int, periods: int):
    def run(batches):
        for batch in textops.released(batches):
            for a, b, n, lists, collapsed in _found(batch.column(1), least, periods):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, lists, collapsed.cast(pa.large_string()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period in words, by start and period) and the collapsed text.

    A run is a stretch of at least ``least`` words and ``periods`` times its smallest period that no neighbour extends; ``periods`` is two or more. The collapsed text
    has all words that no run holds behind its first period, joined by single spaces. Null and wordless texts have no words, no runs and an empty collapsed text.
    Texts don't meet: repeated rows and rows without doc_id count each. A text is read by one task, which needs some 60 bytes a byte of it, and more if it repeats itself at length.
    """
    if periods < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(least, periods), _SCHEMA)


def _with_planted_period(doc_id: Column, text: Column) -> Column:
    """The contract's texts: of documents whose crc32(doc_id) is divisible by ten, the words from one on repeat a stretch of them."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))), " ")

    some = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))  # a lambda's variable is made once
    return F.when(text.isNotNull() & (h % 10 == 0), F.element_at(some, 1)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods at least in all documents: their number, the longest, and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", _with_planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    ahead = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("_best")
    out = found.withColumn("_best", F.array_min(ahead))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.floor(F.lit(1000) * -best["l"] / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
