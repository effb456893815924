"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Items are bags of words with BM25 weights, each item's divided by its score against itself, so a passage that holds all of an item's
words scores 1. Items are indexed by classes of length, from a power of two to under the next. Passages are windows of twice
the most words of the class, half overlapping, so that any copy of an item lies whole in one of them. Postings are in order of
items, and each term keeps its greatest weight, and its greatest in each block of ``BLOCK_ITEMS`` neighbouring items.

A passage's terms are cursors in their postings (block-max WAND). In the order of the items they stand at, the pivot is the first item that
their greatest weights together could bring to the threshold; if their greatest weights in the pivot's block could not, all go past that
block; else the pivot is scored. So all items at or above the threshold are retrieved, and the others are known not to reach it. Most windows have
no pivot, or none whose block could do: running sums, and sums over ``GROUPS`` groups of blocks, tell that for many windows at once, and cursors
move in the others only.

What is retrieved is verified by the shares of the question's and of the
answer's word shingles that stand in the passage; for those of fewer than ``SHORT`` words, where one changed word spoils too many
shingles, by the share of words that stand in order within a stretch of about their length. Nothing is shuffled; whole texts are read once.

The index is broadcast if the items are at most ``MAX_INDEX_BYTES`` of text. Beyond that there are several, each in tasks of its own. Document
frequencies, numbers and lengths are those of all items in either case, so that results do not depend on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import textops
from tidelane.llm.annotate import add_columns, parse
from tidelane.storage import materialize

THRESHOLD, OVERLAP, WIDTH = 0.6, 0.6, 5
#: With so many words, one changed word leaves OVERLAP of the shingles.
SHORT = 17
BLOCK_ITEMS, GROUPS = 8, 256
K1, B = 1.2, 0.75
MAX_INDEX_BYTES = 64 << 20
_ANSWER = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+(?=\s*\S)")
LEAK = "item_id long, score double, question_overlap double, answer_overlap double, contaminated boolean, start long, end long"
_LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("contaminated", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last sentence is the answer; of a single sentence, all is both."""
    cuts = [m for m in _ANSWER.finditer(text.rstrip())]
    return (text[: cuts[-1].start()], text[cuts[-1].end() :]) if cuts else (text, text)


def _words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = textops.utf8(pa.array(texts, pa.string()))
    hashes, _, _, first = textops.words(data, offsets, textops.NOT_ALNUM)
    return np.split(hashes, first[1:-1]) if texts else []


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    return next(textops.shingles(words, np.array([0, len(words)]), width))


def _verifiable(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Width and shingles of a question or an answer; one of fewer words is a single shingle of its own width."""
    width = max(1, min(WIDTH, len(words)))
    return width, _shingles(words, width)


def _in_order(part: np.ndarray, passage: np.ndarray) -> float:
    """The greatest share of the words of ``part`` that stand in order in a stretch of ``passage`` a quarter longer at most (by one word at least)."""
    n = len(part)
    bits: dict[int, int] = {}
    for i, word in enumerate(part.tolist()):
        bits[word] = bits.get(word, 0) | 1 << i
    at = np.flatnonzero(np.isin(passage, part))
    words, best, whole = passage[at].tolist(), 0, (1 << n) - 1
    for a, b in enumerate(np.searchsorted(at, at + n + max(1, n // 4)).tolist()):
        if b - a > best:
            row = whole  # longest common subsequence, bit-parallel
            for word in words[a:b]:
                own = row & bits[word]
                row = (row + own | row - own) & whole
            best = max(best, n - row.bit_count())
    return best / n


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of ranges of ``n`` from ``begin``, one range after another."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


@dataclass
class Statistics:
    """Of all items with words: their number, mean length, and the number of items that hold a term (None: counted in the items given)."""

    items: int
    length: float
    frequencies: dict[int, int] | None = None


class Postings:
    """Postings of one class of items, by term of the whole index: item, weight, and greatest weights by term and by block."""

    def __init__(self, items: list[int], term: np.ndarray, item: np.ndarray, weight: np.ndarray, terms: int, longest: int):
        self.items, self.longest, self.n = items, longest, len(items)
        order = np.lexsort((item, term))
        self.term, self.item, self.weight = term[order], item[order], weight[order]
        self.at = np.searchsorted(self.term, np.arange(terms + 1))
        self.key = self.term * (self.n + 1) + self.item
        self.blocks = -(-self.n // BLOCK_ITEMS)
        block_key = self.term * (self.blocks + 1) + self.item // BLOCK_ITEMS
        head = np.flatnonzero(np.diff(block_key, prepend=-1))
        self.block_key, self.block_max = block_key[head], (np.maximum.reduceat(self.weight, head) if len(head) else self.weight)
        self.greatest = np.zeros(terms)
        np.maximum.at(self.greatest, self.term, self.weight)
        wide = BLOCK_ITEMS * max(1, -(-self.blocks // GROUPS))
        group_key = self.term * GROUPS + self.item // wide
        head = np.flatnonzero(np.diff(group_key, prepend=-1))
        self.group, self.group_max = group_key[head] % GROUPS, (np.maximum.reduceat(self.weight, head) if len(head) else self.weight)
        self.group_at = np.searchsorted(group_key[head] // GROUPS, np.arange(terms + 1))

    def hopeful(self, term: np.ndarray, known: np.ndarray, begin: np.ndarray, end: np.ndarray, slack: float, step: int = 512):
        """Which windows [begin, end) of words have a group of items whose greatest weights for their distinct terms reach ``slack`` together."""
        total = len(self.greatest)
        for a in range(0, len(begin), step):
            b, e = begin[a : a + step], end[a : a + step]
            at = _spread(b, e - b)
            window = np.repeat(np.arange(len(b)), e - b)[known[at]]
            key = np.unique(window * total + term[at[known[at]]])
            window, own = key // total, key % total
            some = (np.bincount(window, self.greatest[own], len(b)) >= slack)[window]
            window, own = window[some], own[some]
            n = self.group_at[own + 1] - self.group_at[own]
            at = _spread(self.group_at[own], n)
            bound = np.bincount(np.repeat(window, n) * GROUPS + self.group[at], self.group_max[at], len(b) * GROUPS).reshape(-1, GROUPS)
            yield from (np.flatnonzero(bound.max(axis=1) >= slack) + a).tolist()

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item of the index, score) at or above the threshold for a passage of these distinct terms."""
        slack = threshold - 1e-9
        terms = terms[self.greatest[terms] > 0]
        bound, last = self.greatest[terms], self.at[terms + 1]
        if bound.sum() < slack:
            return []
        cursor, out = self.at[terms].copy(), []
        now = self.item[cursor]
        while True:
            order = np.argsort(now, kind="stable")
            pivot_at = int(np.searchsorted(np.cumsum(bound[order]), slack))
            if pivot_at == len(order) or now[order[pivot_at]] == self.n:
                return out
            pivot = int(now[order[pivot_at]])
            own = np.flatnonzero(now <= pivot)
            to, block = pivot, pivot // BLOCK_ITEMS
            key = terms[own] * (self.blocks + 1) + block
            at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            if self.block_max[at[self.block_key[at] == key]].sum() < slack:
                after = now[now > pivot]
                to = min((block + 1) * BLOCK_ITEMS, int(after.min()) if len(after) else self.n)
            cursor[own] = np.searchsorted(self.key, terms[own] * (self.n + 1) + to)
            now[own] = np.where(cursor[own] < last[own], self.item[np.minimum(cursor[own], len(self.item) - 1)], self.n)
            if to == pivot:
                own = np.flatnonzero(now == pivot)
                score = float(self.weight[cursor[own]].sum())
                if score >= slack:
                    out.append((self.items[pivot], score))
                cursor[own] += 1
                now[own] = np.where(cursor[own] < last[own], self.item[np.minimum(cursor[own], len(self.item) - 1)], self.n)


class Index:
    """An inverted index of (item_id, question, answer) with block maxima; items of other words than any are left out."""

    def __init__(self, items: list[tuple[int | None, str, str]], known: Statistics | None = None):
        bags = _bags(items)
        keep = [i for i, w in enumerate(bags) if len(w)]
        self.ids = [items[i][0] for i in keep]
        bags = [bags[i] for i in keep]
        parts = [_words([items[i][c] for i in keep]) for c in (1, 2)]
        self.question, self.answer = ([_verifiable(w) for w in part] for part in parts)
        self.short = [[w if 0 < len(w) < SHORT else None for w in pair] for pair in zip(*parts, strict=True)]
        length = np.array([len(w) for w in bags], float)
        self.terms, term, item, count = self._cells(bags)
        known = known or Statistics(len(bags), float(length.mean()) if len(bags) else 1.0)
        if known.frequencies is None:
            df = np.bincount(term, minlength=len(self.terms))
        else:
            df = np.array([known.frequencies[int(t)] for t in self.terms.view(np.int64)], float)
        idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / max(1.0, known.length)))
        weight /= np.bincount(item, weight, len(bags))[item] if len(bags) else 1.0
        size = np.array([len(w).bit_length() for w in bags])
        self.classes = []
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            place = np.full(len(bags), -1)
            place[own] = np.arange(len(own))
            cells = np.flatnonzero(place[item] >= 0)
            self.classes.append(Postings(own.tolist(), term[cells], place[item[cells]], weight[cells], len(self.terms), (1 << k) - 1))

    @staticmethod
    def _cells(bags):
        flat = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        terms, at = np.unique(flat, return_inverse=True)
        item = np.repeat(np.arange(len(bags)), [len(w) for w in bags])
        pairs, count = np.unique(at.astype(np.int64) * max(1, len(bags)) + item, return_counts=True)
        return terms, pairs // max(1, len(bags)), pairs % max(1, len(bags)), count.astype(float)

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of any length at or above the threshold for a passage of these distinct terms."""
        return [x for own in self.classes for x in own.retrieve(terms, threshold)]

    def leaks(self, column: pa.Array, threshold: float, overlap: float):
        """For each row with any, (row, leaks): its retrieved items that share a shingle or are contaminated, each with its best passage."""
        if not self.ids:
            return
        data, offsets = textops.utf8(column)
        for a, b in textops.chunks(offsets):
            hashes, starts, ends, first = textops.words(data, offsets[a : b + 1], textops.NOT_ALNUM)
            term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            known = self.terms[term] == hashes
            n = np.diff(first)
            found: dict[int, dict[int, tuple]] = {}
            for own in self.classes:
                sums = np.zeros(len(hashes) + 1)
                np.cumsum(np.where(known, own.greatest[term], 0), out=sums[1:])
                windows = np.maximum(1, -(-n // own.longest) - 1)
                row = np.repeat(np.arange(b - a), windows)
                k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                begin = first[row] + k * own.longest
                end = np.minimum(begin + 2 * own.longest, first[row + 1])
                slack = threshold - 1e-9
                some = np.flatnonzero(sums[end] - sums[begin] >= slack)
                row, begin, end = row[some], begin[some], end[some]
                for w in own.hopeful(term, known, begin, end, slack):
                    i, j = int(begin[w]), int(end[w])
                    for item, score in own.retrieve(np.unique(term[i:j][known[i:j]]), threshold):
                        self._verify(found.setdefault(int(row[w]), {}), item, score, hashes[i:j], overlap, (int(starts[i]), int(ends[j - 1])))
            for r, best in sorted(found.items()):
                base = int(offsets[a + r])
                out = []
                for item, (passes, question, answer, score, x, y) in sorted(best.items()):
                    x, y = (len(data[base:z].tobytes().decode()) for z in (x, y))
                    out.append({"item_id": self.ids[item], "score": score, "question_overlap": question, "answer_overlap": answer, "contaminated": passes, "start": x, "end": y})
                if out:
                    yield a + r, out

    def _verify(self, best: dict[int, tuple], item: int, score: float, passage: np.ndarray, overlap: float, span: tuple[int, int]) -> None:
        """Notes in ``best`` the passage if it shares a shingle with the item or is contaminated, and is better than what is noted."""
        parts = (self.question[item], self.answer[item])
        own = {width: _shingles(passage, width) for width in {width for width, _ in parts} if width <= len(passage)}
        shares = [float(np.isin(x, own.get(width, x[:0]), assume_unique=True).mean()) if len(x) else 1.0 for width, x in parts]
        shared = max(shares) > 0
        shares = [x if w is None else _in_order(w, passage) for x, w in zip(shares, self.short[item], strict=True)]
        rank = (min(shares) >= overlap, *shares, score)
        if (shared or rank[0]) and (item not in best or rank > best[item][:4]):
            best[item] = (*rank, *span)


def _find(index, threshold: float, overlap: float, text: int):
    def run(batch):
        out: list[list] = [[] for _ in range(batch.num_rows)]
        for row, found in index.value.leaks(batch.column(text).cast(pa.string()), threshold, overlap):
            out[row] = found
        return [pa.array(out, pa.list_(_LEAK))]

    return run


def _bags(items) -> list[np.ndarray]:
    return _words([f"{q}\n{a}" if q != a else q for _, q, a in items])


def _pair(q: str, a: str | None) -> tuple[str, str]:
    return split_item(q) if a is None else (q, a)


def _item_terms(batches):
    """The distinct terms of each item, with its part, and a row of its length."""
    for batch in batches:
        parts = batch.column("part").to_pylist()
        bags = _bags([(None, *_pair(q, a)) for q, a in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist(), strict=True)])
        for part, words in zip(parts, bags, strict=True):
            if len(words):
                terms = np.unique(words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * (len(terms) + 1), pa.int32()), pa.array([*terms.tolist(), None], pa.int64()), pa.array([None] * len(terms) + [len(words)], pa.int64())], names=["part", "term", "length"])


def _indexes(benchmark: DataFrame, max_bytes: int):
    """Indexes whose texts have about ``max_bytes`` together at most, unless one item has more; statistics are of all items."""
    has = {c.lower() for c in benchmark.columns}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    question = F.coalesce(F.col("question").cast("string"), text) if {"question", "answer"} <= has else text
    answer = F.coalesce(F.col("answer").cast("string"), F.lit("")) if {"question", "answer"} <= has else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), question.alias("q"), answer.alias("a"))
    size = items.agg(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-size * 5 // (4 * max_bytes))) if size > max_bytes else 1
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "q"), F.lit(parts)).cast("int"))
    if parts > 1:
        terms = materialize(items.mapInArrow(_item_terms, "part int, term long, length long"), "benchmark-terms")
        n, length = terms.where("term IS NULL").agg(F.count(F.lit(1)), F.avg("length")).first()
        counts = materialize(terms.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "benchmark-counts")
    for part in range(parts):
        known = None
        if parts > 1:
            own = terms.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct()
            known = Statistics(n, length or 1.0, {r["term"]: r["df"] for r in own.join(counts, "term").collect()})
        rows = sorted(items.where(F.col("part") == part).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["q"]))
        yield Index([(r["item_id"], *_pair(r["q"], r["a"])) for r in rows], known)


def annotate(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", threshold: float = THRESHOLD, overlap: float = OVERLAP, max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` with all its columns and, in ``column`` (replaced if there), an array of leaks: see LEAK.

    A leak is a pair of a document and an item (item_id, text, or question and answer) whose best passage scores ``threshold`` at least and
    shares a shingle or is contaminated; it is contaminated if the shares of the question and of the answer both reach ``overlap``, and passages where
    they do come first. start and end bound the passage, in characters. Null and empty texts have none; null or wordless items match nothing; repeated items and
    rows are judged each. With an empty benchmark or table the arrays or the result are empty.
    """
    spark = docs.sparkSession
    out = docs.drop(column)
    kind = "array<struct<" + ",".join(x.replace(" ", ":") for x in LEAK.split(", ")) + ">>"
    at = [c.lower() for c in out.columns].index("text")
    found = [add_columns(out, _find(spark.sparkContext.broadcast(index), threshold, overlap, at), parse(f"`{column}` {kind}")) for index in _indexes(benchmark, max_bytes)]
    if len(found) == 1:
        return found[0]
    # Each index has tasks of its own; a row meets what they found by its text.
    text = F.col("text").cast("string")
    some = [x.where(F.size(column) > 0).select(F.xxhash64(text).alias("_h1"), F.sha1(text.cast("binary")).alias("_h2"), F.col(column).alias("_own")) for x in found]
    union = some[0]
    for x in some[1:]:
        union = union.union(x)
    # A part's indexes give a text the same leaks in every row that has it.
    union = union.distinct().groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("_own")).alias("_own"))
    met = out.withColumns({"_g1": F.xxhash64(text), "_g2": F.sha1(text.cast("binary"))})
    joined = met.join(union, (F.col("_g1") == F.col("_h1")) & (F.col("_g2") == F.col("_h2")), "left")
    order = F.array_sort(F.coalesce("_own", F.array().cast(kind)), lambda x, y: F.when(x["item_id"].isNull() & y["item_id"].isNull(), 0).when(x["item_id"].isNull(), 1).when(y["item_id"].isNull(), -1).when(x["item_id"] < y["item_id"], -1).when(x["item_id"] > y["item_id"], 1).otherwise(0))
    return joined.withColumn(column, order).drop("_g1", "_g2", "_h1", "_h2", "_own")


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each leak of :func:`annotate`, with its doc_id."""
    marked = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, **options)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that have a contaminated leak."""
    marked = annotate(docs, benchmark, column="_tidelane_leaks", **options)
    return marked.where(~F.exists("_tidelane_leaks", lambda x: x["contaminated"])).drop("_tidelane_leaks")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks of all documents with the benchmark's items: doc_id and LEAK."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
