"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams (bytes of the lower-case word between two spaces), a stretch of words the mean of its words, and a linear
softmax over the two labels reads it. Embeddings and softmax are trained together, so a misspelt word that was never seen has the vectors of the n-grams that it shares
with known ones. A text scores as its likeliest stretch of ``WINDOW`` words: averaged over thousands of words, a few insults would vanish. A word that repeats the one
before it doesn't count. Training takes a document's label for each of its stretches; what toxic and other documents have in common cancels out.

Training takes at most ``TRAIN_ROWS`` labelled documents, of either label as many as there are up to half, the smallest by a hash of doc_id, and from each at most
``WINDOWS`` stretches, spread over the whole text. A quarter of the documents are held apart: on them, scores become probabilities at the true share of labels.
All texts, whole, are scored. As both layers are linear, scoring looks one number up for each n-gram.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm import textops

TRAIN_ROWS, WINDOW = 4000, 8
#: Stretches that a document gives to training; one of over LONGEST bytes isn't used.
WINDOWS, LONGEST = 16, 4096
BUCKET_BITS, ORDERS, SIZE = 16, (3, 4, 5), 4
STEPS, RATE, DAMP = 100, 0.15, 10.0
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 18

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
for _digit, _letter in zip(b"013457", b"oieast", strict=True):  # digits that stand for letters
    _FOLD[_digit] = _letter
_GRAM = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a space before each text and behind the last, and where texts begin in them; one entry more than texts."""
    part = data[int(offsets[0]) : int(offsets[-1])]
    texts = len(offsets) - 1
    begins = offsets - offsets[0] + np.arange(1, texts + 2)
    out = np.full(len(part) + texts + 2, 32, np.uint8)
    out[np.arange(len(part)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = _FOLD[part]
    return out, begins


def _grams(folded: np.ndarray):
    """For each order: where the n-grams' second bytes stand, which are letters of their words, and their buckets. Spaces are first or last only."""
    letter = folded != 32
    before = np.zeros(len(folded) + 1, np.int32)
    np.cumsum(letter, out=before[1:])
    wide = folded.astype(np.uint32)
    held = np.zeros(len(folded), np.uint32)
    for k in range(max(ORDERS)):
        held = (held[: len(folded) - k] ^ (wide[k:] + np.uint32(k + 1))) * _GRAM[k]
        n = k + 1
        if n in ORDERS:
            at = np.flatnonzero(before[n - 1 : n - 1 + len(held)] - before[1 : len(held) + 1] == n - 2)
            own = held[at]
            yield at + 1, ((own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _word_starts(folded: np.ndarray) -> np.ndarray:
    letter = folded != 32
    return np.flatnonzero(letter[1:] & ~letter[:-1]) + 1


def word_scores(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of ``table`` over each word's n-grams, and the number of each text's first word; one entry more than texts. Words that repeat the one before are left out."""
    folded, begins = _laid_out(data, offsets)
    starts = _word_starts(folded)
    total, count = np.zeros(len(folded), np.float32), np.zeros(len(folded), np.float32)
    for at, bucket in _grams(folded):
        total[at] += table[bucket]
        count[at] += 1
    if not len(starts):
        return np.zeros(0), np.zeros(len(offsets), np.int64)
    size = np.add.reduceat(count, starts, dtype=np.float64)
    score = np.add.reduceat(total, starts, dtype=np.float64) / size
    first = np.searchsorted(starts, begins)
    fresh = np.ones(len(starts) + 1, bool)
    fresh[1:-1] = (score[1:] != score[:-1]) | (size[1:] != size[:-1])  # words of one length and score are the same
    fresh[first] = True
    upto = np.append(0, np.cumsum(fresh[:-1]))
    return score[fresh[:-1]], upto[first]


def _long_text(table: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Word scores of a text of any length, a slice at a time; slices end between words, or within a word that fills one."""
    out, at = [], 0
    while at < len(text):
        to = min(at + 4 * CHUNK_BYTES, len(text))
        if to < len(text):
            gap = np.flatnonzero(_FOLD[text[at:to]] == 32)
            to = at + int(gap[-1]) + 1 if len(gap) else to
        out.append(word_scores(table, text, np.array([at, to]))[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0)


def peaks(score: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The greatest mean of ``window`` neighbouring word scores of each text, of all if it has fewer; -inf without words."""
    out = np.full(len(first) - 1, -np.inf)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        upto = np.append(0, np.cumsum(score))
        head, end = np.repeat(first[some], np.diff(first)[some]), np.repeat(first[some + 1], np.diff(first)[some])
        at = np.arange(first[0], first[-1])
        to = np.minimum(at + window, end)
        mean = np.where((at + window <= end) | (at == head), (upto[to] - upto[at]) / (to - at), -np.inf)
        out[some] = np.maximum.reduceat(mean, first[some])
    return out


@dataclass
class Model:
    table: np.ndarray  # by bucket: what a word gains for label 1 against 0
    slope: float
    bias: float
    base: float  # score of a text without words

    def peaks(self, column: pa.Array) -> np.ndarray:
        data, offsets = textops.utf8(pc.utf8_lower(column.cast(pa.large_string())))
        out = np.zeros(len(column))
        for a, b in textops.chunks(offsets, CHUNK_BYTES):
            if offsets[b] - offsets[a] > 4 * CHUNK_BYTES:
                score = _long_text(self.table, data[offsets[a] : offsets[b]])
                out[a] = peaks(score, np.array([0, len(score)]))[0]
            else:
                out[a:b] = peaks(*word_scores(self.table, data, offsets[a : b + 1]))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        peak = self.peaks(column)
        worded = np.isfinite(peak)
        z = np.clip(self.slope * np.where(worded, peak, 0) + self.bias, -500, 500)
        return np.where(worded, 1 / (1 + np.exp(-z)), self.base)


def _windows(batches):
    """Stretches of the texts of (toxic, text) for training, spread over each text, as folded words."""
    for batch in batches:
        found = []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _FOLD[np.frombuffer(text.lower().encode(), np.uint8)].tobytes().split()
            words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
            cut = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
            if len(cut) > 1 and len(cut[-1]) < WINDOW:
                cut[-1] = words[-WINDOW:]
            some = np.unique(np.linspace(0, len(cut) - 1, min(len(cut), WINDOWS)).astype(int)) if cut else []
            stretches = [x for x in (b" ".join(cut[i]) for i in some) if len(x) <= LONGEST]
            found.append({"toxic": toxic, "windows": stretches})
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("toxic", pa.int32()), ("windows", pa.list_(pa.binary()))]))


class Bag:
    """Sparse means: row r is the mean of the columns listed for it."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int):
        order = np.argsort(row, kind="stable")
        self.row, self.column = row[order], column[order]
        self.at = np.searchsorted(self.row, np.arange(rows))
        self.weight = (1 / np.bincount(self.row, minlength=rows)).astype(np.float32)
        self.back = np.argsort(self.column, kind="stable")
        by_column = self.column[self.back]
        self.used = by_column[np.flatnonzero(np.diff(by_column, prepend=-1))] if len(by_column) else by_column
        self.starts = np.searchsorted(by_column, self.used)
        self.columns = columns

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.column], self.at, axis=0) * self.weight[:, None]

    def spread(self, pull: np.ndarray) -> np.ndarray:
        """The gradient by columns of a gradient by rows."""
        out = np.zeros((self.columns, pull.shape[1]), np.float32)
        out[self.used] = np.add.reduceat((pull * self.weight[:, None])[self.row[self.back]], self.starts, axis=0)
        return out


def fit(windows: list[bytes], toxic: np.ndarray, seed: int = 13) -> np.ndarray:
    """The table of a model trained on ``windows`` (folded words) with the labels of their documents. Embeddings and softmax move together, by all windows at once.

    Steps are scaled by each weight's own usual gradient and by that of all (DAMP): by its own alone, n-grams seen once or twice would be learnt by heart.
    """
    data, offsets = textops.utf8(pa.array(windows, pa.binary()))
    folded, begins = _laid_out(data, offsets)
    starts = _word_starts(folded)
    spans = [folded[a:b].tobytes().rstrip() for a, b in zip(starts.tolist(), np.append(starts[1:], len(folded)).tolist(), strict=True)]
    coded = pa.array(spans, pa.binary()).dictionary_encode()
    laid, word_begins = _laid_out(*textops.utf8(coded.dictionary))
    gram_word, gram = [], []
    for at, bucket in _grams(laid):
        gram_word.append(np.searchsorted(word_begins, at, "right") - 1)
        gram.append(bucket)
    kinds, of_gram = np.unique(np.concatenate(gram), return_inverse=True)
    in_word = Bag(np.concatenate(gram_word), of_gram, len(coded.dictionary), len(kinds))
    in_window = Bag(np.searchsorted(begins, starts, "right") - 1, np.asarray(coded.indices).astype(np.int64), len(windows), len(coded.dictionary))

    rng = np.random.default_rng(seed)
    side = rng.normal(0, 0.5, (SIZE, 1)).astype(np.float32)
    embed, soft, bias = rng.normal(0, 0.01, (len(kinds), SIZE)).astype(np.float32), np.concatenate([-side, side], axis=1), np.zeros(2, np.float32)
    want = np.stack([1 - toxic, toxic], axis=1).astype(np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (embed, soft, bias)]
    for step in range(1, STEPS + 1):
        held = in_window.mean(in_word.mean(embed))
        logit = held @ soft + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        pull = ((p / p.sum(axis=1, keepdims=True) - want) / len(want)).astype(np.float32)
        gradients = (in_word.spread(in_window.spread(pull @ soft.T)), held.T @ pull, pull.sum(axis=0))
        for x, g, (mean, square) in zip((embed, soft, bias), gradients, moments, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.02 * (g * g - square)
            usual = square / (1 - 0.98**step)
            x -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(usual + DAMP * usual.mean()) + 1e-12)
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    table[kinds] = embed @ (soft[:, 1] - soft[:, 0])
    return table


def calibrate(peak: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve from peaks to probabilities, by Newton's steps; targets are drawn in a little, so that parted labels give a finite slope."""
    if not len(peak):
        return 1.0, 0.0
    scale = float(np.std(peak)) or 1.0
    x = np.stack([peak / scale, np.ones(len(peak))], axis=1)
    share = [(weight * (toxic == y)).sum() for y in (0, 1)]
    n = [(toxic == y).sum() for y in (0, 1)]
    target = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    w = weight / weight.sum() * len(peak)
    beta = np.array([1.0, np.log(max(share[1], 1e-9) / max(share[0], 1e-9))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - target)) + 1e-3 * beta * [1, 0]
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        move = np.linalg.solve(hessian, gradient)
        beta -= move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return max(0.0, float(beta[0])) / scale, float(beta[1])


def learnable(rows: DataFrame) -> DataFrame:
    """The rows that are not held out: crc32 of doc_id as text is not 2 modulo 4. A null doc_id counts as an empty text, and has no label."""
    return rows.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text, _apart) of at most ``rows`` labelled documents, a text for each; and the number of labels of each kind."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(13)))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return docs.sparkSession.createDataFrame([], "toxic int, text string, _apart boolean"), totals
    each = rows // 2
    share = F.create_map(*[F.lit(x) for kind, n in totals.items() for x in (kind, min(1.0, (2 * each + 50) / n))])
    near = known.where(F.pmod("_h", F.lit(1 << 30)) / float(1 << 30) < share[F.col("toxic")])
    first = Window.partitionBy("toxic").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h")
    chosen = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).select("doc_id", "toxic").distinct()
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return own.select("toxic", "text", (F.xxhash64("doc_id", F.lit(31)) % 4 == 0).alias("_apart")), totals


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1) of at most ``rows`` documents.

    Null texts and labels are left out; of a repeated doc_id one text is taken, and labels that contradict each other count both. If labels are all of one kind, every score is that kind's
    share of labels; without labels it is 0.
    """
    spark = docs.sparkSession
    sample, totals = _sample(docs, labels, rows)
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    empty = Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, float(np.log(max(base, 1e-9) / max(1 - base, 1e-9))), base)
    if len(totals) < 2:
        return empty
    got = sample.where("NOT _apart").select("toxic", "text").mapInArrow(_windows, "toxic int, windows array<binary>").collect()
    got = sorted(((r["toxic"], [bytes(x) for x in r["windows"]]) for r in got if r["windows"]), key=lambda r: (r[0], r[1]))
    toxic = np.array([t for t, x in got for _ in x])
    if len(set(toxic.tolist())) < 2:
        return empty
    table = fit([w for _, x in got for w in x], toxic)
    shared = spark.sparkContext.broadcast(Model(table, 1.0, 0.0, 0.0))

    def peaked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.peaks(batch.column(1)))], names=["toxic", "peak"])

    apart = [(r["toxic"], r["peak"]) for r in sample.where("_apart").select("toxic", "text").mapInArrow(peaked, "toxic int, peak double").collect() if np.isfinite(r["peak"])]
    kind, peak = np.array([t for t, _ in apart]), np.array([x for _, x in apart])
    if len(set(kind.tolist())) < 2:
        return empty
    weight = np.where(kind == 1, totals[1] / (kind == 1).sum(), totals[0] / (kind == 0).sum())
    slope, bias = calibrate(peak, kind, weight)
    return Model(table, slope, bias, base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from a score of THRESHOLD on).

    Null texts and texts without letters or digits score the share of label 1. Repeated rows count each. A word of over a megabyte may count as several.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in textops.released(batches):
            ids = batch.column(0).to_pylist()
            held = [zlib.crc32(str("" if i is None else i).encode()) % 4 == 2 for i in ids]
            values = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a model of the labels that aren't held out: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(learnable(docs), learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
