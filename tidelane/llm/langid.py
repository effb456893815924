"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier for each bit - logistic regression on hashed byte n-grams of letters - says on which side of
a split of the languages a text lies. Decoding is loss-weighted: a codeword's distance is the sum over bits of the logistic loss of the
bit's margin, weighted by how far the bit was right on its training rows, and the nearest codeword wins. A text is flagged as ambiguous
if the runner-up is nearly as near.

Training takes at most ``TRAIN_ROWS`` labelled documents, spread over languages, the smallest by a hash of doc_id and text; all texts, whole,
are predicted. Features of a training text are a bounded vector, made on the executors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm import textops
from tidelane.llm.annotate import add_columns, parse

TRAIN_ROWS, LEAST_ROWS = 1200, 20
BUCKETS, ORDERS = 1 << 13, (1, 2, 3)
AMBIGUOUS = 0.05  # probability by which the nearest codeword must lead
USUAL_MARGIN = 3.0  # the median margin of training rows is brought down to this, so that mixed texts come out as uncertain
UNKNOWN = "und"
CHUNK_BYTES = 1 << 18

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_GRAM = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _grams(part: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that begins at each byte; runs of other characters than letters count as spaces."""
    folded = _FOLD[part].astype(np.uint32)
    out, held = [], np.zeros(len(folded), np.uint32)
    for k in range(max(ORDERS)):
        shifted = np.full(len(folded), 32, np.uint32)
        shifted[: len(folded) - k] = folded[k:] if k else folded
        held = (held ^ (shifted + np.uint32(k + 1))) * _GRAM[k]
        if k + 1 in ORDERS:
            out.append(((held ^ (held >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 13)).astype(np.int64))
    return out


def _pieces(column: pa.Array):
    """(first row, bounds in a part, the part's n-grams) of row ranges; texts longer than a chunk are a part of their own."""
    data, offsets = textops.utf8(column)
    for a, b in textops.chunks(offsets, CHUNK_BYTES):
        base = int(offsets[a])
        part = data[base : int(offsets[b])]
        bounds = offsets[a : b + 1] - base
        yield a, bounds, part


def _slices(part: np.ndarray, bounds: np.ndarray):
    """Parts of at most a few chunks: (row, bytes) with an overlap of an n-gram, so a very long text never is expanded at once."""
    step = 4 * CHUNK_BYTES
    for r, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(x, y, step):
            yield r, part[at : min(at + step + max(ORDERS) - 1, y)], min(step, y - at)


def counts(column: pa.Array) -> np.ndarray:
    """Bucket frequencies of each row, summing to 1 for rows with text."""
    out = np.zeros((len(column), BUCKETS), np.float32)
    for a, bounds, part in _pieces(column):
        for r, own, n in _slices(part, bounds):
            for gram in _grams(own):
                out[a + r] += np.bincount(gram[:n], minlength=BUCKETS)
    total = out.sum(axis=1, keepdims=True)
    return out / np.maximum(total, 1)


def has_letter(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), bool)
    for a, bounds, part in _pieces(column):
        letter = np.zeros(len(part) + 1, np.int64)
        np.cumsum((_FOLD[part] != 32) & (part < 128), out=letter[1:])
        out[a : a + len(bounds) - 1] = letter[bounds[1:]] > letter[bounds[:-1]]
        for r in np.flatnonzero(~out[a : a + len(bounds) - 1]):
            out[a + r] = any(c.isalpha() for c in part[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` codewords of +1 and -1: all splits of up to six languages, else the best of many random codes by its least distance."""
    if n <= 6:
        splits = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(splits, np.int8).T.reshape(n, -1)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, abs(code.astype(int).sum(axis=0)) < n]
        apart = code.shape[1] - code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(apart, 1 << 20)
        best = max(best, (int(apart.min()), code), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of bits

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.bias)))
        total = np.zeros(len(column))
        for a, bounds, part in _pieces(column):
            if len(part) <= CHUNK_BYTES:
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                ends = bounds[1:][some]
                for order, gram in zip(ORDERS, _grams(part), strict=True):
                    value = self.weights[gram]
                    for k in range(1, order):  # n-grams that would run into the next text end in spaces, as they do alone
                        late = ends[n[some] >= k] - k
                        value[late] = self.weights[self._tail(part, late, ends[n[some] >= k], order)]
                    out[a + some] += np.add.reduceat(value, bounds[:-1][some], axis=0, dtype=np.float64)
                total[a + some] += len(ORDERS) * n[some]
            else:
                for r, own, n in _slices(part, bounds):
                    for gram in _grams(own):
                        out[a + r] += self.weights[gram[:n]].sum(axis=0, dtype=np.float64)
                    total[a + r] += len(ORDERS) * n
        return out / np.maximum(total, 1)[:, None] + self.bias

    @staticmethod
    def _tail(part, late, ends, order) -> np.ndarray:
        out = np.zeros(len(late), np.int64)
        for length in np.unique(ends - late):
            own = np.flatnonzero(ends - late == length)
            text = np.full((len(own), max(ORDERS)), 32, np.uint8)
            for j in range(int(length)):
                text[:, j] = part[late[own] + j]
            held = np.zeros(len(own), np.uint32)
            for k in range(order):
                held = (held ^ (_FOLD[text[:, k]].astype(np.uint32) + np.uint32(k + 1))) * _GRAM[k]
            out[own] = (held ^ (held >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 13)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, probabilities and ambiguity flags."""
        n = len(column)
        letters = has_letter(column)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        loss = np.logaddexp(0, -self.margins(column)[:, None, :] * self.code[None]) @ self.trust if len(self.bias) else np.zeros((n, 1))
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lead = p[np.arange(n), best] - (np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else 0)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, p[np.arange(n), best], 0.0), (lead < AMBIGUOUS) | ~letters


def fit_bits(x: np.ndarray, target: np.ndarray, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regressions for all columns of ``target`` (+1, -1) at once, by accelerated gradient steps on scaled features; rows of rare sides weigh more. Scales ``x`` in place; returns weights, biases and margins."""
    scale = 1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4)
    x *= scale
    z = x
    weight = np.where(target > 0, 0.5 / np.maximum((target > 0).mean(axis=0), 1e-9), 0.5 / np.maximum((target < 0).mean(axis=0), 1e-9)) / len(x)
    norm = float(np.einsum("ij,ij->", z, z) / len(z))
    rate = 4.0 / (norm * 2 + 1)
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    v, c = w.copy(), b.copy()
    for t in range(steps):
        margin = np.clip(target * (z @ v + c), -30, 30)
        pull = (-target * weight / (1 + np.exp(margin))).astype(np.float32)
        w_new, b_new = v - rate * (z.T @ pull + l2 * v), c - rate * pull.sum(axis=0)
        v, c = w_new + t / (t + 3) * (w_new - w), b_new + t / (t + 3) * (b_new - b)
        w, b = w_new, b_new
    return (w * scale[:, None]).astype(np.float32), b, z @ w + b


def _features(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.astype(np.float32).tobytes() for x in counts(part.column("text"))], pa.binary())], names=["lang", "x"])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``labelled`` (doc_id, text, lang) of at most ``rows`` rows, but LEAST_ROWS of each language; null text or lang are left out."""
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("_h"))
    rows_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(rows_of)
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    each = max(LEAST_ROWS, rows // len(languages))
    # rows whose hash is below twice the share that is wanted, then the smallest of these: no task gets more than a few samples' rows
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, (2 * each + 50) / rows_of[lang]))])
    near = known.select("lang", "_h").where(F.pmod("_h", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h")
    chosen = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).select("lang", "_h")
    sample = known.join(F.broadcast(chosen.distinct()), ["lang", "_h"], "left_semi").dropDuplicates(["_h"])
    got = sample.select("lang", "text").mapInArrow(_features, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    y = np.array([languages.index(r["lang"]) for r in got])
    code = codewords(len(languages))
    if not code.shape[1]:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    x = np.empty((len(got), BUCKETS), np.float32)
    while got:
        x[len(got) - 1] = np.frombuffer(got.pop()["x"], np.float32)
    target = code[y].astype(np.float32)
    weights, bias, margin = fit_bits(x, target)
    del x
    margin = margin * target
    soften = min(1.0, USUAL_MARGIN / max(float(np.median(abs(margin))), 1e-9))
    weights, bias = weights * np.float32(soften), bias * soften
    right = (margin > 0).mean(axis=0)
    return Model(languages, code, weights, bias.astype(float), np.maximum(2 * right - 1, 0.01))


def _predict(model, doc_id: int, text: int):
    def run(batch):
        ids = batch.column(doc_id).to_pylist()
        names, score, ambiguous = model.value.predict(batch.column(text).cast(pa.string()))
        held_out = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 0 for i in ids]
        return [pa.array(held_out), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous)]

    return run


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text and any others) with _held_out, _lang, _score and _ambiguous appended (replaced, if there): see identify."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("_held_out", "_lang", "_score", "_ambiguous")
    names = [c.lower() for c in docs.columns]
    return add_columns(docs, _predict(shared, names.index("doc_id"), names.index("text")), parse("_held_out boolean, _lang string, _score double, _ambiguous boolean"))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that are not held out: crc32 of doc_id as text is not divisible by 5. A null doc_id counts as an empty text and is held out."""
    return docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score, ambiguous.

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous; so is all if the model knows no language. With one language, it is
    predicted with score 1. Ties go to the first language by name.
    """
    rows = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a classifier of their own labels: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(learnable(docs)))
