"""Substring dedup by hashing units: lines, paragraphs, sentences, phrases or passages.

Units are normalised (A-Z as a-z, white space runs as one), and each is keyed by a digest of itself and as many units before it as are
needed to hold ``min_words`` words (by default, one for lines and paragraphs, so that each counts by itself), so that short parts of a line
count only within a repeated passage. Of equal keys, the one that is ranked
first - by doc_id, then position - stays; for the others, the units under the key are removed. So every removed unit has an equal one
that is ranked earlier, and what remains keeps its place in the original text as spans.

Lines and paragraphs miss a passage that was pasted into a line. Phrases end at line breaks, after ``.``, ``!`` or ``?``, and after words
that a hash picks (one in sixteen), which are the same words wherever a passage stands. Passages, the default, also end at the ideographic
full stop and full-width marks, and instead at the word of least hash of every eight neighbouring ones, so that equal runs of words have equal
ends, the first and last within eight words of theirs and the others at most eight apart. Words are cut further for them: in scripts without
spaces, and where a word is long, after the character of least hash of every few. Every whole line and paragraph is keyed by its own digest
as well, whatever its length and whatever stands before it.

Each task keeps only the first of its occurrences of a key and knows the others to be removable at once; just the firsts, packed by range
of keys, are shuffled. A key that a third of all documents hold thus reaches its reducer once for each batch of half a million units. There are
at least ``_RANGES`` ranges of keys a partition, and as many as keep each at about ``_RANGE_KEYS`` by the texts' bytes; they are sorted in it, and a task holds one at a time. A document's marks are
as many as its repeated units, and are held with its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import textops
from tidelane.llm.annotate import add_columns, parse
from tidelane.storage import materialize, shuffle_partitions

#: Words that a key holds at least, by kind of unit.
MIN_WORDS = {"line": 1, "paragraph": 1, "sentence": 8, "phrase": 8, "passage": 20}
_FLUSH = 1 << 19
_RANGES, _RANGE_KEYS = 8, 1 << 21
_KEY_BYTES = 16  # bytes of text for each key, at least about
_STRONG = np.zeros(256, bool)
_STRONG[[ord(c) for c in ".!?"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 13]] = True
_R1, _R2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
KINDS = ("line", "paragraph", "sentence", "phrase")
PASSAGE = "passage"  # parts of lines with winnowed ends, and whole lines and paragraphs of any length
#: Of so many neighbouring words, or characters of a script without spaces or of a word of over _LONG bytes, one is an end.
_NEAR_WORDS, _NEAR_DENSE, _NEAR_LONG, _LONG = 8, 4, 16, 64


def _spaceless() -> np.ndarray:
    """By the first two bytes of a character: whether its script has no spaces (Thai to Myanmar, Khmer, Han, Kana, full-width forms)."""
    out = np.zeros((256, 256), bool)
    for lead, low, high in ((0xE0, 0xB8, 0xBF), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xE2, 0xBA, 0xBF), (0xEF, 0xA4, 0xAB), (0xEF, 0xBC, 0xBE), (0xF0, 0xA0, 0xBF)):
        out[lead, low : high + 1] = True
    out[0xE3:0xEA, 0x80:0xC0] = True
    return out.ravel()


_DENSE = _spaceless()


def _least(hashes: np.ndarray, group: np.ndarray, near: int) -> np.ndarray:
    """Whether each is the last least one of any ``near`` neighbours of the same group; groups are contiguous."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) >= near:
        n = len(hashes) - near + 1
        at = np.flatnonzero(group[near - 1 :] == group[:n])
        best, least = hashes[near - 1 :].copy(), np.full(n, near - 1, np.int8)
        for k in range(near - 2, -1, -1):
            less = hashes[k : k + n] < best
            np.copyto(best, hashes[k : k + n], where=less)
            least[less] = k
        out[at + least[at]] = True
    return out


def _full_stop(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether U+3002, U+FF01 or U+FF1F stands before each of ``ends``."""
    x, y, z = (data[np.maximum(ends - k, 0)] for k in (3, 2, 1))
    return (ends >= 3) & ((x == 0xE3) & (y == 0x80) & (z == 0x82) | (x == 0xEF) & (y == 0xBC) & ((z == 0x81) | (z == 0x9F)))


def _cut_words(data, hashes, starts, ends, first):
    """The words, with those in scripts without spaces and the long ones cut at characters that are the same wherever a passage stands."""
    if not len(starts):
        return hashes, starts, ends, first
    base, stop = int(starts[0]), int(ends[-1])
    part = data[base:stop]
    dense = np.zeros(len(part), bool)
    lead = np.flatnonzero(part[:-1] >= 0xE0)
    dense[lead[_DENSE[part[lead].astype(np.int64) * 256 + part[lead + 1]]]] = True
    word_long = ends - starts > _LONG
    if not dense.any() and not word_long.any():
        return hashes, starts, ends, first
    head = np.flatnonzero((part & 0xC0) != 0x80)  # characters
    word = np.searchsorted(starts, head + base, "right") - 1
    word_dense = np.zeros(len(starts), bool)
    word_dense[word[dense[head]]] = True
    own = (head + base < ends[word]) & (word_dense | word_long)[word]
    head, word, size = head[own], word[own], np.diff(head, append=len(part))[own]
    code = np.zeros(len(head), np.uint64)
    for k in range(4):
        code = code << np.uint64(8) | np.where(k < size, textops._LOWER[part[np.minimum(head + k, len(part) - 1)]], 0).astype(np.uint64)
    code = textops.mix64(code ^ _R2)
    kind = dense[head]
    edge = np.append(True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]))  # a run of one kind in a word
    run = np.cumsum(edge) - 1
    end = np.append(edge[1:], True)
    end |= kind & (_least(code, run, _NEAR_DENSE) | _full_stop(data, ends=np.minimum(head + 3, len(part)) + base))
    end |= ~kind & word_long[word] & _least(code, run, _NEAR_LONG)
    begin = head[np.append(True, end[:-1])] + base
    new = np.union1d(starts, begin)
    at = np.searchsorted(starts, new, "right") - 1
    till = np.minimum(ends[at], np.append(new[1:], stop))
    bounds = np.append(starts, stop)[first] if len(first) else first
    return _byte_hashes(data, new, till), new, till, np.append(np.searchsorted(new, bounds[:-1]), len(new))


def _byte_hashes(data, starts, ends) -> np.ndarray:
    """Hashes of the bytes [start, end), A-Z as a-z, as textops.words gives them."""
    base = int(starts[0])
    part = data[base : int(ends[-1])]
    power = np.cumprod(np.full(len(part), textops._R, np.uint64))
    inverse = np.cumprod(np.full(len(part), textops._R_INV, np.uint64))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(textops._BYTE_LOWER[part] * power, out=sums[1:])
    return textops.mix64((sums[ends - base] - sums[starts - base]) * inverse[starts - base] + (ends - starts).astype(np.uint64))


def _unit_ends(data, hashes, starts, ends, first, kind: str) -> np.ndarray:
    """Indices of the words that end a unit."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    last = np.zeros(n, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    base = int(starts[0])
    breaks = np.zeros(int(ends[-1]) - base + 1, np.int32)
    np.cumsum(data[base : int(ends[-1])] == 10 if kind == "paragraph" else _BREAK[data[base : int(ends[-1])]], out=breaks[1:])
    between = np.diff(breaks[starts - base], append=0)
    last[:-1] |= between[:-1] >= (2 if kind == "paragraph" else 1)
    if kind in ("sentence", "phrase", PASSAGE):
        last |= _STRONG[data[ends - 1]]
    if kind == "phrase":
        last |= textops.mix64(hashes ^ _R1) >> np.uint64(60) == 0
    if kind == PASSAGE:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        last |= _least(textops.mix64(hashes ^ _R1), text, _NEAR_WORDS) | _full_stop(data, ends)
    return np.flatnonzero(last)


def _window_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A digest of the words [begin, end) of each window."""
    power = np.cumprod(np.full(len(hashes) + 1, factor, np.uint64))
    inverse = np.cumprod(np.full(len(hashes) + 1, np.uint64(pow(int(factor), -1, 1 << 64)), np.uint64))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return textops.mix64((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def keyed_units(column: pa.Array, kind: str, min_words: int) -> Iterator[tuple]:
    """For each chunk of rows: (first row, rows; unit's row, position in its text, first word; keys' first and last unit, two parts; words' starts).

    Keys ascend by last unit.
    """
    data, offsets = textops.utf8(column)
    for a, b in textops.chunks(offsets):
        hashes, starts, ends, first = textops.words(data, offsets[a : b + 1])
        if kind == PASSAGE:
            hashes, starts, ends, first = _cut_words(data, hashes, starts, ends, first)
        last = _unit_ends(data, hashes, starts, ends, first, kind)
        begin = np.append(0, last[:-1] + 1) if len(last) else last
        row = np.searchsorted(first, begin, "right") - 1
        unit_first = np.searchsorted(begin, first[row])  # the first unit of the same text
        window = np.searchsorted(begin, last + 1 - min_words, "right") - 1
        key_last = np.flatnonzero((last + 1 - min_words >= first[row]) & (window >= unit_first))
        key_first = window[key_last]
        if kind == PASSAGE and len(last):
            for whole in ("line", "paragraph"):
                end = np.searchsorted(last, _unit_ends(data, hashes, starts, ends, first, whole))
                key_first, key_last = np.append(key_first, np.append(0, end[:-1] + 1)), np.append(key_last, end)
            key_last, key_first = np.divmod(np.unique(key_last * len(last) + key_first), len(last))
        k1, k2 = (_window_hashes(hashes, begin[key_first], last[key_last] + 1, r) for r in (_R1, _R2))
        yield a, b - a, row, np.arange(len(last)) - unit_first, begin, key_first, key_last, k1, (k2 >> np.uint64(32)).astype(np.uint32), starts


def _firsts(k1, k2, doc, text, pos) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first row of each key, and of the rows that stand at a later rank than it (a repeated row is at the same)."""
    order = np.lexsort((pos, text, doc, k2, k1))
    a, b = k1[order], k2[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
    later = (doc[order] != doc[first]) | (text[order] != text[first]) | (pos[order] != pos[first])
    return order[head], order[later]


def _pack(rows, names):
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


_PACKED = {"k1": np.uint64, "k2": np.uint32, "doc": np.int64, "digest": np.int32, "pos": np.int32, "dead_doc": np.int64, "dead_digest": np.int32, "dead_pos": np.int32, "dead_k1": np.uint64}
_BLOBS = "part int, " + ", ".join(f"{c} binary" for c in _PACKED)


def _emit(kind: str, min_words: int, parts: int):
    def flush(held):
        k1, k2, doc, digest, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        live, dead = _firsts(k1, k2, doc, digest, pos)
        live_at = ((k1[live] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        dead_at = (textops.mix64(doc[dead].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        live, dead = live[np.argsort(live_at, kind="stable")], dead[np.argsort(dead_at, kind="stable")]
        live_cut, dead_cut = (np.searchsorted(np.sort(x), np.arange(parts + 1)) for x in (live_at, dead_at))
        rows = []
        for p in range(parts):
            x, y = live[live_cut[p] : live_cut[p + 1]], dead[dead_cut[p] : dead_cut[p + 1]]
            if len(x) or len(y):
                rows.append((p, *(c[x].tobytes() for c in (k1, k2, doc, digest, pos)), *(c[y].tobytes() for c in (doc, digest, pos, k1))))
        for a in range(0, len(rows), 1024):
            yield _pack(rows[a : a + 1024], ["part", *_PACKED])

    def run(batches):
        held, size = [], 0
        for batch in textops.released(batches):
            ids, digests = np.asarray(batch.column("doc_id")), np.asarray(batch.column("digest"))
            for a, _n, row, pos, _b, _f, own, k1, k2, _s in keyed_units(batch.column("text"), kind, min_words):
                if len(own):
                    at = a + row[own]
                    held.append((k1, k2, ids[at].astype(np.int64), digests[at].astype(np.int32), pos[own].astype(np.int32)))
                    size += len(own)
                if size >= _FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _later(batches):
    """Rows (doc_id, digest, pos, mark) of units whose key has an earlier occurrence; mark is part of the key. Rows come by range."""
    rows = (row for batch in textops.released(batches) for row in zip(*(batch.column(c).to_pylist() for c in ("part", *_PACKED)), strict=True))
    for _, own in groupby(rows, key=lambda row: row[0]):
        blobs = list(zip(*own, strict=True))[1:]
        x = {c: np.frombuffer(b"".join(b), kind) for (c, kind), b in zip(_PACKED.items(), blobs, strict=True)}
        _, late = _firsts(x["k1"], x["k2"], x["doc"], x["digest"], x["pos"])
        doc, digest, pos, k1 = (np.concatenate([x[c][late], x[f"dead_{c}"]]) for c in ("doc", "digest", "pos", "k1"))
        mark = (k1 & np.uint64(0x7FFFFFFF)).astype(np.int32)
        for a in range(0, len(doc), 1 << 16):
            b = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in (doc, digest, pos, mark)], names=["doc_id", "digest", "pos", "mark"])


def _cut(kind: str, min_words: int, at_text: int, at_marks: int):
    """Texts without their marked units, and the spans that were kept and removed."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch):
        text = batch.column(at_text).cast(pa.string())
        marked = batch.column(at_marks).to_pylist()
        n = batch.num_rows
        clean = text.to_pylist()
        units, gone = np.zeros(n, np.int64), np.zeros(n, np.int64)
        removed: list[list] = [[] for _ in range(n)]
        kept: list[list] = [[{"start": 0, "end": len(t)}] if t else [] for t in clean]
        data, offsets = textops.utf8(text)
        for a, count, row, _pos, begin, key_first, key_last, k1, _k2, starts in keyed_units(text, kind, min_words):
            cuts = np.searchsorted(row, np.arange(count + 1))
            key_at = np.searchsorted(key_last, np.arange(len(begin) + 1)).tolist()
            units[a : a + count] = np.diff(cuts)
            for i in range(count):
                if not marked[a + i]:
                    continue
                c, d = int(cuts[i]), int(cuts[i + 1])
                drop = np.zeros(d - c, bool)
                for m in marked[a + i]:
                    u = c + m["pos"]
                    for key in range(key_at[u], key_at[u + 1]) if u < d else ():
                        if int(k1[key] & np.uint64(0x7FFFFFFF)) == m["mark"]:
                            drop[key_first[key] - c : m["pos"] + 1] = True
                at = np.flatnonzero(drop)
                if not len(at):
                    continue
                lo, hi = int(offsets[a + i]), int(offsets[a + i + 1])
                edges = np.append(starts[begin[c:d]], hi) - lo  # a unit reaches to the next one's start
                whole = data[lo:hi].tobytes()
                out, done, spans, rest = [], 0, [], []
                for g in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    spans.append((int(edges[g[0]]), int(edges[g[-1] + 1])))
                chars = 0
                for x, y in [*spans, (hi - lo, hi - lo)]:
                    piece = whole[done:x].decode()
                    if piece:
                        rest.append({"start": chars, "end": chars + len(piece)})
                    chars += len(piece)
                    out.append(piece)
                    cut = len(whole[x:y].decode())
                    if cut:
                        removed[a + i].append({"start": chars, "end": chars + cut})
                    chars += cut
                    done = y
                clean[a + i], kept[a + i], gone[a + i] = "".join(out), rest, len(at)
        return [pa.array(clean, pa.string()), pa.array(units), pa.array(gone), pa.array(removed, span), pa.array(kept, span)]

    return run


SPANS = "array<struct<start:long,end:long>>"


def cut_units(docs: DataFrame, kind: str = PASSAGE, min_words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others) with _clean, _units, _gone, _removed and _kept appended (replaced, if there): see dedup_units."""
    if kind not in (*KINDS, PASSAGE):
        raise ValueError(f"kind is one of {(*KINDS, PASSAGE)}")
    parts, min_words = shuffle_partitions(docs.sparkSession), MIN_WORDS[kind] if min_words is None else min_words
    docs = docs.drop("_clean", "_units", "_gone", "_removed", "_kept", "_marks", "_marked_id", "_marked_digest")
    digest = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 33).cast("int")  # tells texts of one doc_id apart
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = parts * max(_RANGES, -(-size // (_KEY_BYTES * _RANGE_KEYS * parts)))
    sent = rows.where("doc_id IS NOT NULL").mapInArrow(_emit(kind, min_words, ranges), _BLOBS)
    sent = sent.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part")
    late = sent.mapInArrow(_later, "doc_id long, digest int, pos int, mark int")
    marked = late.groupBy(F.col("doc_id").alias("_marked_id"), F.col("digest").alias("_marked_digest")).agg(F.collect_set(F.struct("pos", "mark")).alias("_marks"))
    marked = materialize(marked, "dedup-marked")
    same = (F.col("doc_id").cast("long") == F.col("_marked_id")) & (digest == F.col("_marked_digest"))
    joined = docs.join(marked, same, "left").drop("_marked_id", "_marked_digest")
    names = [c.lower() for c in joined.columns]
    added = parse(f"_clean string, _units long, _gone long, _removed {SPANS}, _kept {SPANS}")
    return add_columns(joined, _cut(kind, min_words, names.index("text"), names.index("_marks")), added).drop("_marks")


def dedup_units(docs: DataFrame, kind: str = PASSAGE, min_words: int | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, text without repeated units, n_units, n_removed, removed and kept spans.

    Spans are [start, end) in characters of the original text; a unit reaches to the start of the next. Null texts stay null and have no
    units; rows of null doc_id are returned as they are. Rows that repeat a doc_id and a text are ranked alike: what is removed from
    one is removed from each, and a passage first seen in them stays in each; different texts of one doc_id are ranked by a hash of the text. Empty
    tables give empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = cut_units(rows, kind, min_words)
    return cut.select("doc_id", F.col("_clean").alias("text"), F.col("_units").alias("n_units"), F.col("_gone").alias("n_removed"), F.col("_removed").alias("removed"), F.col("_kept").alias("kept"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_units of all documents: doc_id, text, n_units, n_removed, removed, kept."""
    return dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
