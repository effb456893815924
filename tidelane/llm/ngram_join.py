"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

1. Each text becomes its set of word shingles. Documents with equal sets are one class, a row of the incidence matrix.
2. Of two sets that reach the threshold, a size-derived bound says that they share one of the first |s| - ceil(t |s|) + 1 shingles of
   each in any common order. That order is rare first: shingles are counted over all documents, in packed batches whose distinct shingles
   go to their range of hashes once and whose counts come back, so a shingle of any frequency is one entry a batch. A shingle of
   one document meets no other, so most documents have no posting at all, nor does a shingle from which on too little is left of every other set.
3. A class' home is the most frequent of its prefix shingles. The rows of a home are cut into blocks of about equal sizes of sets. Two
   blocks make a tile if rows of them share a prefix shingle and their sizes can reach the threshold, and only those rows go there; so each
   pair that can reach it meets in exactly one tile, and classes that are only chained by others meet in none.
4. A task streams tiles, and multiplies the two blocks of each: columns of a few rows by scattering the products of their postings, the others
   over dense blocks of columns. Pairs whose sizes or counts are below the bound are discarded. It returns for each row its
   links and its smallest reachable row in the tile, never pairs.
5. Components over tiles, and from classes back to documents.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import textops
from tidelane.llm.components import components
from tidelane.storage import discard, materialize, shuffle_partitions

WIDTH, PERCENT = 5, 80
#: Rows and shingles of a block, at most.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles and documents of a batch that is counted at once, at most (a longer document is a batch of its own).
_FLUSH, _FLUSH_DOCS = 1 << 19, (1 << 16) - 1
#: Shingles of a range of hashes, about; a task holds one range at a time.
_RANGE = 1 << 23
#: Bits and bytes that name a shingle in its range.
_BITS, _BYTES = 48, 6


def text_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a string column."""
    data, offsets = textops.utf8(column)
    for a, b in textops.chunks(offsets):
        hashes, _, _, first = textops.words(data, offsets[a : b + 1])
        for i, own in enumerate(textops.shingles(hashes, first, width)):
            yield a + i, own


def set_digest(own: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _signatures(width: int):
    def run(batches):
        for batch in textops.released(batches):
            n, c1, c2 = [], [], []
            for _, own in text_sets(batch.column("text"), width):
                a, b = set_digest(own) if len(own) else (None, None)
                n.append(len(own))
                c1.append(a)
                c2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], names=["doc_id", "n", "c1", "c2"])

    return run


_BATCH = ("part", "batch", "tokens", "counts", "refs", "sizes", "classes")


def _batches(width: int, parts: int):
    """Rows of a packed batch of sets: its distinct shingles by range of hashes, with the batch's counts, and one row of what stays with the batch - which documents hold its shingles, in their order, and the documents' sizes and classes."""

    def flush(sets, classes):
        tokens = np.concatenate(sets)
        sizes = np.array([len(x) for x in sets], np.int64)
        order = np.argsort(tokens, kind="stable")
        refs = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
        tokens, counts = np.unique(tokens, return_counts=True)
        counts = counts.astype(np.uint16)
        part = (tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        low = _within(tokens, parts)
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        batch = uuid.uuid4().bytes
        rows = [(p, batch, low[a:b].view(np.uint8).reshape(-1, 8)[:, :_BYTES].T.tobytes(), counts[a:b].tobytes(), None, None, None) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        rows.append((int.from_bytes(batch[:4], "big") * parts >> 32, batch, None, counts.tobytes(), refs.tobytes(), sizes.tobytes(), np.array(classes, np.int64).tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(_BATCH))

    def run(batches):
        sets, classes, size, seen = [], [], 0, set()
        for batch in textops.released(batches):
            for _, own in text_sets(batch.column("text"), width):
                if not len(own):
                    continue
                digest = set_digest(own)
                if digest in seen:  # a copy of what this task has sent
                    continue
                if len(seen) < 1 << 17:
                    seen.add(digest)
                if sets and (size + len(own) > _FLUSH or len(sets) >= _FLUSH_DOCS):
                    yield flush(sets, classes)
                    sets, classes, size = [], [], 0
                sets.append(own)
                classes.append(digest)
                size += len(own)
        if sets:
            yield flush(sets, classes)

    return run


def _within(tokens: np.ndarray, parts: int) -> np.ndarray:
    """A shingle's first bits in its range of hashes: with the range, they name it from here on."""
    return tokens * np.uint64(parts) >> np.uint64(64 - _BITS)


def _unplaned(planes: bytes) -> np.ndarray:
    out = np.zeros((len(planes) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(planes, np.uint8).reshape(_BYTES, -1).T
    return out.view(np.uint64).ravel()


def _counted(batches):
    """For each batch and range, which of its shingles are in several documents, their bits and counts; rows of what stays with a batch pass. Rows come by range."""
    names = ["batch", "part", "shared", "tokens", "counts", "refs", "sizes", "classes"]
    kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 6]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = (row for batch in textops.released(batches) for row in zip(*(batch.column(c).to_pylist() for c in _BATCH), strict=True))
    for part, own in groupby(rows, key=lambda row: row[0]):
        held = []
        for _, name, tokens, counts, refs, sizes, classes in own:
            if tokens is None:
                yield packed([(name, None, None, None, counts, refs, sizes, classes)])
            else:
                held.append((name, _unplaned(tokens), np.frombuffer(counts, np.uint16)))
        if not held:
            continue
        tokens, at = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[2] for x in held]), len(tokens)).astype(np.int64)
        end, out = 0, []
        for name, low, _ in held:
            n = total[at[end : end + len(low)]]
            end += len(low)
            shared = n > 1
            out.append((name, part, np.packbits(shared).tobytes() + len(low).to_bytes(8, "little"), low[shared].view(np.uint8).reshape(-1, 8)[:, :_BYTES].T.tobytes(), np.minimum(n[shared], 0xFFFF).astype(np.uint16).tobytes(), None, None, None))
        for a in range(0, len(out), 256):
            yield packed(out[a : a + 256])


def _prefixes(percent: int):
    """A row for each class whose prefix, rare first, holds a shingle of several documents: c1, c2, n, those shingles, and all of its shingles that are in several documents."""

    def one(rows):
        base = next(r for r in rows if r["part"] is None)
        times = np.frombuffer(base["counts"], np.uint16)
        refs, sizes, classes = np.frombuffer(base["refs"], np.uint16), np.frombuffer(base["sizes"], np.int64), np.frombuffer(base["classes"], np.int64).reshape(-1, 2)
        shared, tokens, df = [], [], []
        for r in sorted((r for r in rows if r["part"] is not None), key=lambda r: r["part"]):
            n = int.from_bytes(r["shared"][-8:], "little")
            shared.append(np.unpackbits(np.frombuffer(r["shared"][:-8], np.uint8), count=n).astype(bool))
            tokens.append(_unplaned(r["tokens"]).view(np.int64) | np.int64(r["part"]) << _BITS)
            df.append(np.frombuffer(r["counts"], np.uint16))
        shared = np.concatenate(shared)
        own = np.repeat(shared, times)
        k = times[shared]
        refs, tokens, df = refs[own], np.repeat(np.concatenate(tokens), k), np.repeat(np.concatenate(df), k)
        single = sizes - np.bincount(refs, minlength=len(sizes))
        room = prefix_size(sizes, percent) - single
        some = room[refs] > 0
        refs, tokens, df = refs[some], tokens[some], df[some]
        order = np.lexsort((tokens, df, refs))
        refs, tokens = refs[order], tokens[order]
        cuts = np.flatnonzero(np.diff(refs.astype(np.int64), prepend=-1))
        ends = np.append(cuts[1:], len(refs))[: len(cuts)]
        own = refs[cuts]
        prefix = [tokens[i : min(j, i + k)] for i, j, k in zip(cuts.tolist(), ends.tolist(), room[own].tolist(), strict=True)]
        blobs = [np.sort(tokens[i:j]).tobytes() for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
        values = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
        offsets = np.append(0, np.cumsum([len(x) for x in prefix])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array(classes[own, 0]), pa.array(classes[own, 1]), pa.array(sizes[own]), lists, pa.array(blobs, pa.binary())], names=["c1", "c2", "n", "prefix", "own"])

    def run(batches):
        rows = (r for batch in textops.released(batches) for r in batch.to_pylist())
        for _, own in groupby(rows, key=lambda r: r["batch"]):
            yield one(list(own))

    return run


def candidates(docs: DataFrame, width: int, percent: int, shingles: int) -> DataFrame:
    """Stored rows (c1, c2, n, prefix, own) of classes that may link with others; a class may come once for each batch that holds it.

    ``shingles`` is about how many the classes have together; ranges of hashes are as many as keep each at about ``_RANGE`` of them.
    """
    parts = shuffle_partitions(docs.sparkSession)
    ranges = parts * max(1, -(-shingles // (_RANGE * parts)))
    sent = docs.select("text").mapInArrow(_batches(width, ranges), "part int, batch binary, tokens binary, counts binary, refs binary, sizes binary, classes binary")
    sent = sent.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part")
    answered = sent.mapInArrow(_counted, "batch binary, part int, shared binary, tokens binary, counts binary, refs binary, sizes binary, classes binary")
    answered = answered.repartition(parts, "batch").sortWithinPartitions("batch")
    return materialize(answered.mapInArrow(_prefixes(percent), "c1 long, c2 long, n long, prefix array<long>, own binary"), "join-candidates")


def _can_reach(n, low, high, percent: int):
    """Whether a set of ``n`` shingles can reach the threshold with one of ``low`` to ``high``."""
    return (percent * n <= 100 * high) & (percent * low <= 100 * n)


def _viable(active: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, times): the prefix shingles of ``active`` by which a row can reach the threshold with any other row, and of how many rows each is.

    If a pair's first common shingle has ``rest`` shingles of a set from it on, the pair has no more than the lesser rest in common. So a shingle of any number of rows is looked at by
    classes of about equal sizes, each with its greatest rest: texts of one template and with words of their own before it, in order, meet nowhere.
    """
    numbered = active.select("prefix", "node", "n", (F.octet_length("own") / 8).cast("long").alias("own"), F.floor(F.log(F.col("n")) / math.log(1.05)).alias("size"))
    posted = numbered.select(F.posexplode("prefix").alias("place", "token"), "node", "n", "own", "size").select("token", "node", "n", (F.col("own") - F.col("place")).alias("rest"), "size")
    sizes = posted.groupBy("token", "size").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most"), F.count(F.lit(1)).alias("rows"))
    by_token = sizes.groupBy("token").agg(F.collect_list(F.struct("size", "low", "high", "most", "rows")).alias("_sizes"), F.sum("rows").alias("times")).where("times > 1")

    def meets(other):
        least = F.greatest(other["low"], F.ceil(F.col("n") * percent / 100).cast("long"))
        enough = (100 + percent) * F.least(F.col("rest"), other["most"]) >= percent * (F.col("n") + least)
        return ((other["rows"] > 1) | (other["size"] != F.col("size"))) & _can_reach(F.col("n"), other["low"], other["high"], percent) & enough

    return posted.join(by_token, "token").where(F.exists("_sizes", meets)).select("token", "node", "n", "times")


def tiles(active: DataFrame, percent: int) -> DataFrame:
    """(x, y, block, node, n, weight, own): the rows of ``active`` (node, n, weight, prefix, own) in each tile of blocks x <= y; block is the row's own, x or y.

    Homes are cut by size of sets, so that blocks of far sizes make no tile, and then by hash. Tables of shingles and blocks only carry ids.
    """
    posted = materialize(_viable(active, percent), "join-posted")
    homes = posted.groupBy("node").agg(F.max(F.struct("times", "token"))["token"].alias("home"), F.first("n").alias("n"))
    homes = materialize(homes, "join-homes")
    whole = homes.groupBy("home").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_cells")).where((F.col("_rows") > BLOCK_ROWS) | (F.col("_cells") > BLOCK_SHINGLES)).select("home", F.lit(True).alias("_large"))
    bucket = F.when(F.col("_large"), F.floor(F.log(F.col("n")) / math.log(100 / percent)) if percent < 100 else F.col("n")).otherwise(0).cast("long")
    sized = materialize(homes.join(whole, "home", "left").select("node", "home", "n", bucket.alias("bucket")), "join-sized")
    cuts = sized.groupBy("home", "bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("_cuts")).where("_cuts > 1")
    part = F.pmod(F.xxhash64("node"), F.coalesce("_cuts", F.lit(1)))
    placed = materialize(sized.join(cuts, ["home", "bucket"], "left").select("node", "home", "n", F.xxhash64("home", "bucket", part).alias("block")), "join-placed")
    blocks = placed.groupBy("home", F.col("block").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    within = placed.join(blocks, "home").where(_can_reach(F.col("n"), F.col("low"), F.col("high"), percent)).select("node", "block", "other")
    at = posted.select("token", "node").join(placed, "node")
    split = at.groupBy("token").agg(F.min("home").alias("_a"), F.max("home").alias("_b")).where("_a <> _b").select("token")
    at = materialize(at.join(split, "token"), "join-split")
    there = at.groupBy("token", F.col("home").alias("_home"), F.col("block").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    across = at.join(there, "token").where((F.col("home") != F.col("_home")) & (F.col("block") != F.col("other")) & _can_reach(F.col("n"), F.col("low"), F.col("high"), percent))
    sent = materialize(within.union(across.select("node", "block", "other").distinct()), "join-sent")
    discard(posted, homes, sized, placed, at)
    rows = active.drop("prefix").join(sent, "node")
    return rows.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "n", "weight", "own")


def _pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], columns: np.ndarray, width: int, size: int) -> np.ndarray:
    """Counts of (left row, right row) over ``columns``, by scattering: postings are (column, row) by column."""
    (at, row), (other, column) = left, right
    own = np.flatnonzero(columns[at])
    begin = np.searchsorted(other, at[own])
    n = np.searchsorted(other, at[own], "right") - begin
    out = np.zeros(size, np.int64)
    ends = np.cumsum(n)
    cut = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 1 << 22)).tolist() + [len(own)]
    for a, b in zip(cut, cut[1:], strict=False):
        k = n[a:b]
        to = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[a:b], k)
        out += np.bincount(np.repeat(row[own[a:b]], k) * width + column[to], minlength=size)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, columns: int = 4096, few: int = 64) -> np.ndarray:
    """Counts of common shingles, |left| x |right| (None: left with itself): columns of up to ``few`` pairs of rows by scattering, the others over blocks of columns."""
    sides = [left] if right is None else [left, right]
    flat = [np.concatenate(x) for x in sides]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in sides]
    if right is None:
        tokens, n = np.unique(flat[0], return_counts=True)
        shared = tokens[n > 1]
    else:
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    shape = (len(left), len(sides[-1]))
    if not len(shared):
        return np.zeros(shape, np.int64)
    placed, counts = [], []
    for tokens, row in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        keep = shared[at] == tokens
        order = np.argsort(at[keep], kind="stable")
        placed.append((at[keep][order], row[keep][order]))
        counts.append(np.bincount(placed[-1][0], minlength=len(shared)))
    light = counts[0] * counts[-1] <= few
    out = _pairs(placed[0], placed[-1], light, shape[1], shape[0] * shape[1]).reshape(shape)
    heavy = np.flatnonzero(~light)
    for a in range(0, len(heavy), columns):
        part = heavy[a : a + columns]
        number = np.full(len(shared), -1)
        number[part] = np.arange(len(part))
        blocks = []
        for (at, row), side in zip(placed, sides, strict=True):
            own = np.flatnonzero(number[at] >= 0)
            block = np.zeros((len(side), len(part)), np.float32)
            block[row[own], number[at[own]]] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[-1].T).astype(np.int64)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the pairs of two blocks reach the threshold; a block with itself has no links on its diagonal. ``sizes`` are those of the whole
    sets; the arrays may leave out shingles that are in no other set."""
    low, high, both = np.minimum.outer(*sizes), np.maximum.outer(*sizes), np.add.outer(*sizes)
    most = np.minimum.outer(np.array([len(x) for x in left]), np.array([len(x) for x in (left if right is None else right)]))
    can = (100 * low >= percent * high) & ((100 + percent) * most >= percent * both)
    if right is None:
        np.fill_diagonal(can, False)
    if not can.any():
        return can
    return can & ((100 + percent) * overlaps(left, right) >= percent * both)


def _least_reachable(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by symmetric ``links``."""
    label = np.arange(len(links))
    a, b = np.nonzero(links)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


def _multiply(percent: int):
    def one(rows):
        rows.sort(key=lambda r: (r["rep"], r["c1"]))  # the order of nodes
        n, weight = np.array([r["n"] for r in rows]), np.array([r["weight"] for r in rows])
        sets = [np.frombuffer(r["own"], np.int64) for r in rows]
        if rows[0]["x"] == rows[0]["y"]:
            links = linked(sets, None, percent, (n, n))
        else:
            links = np.zeros((len(rows), len(rows)), bool)
            low = np.array([r["block"] == r["x"] for r in rows])
            a, b = np.flatnonzero(low), np.flatnonzero(~low)
            if len(a) and len(b):
                links[np.ix_(a, b)] = linked([sets[i] for i in a], [sets[i] for i in b], percent, (n[a], n[b]))
                links |= links.T
        least, count = _least_reachable(links), links @ weight
        return [(rows[i]["rep"], rows[i]["c1"], rows[j]["rep"], rows[j]["c1"], k) for i, j, k in zip(range(len(rows)), least.tolist(), count.tolist(), strict=True) if k]

    def run(batches):
        held = []
        rows = (r for batch in textops.released(batches) for r in batch.to_pylist())
        for _, own in groupby(rows, key=lambda r: (r["x"], r["y"])):
            own = list(own)
            if len(own) > 1:
                held += one(own)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=["rep", "c1", "least_rep", "least_c1", "links"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=["rep", "c1", "least_rep", "least_c1", "links"])

    return run


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, digests: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z as a-z; a set holds the distinct ``width``-word shingles, or the whole
    sequence of a shorter text. Rows link when 100 |a & b| >= ``percent`` |a | b|. component_id is the smallest doc_id reachable, itself
    included; n_links counts the other rows linked with it, copies each. Null and wordless texts have the empty set: linked with
    nothing, component_id is their doc_id. Rows of null doc_id take no part (component_id null, n_links 0). Rows that repeat a doc_id with
    different words are judged each by its own words. Empty tables give empty results.

    ``digests`` adds c1 and c2, the set's digest (null: empty), and first: whether the row is of its group's smallest doc_id and, if that is
    repeated with different words, of its smallest c1 (rows of no group are).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(rows.mapInArrow(_signatures(width), "doc_id long, n long, c1 long, c2 long"), "join-signatures")
    some = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = some.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"))
    classes = materialize(classes.select("c1", "c2", F.struct("rep", "c1").alias("node"), "weight", "n"), "join-classes")
    found = candidates(rows, width, percent, classes.agg(F.sum("n")).first()[0] or 0)
    active = materialize(found.dropDuplicates(["c1", "c2"]).join(classes.drop("n"), ["c1", "c2"]).select("node", "n", "weight", "prefix", "own"), "join-active")
    sent = tiles(active, percent).select("x", "y", "block", "node.rep", "node.c1", "n", "weight", "own")
    sent = sent.repartition(shuffle_partitions(spark), "x", "y").sortWithinPartitions("x", "y")
    product = materialize(sent.mapInArrow(_multiply(percent), "rep long, c1 long, least_rep long, least_c1 long, links long"), "join-product")
    discard(found, active)
    node = F.struct("rep", "c1")
    groups = components(product.select(node.alias("a"), F.struct(F.col("least_rep").alias("rep"), F.col("least_c1").alias("c1")).alias("b")))
    links = product.groupBy(node.alias("node")).agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left")
    by_class = by_class.select("c1", "c2", F.coalesce("label", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    by_class = materialize(by_class.where("links > 0"), "join-classes-linked")
    joined = signed.join(by_class, ["c1", "c2"], "left")
    known = F.col("doc_id").isNotNull()
    out = [
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component.rep", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    ]
    first = ~known | F.col("component").isNull() | (F.col("component") == F.struct(F.col("doc_id").alias("rep"), "c1"))
    return joined.select(*out, *([F.col("c1"), F.col("c2"), first.alias("first")] if digests else []))


def set_digests(column: pa.Array, width: int = WIDTH) -> list[pa.Array]:
    """c1 and c2 of each text of a column, as jaccard_join gives them."""
    found = [set_digest(own) if len(own) else (None, None) for _, own in text_sets(column, width)]
    return [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_join of all documents: doc_id, n_shingles, component_id, n_links."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
