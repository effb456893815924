"""Average-linkage clusters of vectors.

Clusters whose mean distance is under a limit have at least one pair under it, so they never cross the connected components of the graph of such pairs: components are
found first, by blocks of vectors beside some shared ones, then by tiles of two blocks unless both are of one large component; a tile sends its spanning pairs on only.

Each component is clustered by itself. While its clusters are many, all that are each other's nearest merge at once, round by round, and distances are asked again, as matrix products, of what
merged or can't tell its nearest any more. Few enough for a table of their sums, they merge along nearest-neighbour chains (the Lance-Williams update of the mean). Memory grows with the
component's vectors, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.graphs import connected
from tidelane.storage import discard, materialize, shuffle_partitions

TILE = 2048
#: Numbers of a component's table of distance sums, at most; while its clusters are more, a quarter as many are kept and others computed when asked.
KEPT_SUMS = 1 << 26
#: Rows and columns of a block of distances, numbers of a block of sums, and rows of a cluster whose sums are kept.
ROWS, COLUMNS, BLOCK, LARGE = 128, 1024, 1 << 22, 64
#: Vectors of a key that are beside each block of it.
SHARED = 256
#: Nearest clusters that a cluster remembers.
LISTED = 12


def _roots(near: np.ndarray) -> np.ndarray:
    """The least connected row for each row of a symmetric table of neighbours."""
    root = np.arange(len(near))
    while True:
        least = root.copy()
        for at in range(0, len(near), 128):
            least[at : at + 128] = np.minimum(root[at : at + 128], np.where(near[at : at + 128], root[None, :], len(near)).min(axis=1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _near(x: np.ndarray, limit: float) -> np.ndarray:
    """Whether rows are nearer than ``limit``, by a matrix product; where its rounding leaves doubt they are, as clusters stay inside of greater components too."""
    near = np.zeros((len(x), len(x)), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (x**2).sum(axis=1)
        for at in range(0, len(x), 128):
            both = norm[at : at + 128, None] + norm[None]
            near[at : at + 128] = ~(both - 2 * (x[at : at + 128] @ x.T) >= limit**2 + 1e-12 * both)
    return near | near.T


def _spanning(limit: float):
    """Rows (key..., tile, id, vector) of whole tiles to pairs (key..., a, b) that connect what is nearer than ``limit`` in a tile."""

    def run(_, table):
        ids, vectors = table.column("_id"), table.column("_v").combine_chunks()
        x = np.asarray(vectors.flatten(), float).reshape(len(ids), -1)
        root = _roots(_near(x, limit))
        some = pa.array(np.flatnonzero(root != np.arange(len(x))))
        out = table.drop_columns(["_v", "_tile"]).take(some)
        return out.append_column("_root", ids.take(pa.array(root[np.asarray(some)])))

    return run


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows from rows, each followed by its squared length and 1, by a matrix product; where its rounding would tell, by differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        left = x * -2
        left[:, -2], left[:, -1] = 1, x[:, -2]
        out = left @ y.T
        if not out.min() > 1e-3 * (x[:, -2].max() + y[:, -2].max()):
            poor = ~(out > 1e-3 * (x[:, -2, None] + y[:, -2]))
            for i in np.flatnonzero(poor.any(axis=1)):
                at = np.flatnonzero(poor[i])
                out[i, at] = ((y[at, :-2] - x[i, :-2]) ** 2).sum(axis=1)
        return np.sqrt(out, out=out)


class _Sums:
    """Sums of distances between the clusters of rows of ``x``, ``weight`` equal rows each, in blocks of clusters."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        own = x - x[0]  # products lose least near the origin
        with np.errstate(over="ignore"):
            norm = (own**2).sum(axis=1)
        self.x = np.column_stack([own, norm, np.ones(len(x))])
        self.weight, self.even = weight, bool((weight == 1).all())
        self.kept: dict[int, np.ndarray] = {}  # large clusters' sums, by row
        self.added: dict[int, int] = {}  # and how many of their rows these count

    def merge(self, a: int, b: int, members: dict[int, list[int]]) -> None:
        """Cluster ``b`` goes into ``a``: what is kept of one or both adds up, and counts the first rows of the new list of members."""
        own, other = self.kept.pop(a, None), self.kept.pop(b, None)
        n, m = self.added.pop(a, 0), self.added.pop(b, 0)
        first, second = members[a], members.pop(b)
        members[a] = first[:n] + second[:m] + first[n:] + second[m:]
        if n or m:
            self.kept[a] = own + other if n and m else own if n else other
            self.added[a] = n + m

    def _row(self, c: int, members: list[int]) -> np.ndarray:
        """A large cluster's sums to each row; kept as far as :data:`KEPT_SUMS` allows."""
        row, left = self.kept.pop(c, None), np.array(members[self.added.pop(c, 0) :], int)
        row = np.zeros(len(self.x)) if row is None else row
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            for to in range(0, len(self.x), COLUMNS):
                row[to : to + COLUMNS] += self.weight[some] @ _distances(self.x[some], self.x[to : to + COLUMNS])
        while self.kept and (len(self.kept) + 1) * len(self.x) > KEPT_SUMS // 4:
            del self.kept[(least := min(self.added, key=self.added.get))], self.added[least]
        self.kept[c], self.added[c] = row, len(members)
        return row

    def blocks(self, members: dict[int, list[int]], asked: np.ndarray, names: np.ndarray):
        """(clusters of ``asked``, their sums to each cluster of ``names``), block by block; ``names`` are in order."""
        size = np.array([len(members[c]) for c in names.tolist()])
        small = names[size <= LARGE]
        order = np.argsort(-size[size <= LARGE], kind="stable")
        # columns: the first rows of all clusters, then the second rows of those that have two, and so on: planes, each over the first of the sorted clusters
        lists = [members[c] for c in small[order].tolist()]
        planes = [[own[t] for own in lists[: np.searchsorted(-size[size <= LARGE][order], -t, side="left")]] for t in range(len(lists[0]) if lists else 0)]
        columns = np.array([i for plane in planes for i in plane], int)
        ends = np.cumsum([len(plane) for plane in planes], dtype=int)
        beside, by = self.x[columns], self.weight[columns]
        large = [np.array(members[c]) for c in names[size > LARGE].tolist()]
        place = np.argsort(np.concatenate([small[order], names[size > LARGE]]), kind="stable")  # from the sorted clusters and the large ones to names
        sorted_ = bool((place == np.arange(len(place))).all())
        of = np.full(len(self.x), -1)
        for k, c in enumerate(names.tolist()):
            of[members[c]] = k
        counted = np.flatnonzero(of >= 0)
        ranked = sorted(asked.tolist(), key=lambda c: -len(members[c]))
        for c in ranked:
            if len(members[c]) > LARGE:
                row = self._row(c, members[c]) * self.weight
                yield np.array([c]), np.bincount(of[counted], row[counted], len(names))[None]
        ranked = [c for c in ranked if len(members[c]) <= LARGE]
        step = max(1, min(ROWS, BLOCK // max(1, len(names))))
        for at in range(0, len(ranked), step):
            own = [members[c] for c in ranked[at : at + step]]
            made = np.zeros((len(own), len(names)))

            def near(y: np.ndarray, times: np.ndarray, own=own) -> np.ndarray:
                out = None
                for t in range(len(own[0])):
                    rows = np.array([m[t] for m in own if len(m) > t])
                    far = _distances(self.x[rows], y)
                    if not self.even:
                        far *= self.weight[rows, None]
                    if t:
                        out[: len(rows)] += far
                    else:
                        out = far
                return out if self.even else out * times

            for to in range(0, len(columns), COLUMNS):
                far = near(beside[to : to + COLUMNS], by[to : to + COLUMNS])
                for t in range(int(np.searchsorted(ends, to, side="right")), len(ends)):
                    start = int(ends[t - 1]) if t else 0
                    if start >= to + COLUMNS:
                        break
                    low, high = max(start, to), min(int(ends[t]), to + COLUMNS)
                    made[:, low - start : high - start] += far[:, low - to : high - to]
            for k, rows in enumerate(large, len(small)):
                for to in range(0, len(rows), COLUMNS):
                    made[:, k] += near(self.x[rows[to : to + COLUMNS]], self.weight[rows[to : to + COLUMNS]]).sum(axis=1)
            yield np.array(ranked[at : at + step]), made if sorted_ else np.take(made, place, axis=1)


def _chains(sums: np.ndarray, size: np.ndarray, limit: float) -> np.ndarray:
    """The first of each cluster's clusters, from a table of all sums, which is used up. Chains begin at the first cluster that isn't settled;
    of equally near ones the one before on the chain is taken, else the first."""
    size = size.copy()
    of = np.arange(len(size))
    open_ = np.ones(len(size), bool)
    chain: list[int] = []
    while True:
        if not chain:
            left = np.flatnonzero(open_)
            if not len(left):
                return of
            chain = [int(left[0])]
        top = chain[-1]
        mean = sums[top] / (size * size[top])
        mean[~open_] = np.inf
        mean[top] = np.inf
        best = int(mean.argmin())
        if len(chain) > 1 and mean[chain[-2]] <= mean[best]:
            best = chain[-2]
        if not mean[best] < limit:
            open_[chain] = False  # what led here is at least as far from all else
            chain = []
        elif len(chain) > 1 and best == chain[-2]:
            a, b = sorted((top, best))
            del chain[-2:]
            sums[a] += sums[b]
            sums[:, a] = sums[a]
            size[a] += size[b]
            of[of == b] = a
            open_[b] = False
        else:
            chain.append(best)


def _nearest(sums: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``count`` least values of each row, or of all, and what no other value is under."""
    n = sums.shape[1]
    if n <= count:
        return np.tile(np.arange(n), (len(sums), 1)), np.full(len(sums), np.inf)
    at, bound = None, np.full(len(sums), np.inf)
    if n > 64 * 4 * count:  # of stretches of 64, those with the least values
        least = np.minimum.reduce(sums[:, : n - n % 64].reshape(len(sums), -1, 64), axis=2)
        stretch = np.argpartition(least, count, axis=1)[:, : count + 1]
        bound = np.take_along_axis(least, stretch[:, count:], axis=1)[:, 0]
        tail = np.tile(np.arange(n - n % 64, n), (len(sums), 1))
        at = np.hstack([(stretch[:, :count, None] * 64 + np.arange(64)).reshape(len(sums), -1), tail])
        sums = np.take_along_axis(sums, at, axis=1)
    order = np.argpartition(sums, count, axis=1)[:, : count + 1]
    bound = np.minimum(bound, np.take_along_axis(sums, order[:, count:], axis=1)[:, 0])
    order = order[:, :count]
    return (order if at is None else np.take_along_axis(at, order, axis=1)), bound


def _still(now: np.ndarray, apart: np.ndarray, heavy: np.ndarray, beyond: np.ndarray, total: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Each cluster's nearest one and their distance, by those that were listed when it was asked: what they went into now (-1: settled), how far they were and of what weight.

    All others were at least ``beyond``, so a cluster that has such parts too is at least at the weighted mean of both. Where that leaves doubt, the nearest one is -1.
    """
    weight = np.where(now < 0, np.inf, total[now])
    same = now[:, :, None] == now[:, None, :]
    with np.errstate(invalid="ignore"):
        known, sums = (same * heavy[:, None, :]).sum(axis=2), np.where(same & (heavy > 0)[:, None, :], (heavy * apart)[:, None, :], 0.0).sum(axis=2)
        mean = np.where(now < 0, np.inf, (sums + np.where(weight > known, (weight - known) * beyond[:, None], 0.0)) / weight)
    whole = (weight == known) & (now >= 0)
    best = np.where(whole, mean, np.inf).min(axis=1, initial=np.inf)
    least = np.minimum(np.where(whole, np.inf, mean).min(axis=1, initial=np.inf), beyond)
    name = np.where(whole & (mean == best[:, None]), now, len(total)).min(axis=1, initial=len(total))
    sure = (best < least) | (np.minimum(best, least) >= limit)
    return np.where(sure, np.where(name < len(total), name, 0), -1), np.where(sure, best, np.inf)


def chains(x: np.ndarray, weight: np.ndarray, limit: float) -> np.ndarray:
    """The cluster of each row of ``x``, numbered by first row. ``weight``: how many equal rows each stands for.

    While there are more clusters than a table of all their sums may have, all that are each other's nearest merge, round by round, and only what merged or lost its nearest is asked
    again; then chains follow in the table. Of equally near clusters the one with the first row is taken.
    """
    n = len(x)
    members = {i: [i] for i in range(n)}  # open clusters' rows, by the first one
    made = _Sums(x, weight)
    of, now = np.arange(n), np.arange(n)  # each row's cluster once settled; the open cluster that each name went into, or -1
    total = weight.astype(float)
    near, far = np.full(n, -1), np.full(n, np.inf)
    listed, apart, heavy, beyond = np.full((n, LISTED), -1), np.full((n, LISTED), np.inf), np.zeros((n, LISTED)), np.full(n, np.inf)
    asked = np.arange(n)
    while members:
        names = np.array(sorted(members))
        if len(names) ** 2 <= KEPT_SUMS:
            table = np.empty((len(names), len(names)))
            for some, sums in made.blocks(members, names, names):
                table[np.searchsorted(names, some)] = sums
            first = names[_chains(table, total[names], limit)]
            for c, a in zip(names.tolist(), first.tolist(), strict=True):
                of[members[c]] = a
            break
        for some, sums in made.blocks(members, asked, names):
            sums /= total[names]
            sums[np.arange(len(some)), np.searchsorted(names, some)] = np.inf
            least = sums.argmin(axis=1)
            near[some], far[some] = names[least], sums[np.arange(len(some)), least] / total[some]
            at, bound = _nearest(sums, LISTED)
            listed[some], apart[some], heavy[some] = -1, np.inf, 0.0
            listed[some, : at.shape[1]], apart[some, : at.shape[1]] = names[at], np.take_along_axis(sums, at, axis=1) / total[some, None]
            heavy[some, : at.shape[1]], beyond[some] = total[names[at]], bound / total[some]
        shut = names[~(far[names] < limit)]  # at least as far from all that comes
        for c in shut.tolist():
            of[members.pop(c)] = c
            made.kept.pop(c, None), made.added.pop(c, None)
        now[np.isin(now, shut)] = -1
        left = np.array(sorted(members), int)
        lost = now[near[left]] != near[left]
        pairs = left[~lost & (near[near[left]] == left) & (left < near[left])]
        if not len(pairs) and not lost.any() and len(left):  # sums that rounding made unequal both ways
            c = int(left[far[left].argmin()])
            pairs, near[near[c]] = np.array([min(c, near[c])]), c
            near[pairs] = c + near[c] - pairs
        into = np.arange(n)
        for a, b in zip(pairs.tolist(), near[pairs].tolist(), strict=True):
            made.merge(a, b, members)
            total[a] += total[b]
            into[b] = a
        now = np.where(now < 0, now, into[now])
        left = np.array(sorted(members), int)
        merged = np.isin(left, pairs)
        lost = left[~merged & ((now[near[left]] != near[left]) | np.isin(near[left], pairs))]
        near[lost], far[lost] = _still(now[listed[lost]], apart[lost], heavy[lost], beyond[lost], total, limit)
        asked = np.union1d(left[merged], lost[near[lost] < 0])
    first = np.full(n, n)
    np.minimum.at(first, of, np.arange(n))
    return np.unique(first[of], return_inverse=True)[1]


def _pairs(tiles: DataFrame, key: list[str], shape: str, spanning, tag: str) -> DataFrame:
    return materialize(tiles.groupBy(*key, "_tile").applyInArrow(spanning, shape), tag)


def average_linkage(df: DataFrame, key: list[str], vector: str, tie: str = "id", limit: float = 0.5) -> DataFrame:
    """(key, ``tie``, cluster): rows of a key whose vectors merge while clusters are less than ``limit`` apart on average, by Euclidean distance.

    Clusters are numbered from 0 in the order of their least ``tie`` (unique in a key). Equal vectors are one cluster at once, if ``limit`` is above 0. Null vectors, those with null
    or non-finite components and empty ones are in no cluster and have no row; vectors of other lengths than the key's most frequent one (of ties the longest) neither.
    A task holds a tile's vectors, or a component's distinct ones.
    """
    spark = df.sparkSession
    fine = F.forall(F.col("_v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(*key, F.col(tie).alias("_tie"), F.col(vector).cast("array<double>").alias("_v")).where(fine & (F.size("_v") > 0))
    lengths = rows.groupBy(*key, F.size("_v").alias("_n")).agg(F.count(F.lit(1)).alias("_c")).groupBy(*key).agg(F.max_by("_n", F.struct("_c", "_n")).alias("_n"))
    rows = rows.join(lengths, key).where(F.size("_v") == F.col("_n")).drop("_n")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, c: a + c * c))
    # equal vectors are one with a weight
    distinct = rows.groupBy(*key, "_v").agg(F.min("_tie").alias("_id"), F.count(F.lit(1)).alias("_w")).withColumn("_slab", F.floor(norm / limit))
    distinct = materialize(distinct, "cluster-vectors")
    kind = {f.name: f.dataType.simpleString() for f in distinct.schema}
    names = "".join(f"`{c}` {kind[c]}, " for c in key)
    tiled = f"{names}_id {kind['_id']}, _root {kind['_id']}", _spanning(limit * (1 + 1e-9))  # a little more than the limit: what a chain merges is connected however sums are rounded

    # a key's vectors in blocks, each beside some that all its blocks have: mostly these connect what is connected
    counts = materialize(distinct.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (TILE // 2)).cast("int").alias("_blocks")), "cluster-blocks")
    block = lambda: F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
    dealt = distinct.join(counts, key).select(*key, block().alias("_tile"), "_id", "_v")
    drawn = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_id"), "_id"))).where(F.col("_n") <= SHARED)
    drawn = drawn.join(counts, key).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where(F.col("_tile") != block())
    pairs = _pairs(dealt.unionByName(drawn.select(*key, "_tile", "_id", "_v")), key, *tiled, "cluster-pairs")
    roots = connected(pairs, key, "_id", "_root")

    # what these may have missed: pairs of blocks of vectors of about one norm, but not of one large component
    large = materialize(roots.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= TILE // 2).drop("_n"), "cluster-large")
    within = roots.join(large, [*key, "root"]).select(*key, F.col("id").alias("_id"), F.array("root").alias("_in"))
    own = distinct.join(counts.where("_blocks > 1").select(*key), key).join(within, [*key, "_id"], "left").withColumn("_in", F.coalesce("_in", F.array().cast(f"array<{kind['_id']}>")))
    blocks = materialize(own.groupBy(*key, "_slab", "_in").agg(F.ceil(F.count(F.lit(1)) / (TILE // 2)).cast("int").alias("_blocks")), "cluster-blocks")
    other = blocks.select(*key, F.col("_slab").alias("_s"), F.col("_in").alias("_i"), F.col("_blocks").alias("_b"))
    own = own.join(blocks, [*key, "_slab", "_in"]).withColumn("_block", block())
    spread = own.select(*key, "_id", "_v", "_slab", "_in", "_block", F.explode(F.array(F.col("_slab") - 1, F.col("_slab"), F.col("_slab") + 1)).alias("_s")).join(other, [*key, "_s"])
    spread = spread.where((F.size("_in") == 0) | (F.col("_in") != F.col("_i"))).select("*", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_with"))
    mine, theirs = F.struct(F.col("_slab").alias("s"), F.col("_in").alias("i"), F.col("_block").alias("b")), F.struct(F.col("_s").alias("s"), F.col("_i").alias("i"), F.col("_with").alias("b"))
    rest = _pairs(spread.select(*key, F.struct(F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high")).alias("_tile"), "_id", "_v"), key, *tiled, "cluster-pairs")
    first = roots
    if not rest.isEmpty():
        roots = connected(pairs.unionByName(rest), key, "_id", "_root")

    def link(_, table):
        table = table.sort_by("_id")
        vectors = table.column("_v").combine_chunks()
        number = chains(np.asarray(vectors.flatten(), float).reshape(len(table), -1), np.asarray(table.column("_w"), float), limit)
        at = np.unique(number, return_index=True)[1][number]
        return table.select([*key, "_id"]).append_column("_first", table.column("_id").take(pa.array(at)))

    # large components are few; many partitions keep them apart
    most = roots.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= TILE).count()
    joined = distinct.join(roots.withColumnRenamed("id", "_id"), [*key, "_id"]).select(*key, "root", "_id", "_w", "_v").repartition(max(shuffle_partitions(spark), min(30 * most, 4096)), *key, "root")
    grouped = joined.groupBy(*key, "root").applyInArrow(link, f"{names}_id {kind['_id']}, _first {kind['_id']}")
    named = materialize(distinct.select(*key, "_id", "_v").join(grouped, [*key, "_id"], "left").select(*key, "_v", F.coalesce("_first", "_id").alias("_first")), "cluster-names")
    numbers = named.select(*key, "_first").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(*key).orderBy("_first")) - 1)
    out = materialize(rows.join(named, [*key, "_v"]).join(numbers, [*key, "_first"]).select(*key, F.col("_tie").alias(tie), "cluster"), "clusters")
    discard(distinct, counts, blocks, pairs, rest, large, first, named, *([] if roots is first else [roots]))
    return out
