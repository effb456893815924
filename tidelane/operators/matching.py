"""Many patterns looked for in many texts of a key, in one pass a text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts and wanted rows of a key that one task holds against each other; more are dealt to more tasks.
TEXTS, WANTED = 50_000, 20_000


class Patterns:
    """An automaton over all words of some wanted rows. Each row has a list of words, which count as often as they are listed."""

    def __init__(self, wanted: list[tuple]):
        import ahocorasick

        places: dict[str, dict] = {}
        for place, title, keywords in wanted:
            for word, weight in [(k, 1) for k in keywords or () if k is not None] + ([(title, 3)] if title is not None else []):
                own = places.setdefault(word, {})
                own[place] = own.get(place, 0) + weight
        self.always = places.pop("", {})  # every text holds the empty word
        self.words = list(places)
        self.places = [list(places[w].items()) for w in self.words]
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            self.automaton.add_word(w, i)
        if self.words:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict:
        """What each wanted row with any word in the text scores."""
        out = dict(self.always)
        for i in {i for _, i in self.automaton.iter(text)} if self.words else ():
            for place, weight in self.places[i]:
                out[place] = out.get(place, 0) + weight
        return out


def _meet(texts: DataFrame, wanted: DataFrame, key: str, tie: str, of: str, held: list[str]) -> DataFrame:
    """Rows (key, part, side, ``held``, ``tie``, text), dealt so that a part's wanted rows (side 0), by ``of``, come before its texts (side 1)."""
    count = lambda df, name, each: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias(name))
    parts = count(texts, "_parts", TEXTS).join(count(wanted, "_sets", WANTED), key)
    deal = lambda column, most: F.pmod(F.xxhash64(column), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    kinds, fields = dict(wanted.dtypes), dict(texts.dtypes)
    asked = wanted.join(parts, key).select(key, deal(of, "_sets").alias("_set"), every("_parts").alias("_part"), F.lit(0).alias("_side"), *held, F.lit(None).cast(fields[tie]).alias(tie), F.lit(None).cast("string").alias("text"))
    given = texts.where(F.col("text").isNotNull()).join(parts, key).select(key, every("_sets").alias("_set"), deal(tie, "_parts").alias("_part"), F.lit(1).alias("_side"), *[F.lit(None).cast(kinds[c]).alias(c) for c in held], tie, "text")
    rows = asked.unionByName(given).select(key, F.struct("_set", "_part").alias("_part"), "_side", *held, tie, "text")
    return rows.repartition(key, "_part").sortWithinPartitions(key, "_part", "_side")


def _groups(batches) -> Iterator[tuple[object, list[tuple], Iterator[tuple]]]:
    """(key, wanted rows, texts) of each part in turn."""

    def stream():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for group, own in groupby(stream(), key=lambda r: (r[0], r[1]["_set"], r[1]["_part"])):
        sides = groupby(own, key=lambda r: r[2])
        side, rows = next(sides)
        if side == 0:
            wanted = [r[3:-2] for r in rows]
            for _, texts in sides:
                yield group[0], wanted, ((r[-2], r[-1]) for r in texts)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def best_matches(texts: DataFrame, wanted: DataFrame, key: str, tie: str = "id") -> DataFrame:
    """(key, place, ``tie``, hits): for each of ``wanted`` (key, place, title, keywords) the text of the key (key, ``tie``, text) that scores most, ties to the smaller ``tie``; none without a hit.

    A text scores one for each keyword of the list that it holds, and three if it holds the title; case counts. A task builds an automaton over all words
    of the wanted rows it has and runs each text through it once, keeping the best text of each wanted row: pairs are never listed. Of a key with many rows, parts of the texts
    meet parts of the wanted rows. Null texts, words and keys match nothing.
    """
    kinds, places = dict(texts.dtypes), dict(wanted.dtypes)
    shape = f"{key} {kinds[key]}, place {places['place']}, {tie} {kinds[tie]}, hits int"
    arrow = to_arrow_schema(texts.sparkSession.createDataFrame([], shape).schema)

    def run(batches):
        for owner, listed, rows in _groups(batches):
            patterns, best = Patterns(listed), {}
            for row, text in rows:
                for place, score in patterns.hits(text).items():
                    old = best.get(place)
                    if old is None or score > old[0] or score == old[0] and row < old[1]:
                        best[place] = (score, row)
            if best:
                yield _batch([(owner, place, row, score) for place, (score, row) in best.items()], arrow)

    found = _meet(texts, wanted, key, tie, "place", ["place", "title", "keywords"]).mapInArrow(run, shape)
    first = F.min(F.struct((-F.col("hits")).alias("h"), F.col(tie).alias("t")))
    return found.groupBy(key, "place").agg(first.alias("_b")).select(key, "place", F.col("_b.t").alias(tie), (-F.col("_b.h")).alias("hits"))


def words_present(texts: DataFrame, words: DataFrame, key: str, word: str, tie: str = "id") -> DataFrame:
    """(key, ``tie``, hits): how many of the key's ``words`` rows each text of the key holds; texts that hold none have no row. Dealt as in :func:`best_matches`."""
    kinds = dict(texts.dtypes)
    listed = words.where(F.col(word).isNotNull()).groupBy(key, F.col(word).alias("_word")).agg(F.count(F.lit(1)).alias("_times"))
    shape = f"{key} {kinds[key]}, {tie} {kinds[tie]}, hits long"
    arrow = to_arrow_schema(texts.sparkSession.createDataFrame([], shape).schema)

    def run(batches):
        for owner, listed_here, rows in _groups(batches):
            patterns, made = Patterns([(0, None, [w for w, times in listed_here for _ in range(times)])]), []
            for row, text in rows:
                hits = patterns.hits(text).get(0, 0)
                if hits:
                    made.append((owner, row, hits))
                if len(made) >= 4096:
                    yield _batch(made, arrow)
                    made = []
            if made:
                yield _batch(made, arrow)

    return _meet(texts, listed, key, tie, "_word", ["_word", "_times"]).mapInArrow(run, shape).groupBy(key, tie).agg(F.sum("hits").alias("hits"))
