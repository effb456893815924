"""Text functions as column expressions, but for masking, which needs a match's groups."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.functions import lexicons as lex

_BLANK = r"[ \t\n\r\f\x0b]+"


def split_words(text) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(text, _BLANK), lambda x: x != "")


def word_count(text) -> Column:
    return F.size(split_words(text))


def strip_punctuation(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(".,!?;:"))


def drop_repeats(text) -> Column:
    """A text without words that repeat the word before, but for case and outer punctuation; words of punctuation only stay. Texts of one word or none are left as they are."""
    column = F.col(text) if isinstance(text, str) else text
    keyed = F.transform(split_words(text), lambda x: F.struct(x.alias("w"), strip_punctuation(x).alias("k")))

    def joined(words: Column) -> Column:
        pairs = F.zip_with(words, F.concat(F.array(F.lit(None).cast("struct<w:string,k:string>")), words), lambda x, before: F.when(~F.coalesce((x["k"] == before["k"]) & (x["k"] != ""), F.lit(False)), x["w"]))
        return F.when(F.size(words) <= 1, column).otherwise(F.array_join(F.filter(pairs, lambda x: x.isNotNull()), " "))

    return _bound(keyed, joined)


def title(text) -> Column:
    """The first six words without repeats, cut to 37 characters and an ellipsis."""
    t = drop_repeats(F.array_join(F.slice(split_words(text), 1, 6), " "))
    return F.when(F.length(t) > 37, F.concat(F.substring(t, 1, 37), F.lit("..."))).otherwise(t)


def beat_title(beat, text) -> Column:
    names = F.create_map(*[F.lit(x) for kv in lex.BEAT_TITLES.items() for x in kv])
    t = F.concat(F.coalesce(names[F.col(beat)], F.lit("Segment")), F.lit(": "), F.array_join(F.slice(split_words(text), 1, 4), " "))
    return F.when(F.length(t) > 40, F.concat(F.substring(t, 1, 40), F.lit("..."))).otherwise(t)


def word_set(text) -> Column:
    return F.array_distinct(split_words(F.lower(text)))


def jaccard(a, b) -> Column:
    """Share of common words of two texts; 0 if either has none."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a word's letters stand anywhere in the text."""
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def count_present(text: Column, words: list[str]) -> Column:
    """How many of the words' letters stand in the text."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def occurrences(text: Column, word: Column) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def keywords(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent words of more than three letters that aren't stopwords, of each row; of ties those seen first.

    A text's words are sorted and counted by the lengths of runs inside its row, so nothing is shuffled; rows that repeat a key have their words each.
    """
    found = F.expr(f"regexp_extract_all(lower({text}), '(?U)\\\\b\\\\w+\\\\b', 0)")
    kept = F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(*lex.STOPWORDS))
    placed = F.array_sort(F.transform(kept, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def counted(line: Column) -> Column:
        """Runs of one word in a sorted array: where each begins, then what lies between two begins."""
        heads = F.filter(F.transform(line, lambda x, i: F.struct(i.alias("at"), x["i"].alias("pos"), x["w"].alias("w"), ((i == 0) | (x["w"] != F.get(line, i - 1)["w"])).alias("new"))), lambda h: h["new"])
        return _bound(heads, lambda h: F.transform(h, lambda x, i: F.struct((x["at"] - F.coalesce(F.get(h, i + 1)["at"], F.size(line))).alias("less"), x["pos"].alias("pos"), x["w"].alias("w"))))

    best = F.slice(F.array_sort(_bound(placed, counted)), 1, k)  # the most first: less is the number below zero
    rows = df.select(key, F.posexplode(best).alias("rank", "_b"))
    return rows.select(key, (F.col("rank") + 1).alias("rank"), F.col("_b.w").alias("word"), (-F.col("_b.less")).cast("long").alias("n"))


def _java(pattern: str) -> str:
    """A fixed pattern with Java's Unicode classes, as Python has them for text."""
    return "(?U)" + pattern.replace(r"\s", r"\s\x1c-\x1f")


_FIRST = next(i for i, (_, g) in enumerate(lex.SECRETS) if g)
_LAST = max(i for i, (_, g) in enumerate(lex.SECRETS) if g) + 1
_GROUPED = [(re.compile(p), g) for p, g in lex.SECRETS[_FIRST:_LAST]]


def mask(text) -> Column:
    """Secrets and personal data masked by the fixed patterns in their order.

    Patterns whose whole match is masked are replaced in the JVM. For the others, a group's text is masked everywhere inside its match; these go
    batch-wise to Python, as nulls but for the texts that have a word of theirs.
    """
    column = F.col(text) if isinstance(text, str) else text
    for pattern, _ in lex.SECRETS[:_FIRST]:
        column = _replaced(column, pattern)
    signs = ["api", "passw", "pwd", "token", "secret", "bearer", "://", "\u017f"]  # the last is an s to Python, but for case
    maybe = lambda c: F.transform(F.array(F.lower(c)), lambda low: reduce(lambda x, y: x | y, (low.contains(x) for x in signs)))[0]
    column = _bound(column, lambda c: F.struct(c.alias("t"), F.when(maybe(c), c).alias("g")))
    column = F.coalesce(_mask(column["g"]), column["t"])
    for pattern, _ in lex.SECRETS[_LAST:]:
        column = _replaced(column, pattern)
    return column


def _bound(column: Column, use) -> Column:
    """``use`` of a column that is computed once."""
    return F.transform(F.array(column), use)[0]


def _replaced(column: Column, pattern: str) -> Column:
    """The text with whole matches masked; texts without what every match has are not searched."""
    some = {"sk-": lambda c: c.contains("sk-"), "AKIA": lambda c: c.contains("AKIA"), "@": lambda c: c.contains("@"), r"\d{": lambda c: c.rlike(r"(?U)\d{3}")}
    may = next(x for sign, x in some.items() if sign in pattern)
    return _bound(column, lambda c: F.when(may(c), F.regexp_replace(c, _java(pattern), lex.MASK)).otherwise(c))


def mask_groups(text: str) -> str:
    for pattern, group in _GROUPED:
        text = pattern.sub((lambda m, g=group: m[0].replace(m[g], lex.MASK)) if group else lex.MASK, text)
    return text


@F.pandas_udf(T.StringType())
def _mask(texts: pd.Series) -> pd.Series:
    some = texts.notna()
    out = texts.copy()
    out[some] = [mask_groups(x) for x in texts[some]]
    return out


def named_uuid(name: Column) -> Column:
    """A UUID that follows from a name: its md5 with the version (3) and variant bits set. Equal names have equal UUIDs, on any executor and in any retry."""
    h = F.md5(name)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), ((F.instr(F.lit("0123456789abcdef"), part(17, 1)) - 1) % 4 + 1), F.lit(1))
    return F.when(name.isNotNull(), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)))


def variant_bucket(job: Column, experiment: Column | str) -> Column:
    """1 to 100 from the md5 of ``job:experiment`` taken as a number."""
    digest = F.md5(F.concat(job.cast("string"), F.lit(":"), F.lit(experiment) if isinstance(experiment, str) else experiment))
    quarters = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rest = F.lit(0).cast("long")
    for q in quarters:
        rest = (rest * (2**32 % 100) + q) % 100
    return (rest + 1).cast("int")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    ms = ms.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def decibels_to_linear(db: Column) -> Column:
    return F.when(db > -60, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(F.lit(10.0), db / 20)))).otherwise(0.0)


def cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(F.col(a), F.col(b)), F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the points, constant beyond them."""
    out = F.lit(float(ys[-1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False))):
        out = F.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


# What counts as well-formed.
CHECKS = {
    "identifier": r"^[a-zA-Z][a-zA-Z0-9_]{0,63}$",
    "filename": r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,254}$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[a-zA-Z0-9.-]+(:[0-9]+)?(/[^\s]*)?$",
    "job_id": r"^[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}$",
}


def well_formed(value: Column, kind: str) -> Column:
    return F.coalesce(value.rlike(CHECKS[kind]), F.lit(False))
