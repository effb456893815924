"""Readers and writers of files: JSON documents and plans, subtitles, logs, CSV, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.text import srt_time

PLAN_SCHEMA = "version string, source string, actions array<struct<type:string,start_ms:bigint,end_ms:bigint,score:double,style:string,duration_ms:bigint>>, render struct<format:string,codec:string,crf:bigint>"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A row for each document: a file, which may run over lines, or with ``lines`` a line, which Spark can split."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database, in parts by ranges of ``key`` if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def parse_plans(df: DataFrame, column: str) -> DataFrame:
    """Adds plan (parsed) and plan_errors: what a plan breaks of the fixed schema. Values are reported, not changed."""
    p = F.from_json(column, PLAN_SCHEMA)
    out = df.withColumn("plan", p)
    raw = lambda name: F.get_json_object(column, f"$.{name}")
    missing = [F.when(raw(f).isNull(), f"missing {f}") for f in ("version", "source", "actions", "render", "render.format", "render.codec", "render.crf")]
    action = lambda bad: F.exists("plan.actions", bad)
    rules = {
        "action type": action(lambda a: F.coalesce(~a["type"].isin("cut", "transition"), F.lit(True))),
        "negative time": action(lambda a: (F.coalesce(a["start_ms"], F.lit(0)) < 0) | (F.coalesce(a["end_ms"], F.lit(0)) < 0) | (F.coalesce(a["duration_ms"], F.lit(0)) < 0)),
        "score range": action(lambda a: ~F.coalesce(a["score"], F.lit(0.0)).between(0, 1)),
    }
    return out.withColumn("plan_errors", F.array_compact(F.array(*missing, *[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()])))


_CUE = r"(\d{2}):(\d{2}):(\d{2}),(\d{3}) --> (\d{2}):(\d{2}):(\d{2}),(\d{3})"


def parse_srt(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """A row for each cue of a subtitle text: cue (from 1), start_ms, end_ms."""
    group = lambda i: F.regexp_extract_all(content, F.lit(_CUE), F.lit(i)).alias(f"g{i}")
    cues = df.select(*key, *[group(i) for i in range(1, 9)]).select(*key, F.posexplode(F.arrays_zip(*[f"g{i}" for i in range(1, 9)])).alias("i", "c"))
    n = lambda i: F.col(f"c.g{i}").cast("long")
    at = lambda a: ((n(a) * 60 + n(a + 1)) * 60 + n(a + 2)) * 1000 + n(a + 3)
    return cues.select(*key, (F.col("i") + 1).alias("cue"), at(1).alias("start_ms"), at(5).alias("end_ms"))


def subtitle_issues(cues: DataFrame, key: list[str]) -> DataFrame:
    """Cues that end before they begin, or after the next begins."""
    w = Window.partitionBy(*key).orderBy("cue")
    bad = F.array_compact(F.array(F.when(F.col("start_ms") >= F.col("end_ms"), "Invalid timing"), F.when(F.col("end_ms") > F.lead("start_ms").over(w), "Timing overlap")))
    return cues.withColumn("_bad", bad).select(*key, "cue", F.explode("_bad").alias("issue"))


def to_srt(lines: DataFrame, key: list[str], style: str = "srt") -> DataFrame:
    """Subtitle texts of lines (line, start, end in seconds, text): one row a key, as SRT or WebVTT."""
    at = lambda c: srt_time(F.round(F.col(c) * 1000))
    time = F.concat(at("start"), F.lit(" --> "), at("end"))
    cue = F.concat(F.col("line").cast("string"), F.lit("\n"), F.translate(time, ",", ".") if style == "vtt" else time, F.lit("\n"), F.col("text"), F.lit("\n\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", cue.alias("cue")))), lambda x: x["cue"]), "")
    return lines.groupBy(*key).agg(F.concat(F.lit("WEBVTT\n\n") if style == "vtt" else F.lit(""), body).alias("content"))


def to_subtitle_json(lines: DataFrame, words: DataFrame, key: list[str], slug: str, tie: str = "pos") -> DataFrame:
    """A clip's subtitles (lines: line, start, end in seconds, text) with their words (``tie``, word, start, end, confidence) as JSON: one row a key.

    clip_info has the slug, the clip's bounds, which are those of its words, its number of words and their mean confidence; each subtitle its times within the clip, the mean confidence
    of its words, and the words: those that begin from its start on and before the next line. Words before the first line are in none. A clip without words has no row.
    """
    ms = lambda c: F.round(c * 1000).cast("long")
    w = Window.partitionBy(*key).orderBy("start", "_side", tie)
    mark = F.struct("line", F.col("start").alias("from"), F.col("end").alias("to"), "text")
    marks = lines.select(*key, "start", F.lit(0).alias("_side"), F.lit(None).cast(dict(words.dtypes)[tie]).alias(tie), mark.alias("_line"), *[F.lit(None).cast(dict(words.dtypes)[c]).alias(c) for c in ("word", "end", "confidence")])
    both = words.select(*key, "start", F.lit(1).alias("_side"), tie, F.lit(None).cast(dict(marks.dtypes)["_line"]).alias("_line"), "word", "end", "confidence").unionByName(marks)
    placed = both.withColumn("_line", F.last("_line", ignorenulls=True).over(w))
    said = placed.where("_side = 1")
    word = F.struct("start", F.col(tie).alias("_t"), "word", "end", "confidence")
    shown = lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), x["confidence"].alias("confidence"))
    per_line = placed.where("_line IS NOT NULL").groupBy(*key, "_line").agg(F.avg(F.when(F.col("_side") == 1, F.col("confidence"))).alias("_c"), F.transform(F.sort_array(F.collect_list(F.when(F.col("_side") == 1, word))), shown).alias("_w"))
    info = said.groupBy(*key).agg(F.min("start").alias("_a"), F.max("end").alias("_b"), F.count(F.lit(1)).alias("_n"), F.avg("confidence").alias("_mean"))
    begin = ms(F.col("_a"))
    cue = per_line.join(info, key).select(*key, F.struct(F.col("_line.line").alias("index"), (ms(F.col("_line.from")) - begin).alias("start_ms"), (ms(F.col("_line.to")) - begin).alias("end_ms"), F.col("_line.text").alias("text"), F.col("_c").alias("confidence"), F.col("_w").alias("words")).alias("_cue"))
    cues = cue.groupBy(*key).agg(F.sort_array(F.collect_list("_cue")).alias("_cues"))
    clip = F.struct(F.expr(slug).alias("slug"), begin.alias("start_ms"), ms(F.col("_b")).alias("end_ms"), (ms(F.col("_b")) - begin).alias("duration_ms"), F.col("_n").alias("word_count"), F.col("_mean").alias("average_confidence"))
    return info.join(cues, key, "left").select(*key, F.to_json(F.struct(clip.alias("clip_info"), F.coalesce("_cues", F.array()).alias("subtitles"))).alias("content"))


def write_texts(df: DataFrame, path: str, key: str, content: str = "content") -> None:
    """Texts below a folder for each key."""
    df.select(key, F.col(content).alias("value")).write.partitionBy(key).text(path)


def parse_logs(df: DataFrame, line: str = "value") -> DataFrame:
    """ts, level, logger and message of lines ``ts | LEVEL | logger | message``; other lines go."""
    parts = F.split(F.col(line), r" \| ", 4)
    return df.where(F.size(parts) == 4).select(F.try_to_timestamp(parts[0], F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"), F.trim(parts[1]).alias("level"), F.trim(parts[2]).alias("logger"), parts[3].alias("message"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of file,commit_count."""
    return spark.read.schema("file string, commit_count bigint").csv(path, header=True, escape='"')


def write_counts(df: DataFrame, path: str, name: str, count: str) -> None:
    df.orderBy(F.col(count).desc(), name).write.csv(path, header=True, escape='"')


def exposition(df: DataFrame, name: str, value: str, labels: list[str], kind: str = "gauge") -> DataFrame:
    """Samples of a long metric table as text lines ``name{label="value",...} number``, each metric's type before its samples: name, place (0: the type), line."""
    text = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    parts = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), text(c), F.lit('"'))) for c in labels])
    line = F.concat(F.col(name), F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit("{"), parts, F.lit("}"))), F.lit(" "), F.col(value).cast("string"))
    samples = df.select(F.col(name).alias("name"), F.lit(1).alias("place"), line.alias("line"))
    return df.select(F.col(name).alias("name")).distinct().select("name", F.lit(0).alias("place"), F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}")).alias("line")).unionByName(samples)
