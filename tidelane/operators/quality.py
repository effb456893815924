"""Quality gates: rules on media metadata, issues of highlights, transcripts, files and timelines, and what fails hard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.text import split_words, strip_punctuation

# Limits, names and messages that the outcomes consist of.
MAX_SECONDS, MAX_WIDTH, MAX_HEIGHT, MAX_FPS = 7200, 3840, 2160, 120
VIDEO_CODECS = ["h264", "hevc", "vp9", "av1", "mpeg4", "mpeg2video"]
AUDIO_CODECS = ["aac", "mp3", "opus", "vorbis", "pcm_s16le", "pcm_s24le"]
HDR_SPACES = ["bt2020nc", "bt2020c", "smpte2084", "arib-std-b67"]
HDR_TRANSFERS = ["smpte2084", "arib-std-b67", "smpte428"]
CRITICAL = ["No highlights generated", "Timeline generation failed", "Missing output video", "Invalid timing", "Timing overlap"]


def metadata_errors() -> Column:
    """Errors of a row of duration, width, height, fps, codec, color_space, color_transfer, has_audio and audio_codec, in the order of the rules."""
    c = F.col
    among = lambda name, values: F.coalesce(c(name).isin(*values), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(c("duration") <= 0, "Invalid duration").when(c("duration") > MAX_SECONDS, "Video duration exceeds 2 hours limit"),
            F.when((c("width") == 0) | (c("height") == 0), "Invalid resolution").when((c("width") > MAX_WIDTH) | (c("height") > MAX_HEIGHT), "Resolution exceeds 4K limit"),
            F.when(c("fps") <= 0, "Invalid frame rate").when(c("fps") > MAX_FPS, "Frame rate exceeds 120fps limit"),
            F.when(~among("codec", VIDEO_CODECS), F.concat(F.lit("Unsupported video codec: "), F.coalesce("codec", F.lit("None")))),
            F.when(among("color_space", HDR_SPACES) | among("color_transfer", HDR_TRANSFERS), "HDR input not supported"),
            F.when(c("has_audio") & ~among("audio_codec", AUDIO_CODECS), F.concat(F.lit("Unsupported audio codec: "), F.coalesce("audio_codec", F.lit("None")))),
        )
    )


def highlight_issues(df: DataFrame, key: list[str], order: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Rows (key, place, issue) of highlights (text, start_ms, end_ms, audio_energy); place is the highlight's number, null for issues of all of them.

    ``keys`` names keys that should have highlights; those without any are an issue.
    """
    numbered = df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    label = F.concat(F.lit("Highlight "), F.col("place").cast("string"))
    words = F.transform(split_words("text"), lambda w: F.struct(w.alias("w"), strip_punctuation(w).alias("k")))

    def first_pair(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.when(x["k"] == y["k"], F.concat(x["w"], F.lit(" "), y["w"])))
        return F.get(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0))

    twice = F.transform(F.array(words), first_pair)[0]
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    own = F.array_compact(
        F.array(
            F.when(empty, F.concat(label, F.lit(" has empty text"))).when(twice.isNotNull(), F.concat(label, F.lit(" contains duplicate words: '"), twice, F.lit("'"))),
            F.when(F.col("start_ms") >= F.col("end_ms"), F.concat(label, F.lit(" has invalid timing: start "), F.col("start_ms").cast("string"), F.lit(" >= end "), F.col("end_ms").cast("string"))),
            F.when(seconds < 3.0, F.concat(label, F.format_string(" too short: %.1fs < 3.0s minimum", seconds))).when(seconds > 30.0, F.concat(label, F.format_string(" too long: %.1fs > 30.0s maximum", seconds))),
        )
    )
    rows = numbered.select(*key, "place", F.explode(own).alias("issue"))
    n, kinds = F.col("_energies"), F.col("_kinds")
    sets = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count("audio_energy").alias("_energies"), F.countDistinct(F.when(F.col("audio_energy").isNotNull(), F.format_string("%.3f", "audio_energy"))).alias("_kinds"), F.min_by("audio_energy", F.struct(F.col("audio_energy").isNull(), *order)).alias("_first"))
    if keys is not None:
        sets = keys.select(*key).distinct().join(sets, key, "left").fillna(0, ["_n", "_energies", "_kinds"])
    of_all = F.array_compact(
        F.array(
            F.when(F.col("_n") == 0, "No highlights generated").when(F.col("_n") < 2, F.format_string("Insufficient highlights: %d < 2 minimum", "_n")),
            F.when(n > 0, F.when(kinds == 1, F.concat(F.lit("All highlights have identical audio energy: "), F.col("_first").cast("string"))).when(kinds < n * 0.7, F.format_string("Low audio energy diversity: %d/%d unique values", "_kinds", "_energies"))),
        )
    )
    return rows.unionByName(sets.select(*key, F.lit(None).cast("int").alias("place"), F.explode(of_all).alias("issue")))


def transcript_issues(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, issue) of word_count and speaker_turns."""
    words, turns = F.coalesce("word_count", F.lit(0)), F.coalesce("speaker_turns", F.lit(0))
    found = F.array_compact(
        F.array(
            F.when(words < 100, F.format_string("Insufficient transcription: %d words < 100 minimum", words)),
            F.when(turns > 200, F.format_string("Excessive speaker turns: %d > 200 (over-segmentation)", turns)).when(turns < 1, F.format_string("No speaker turns detected: %d", turns)),
        )
    )
    return df.select(*key, F.explode(found).alias("issue"))


def file_issues(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, issue) of files (kind video or subtitle, path, size; size null: missing)."""
    video, missing = F.col("kind") == "video", F.col("size").isNull()
    issue = (
        F.when(video & missing, F.concat(F.lit("Missing output video: "), F.col("path")))
        .when(video & (F.col("size") < 1024 * 1024), F.format_string("Output video suspiciously small: %d bytes", "size"))
        .when(~video & missing, F.concat(F.lit("Missing subtitle file: "), F.col("path")))
        .when(~video & (F.col("size") < 50), F.format_string("Subtitle file suspiciously small: %s (%d bytes)", "path", "size"))
    )
    return df.select(*key, issue.alias("issue")).where("issue IS NOT NULL")


def gate(keys: DataFrame, issues: DataFrame, key: list[str]) -> DataFrame:
    """Each key's number of issues, how many of them are critical, and the outcome: valid, flawed or failed."""
    critical = F.col("issue").rlike("|".join(CRITICAL))
    counts = issues.groupBy(*key).agg(F.count(F.lit(1)).alias("issues"), F.count_if(critical).alias("critical"))
    out = keys.select(*key).distinct().join(counts, key, "left").fillna(0, ["issues", "critical"])
    return out.withColumn("outcome", F.when(F.col("critical") > 0, "failed").when(F.col("issues") > 0, "flawed").otherwise("valid"))
