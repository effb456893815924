"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of ``docs``; the last
returns the packed pieces. An empty table passes through every stage; other columns of ``docs``, whatever their names, pass along.
"""

from __future__ import annotations

from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm import decontam, langid, ngram_join, packing, unit_dedup
from tidelane.llm.annotate import add_columns, parse
from tidelane.storage import discard, materialize, noted

_KEY = "_tidelane_key"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _key():
    return F.col("doc_id").cast("long")


def _shielded(stage):
    """A stage on documents whose other columns have names that nothing inside uses; they get their own names back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = [c if c in DOCUMENT else f"_extra_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*held), sf_dir)
        return out.toDF(*docs.columns) if out.columns == held else out

    return run


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


@_shielded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: texts that are null, have no letter, or are ambiguous between languages go.

    The classifier learns from the documents' own labels, as far as they aren't held out.
    """
    found = langid.annotate(docs, langid.train(langid.learnable(docs)))
    kept = found.where(~F.col("_ambiguous") & (F.col("_lang") != langid.UNKNOWN))
    return kept.select(*_columns(docs))


@_shielded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: that of the smallest doc_id, once. Wordless texts and null doc_ids are in no group.

    Rows that repeat a doc_id are judged each by its words; of those with the same words, the first as JSON stays.
    """
    found = materialize(ngram_join.jaccard_join(docs, digests=True), "pipeline-near")
    by_id = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(_KEY)).agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("first").alias("_some"))
    by_id = materialize(by_id.where("_rows > 1 OR NOT _some"), "pipeline-near-ids")
    same = _key() == F.col(_KEY)
    again = by_id.where("_some").select(_KEY)
    kept = docs.join(by_id.select(_KEY), same, "left_anti")
    repeated = add_columns(docs.join(again, same, "left_semi"), _digests(docs.columns.index("text")), parse("_c1 long, _c2 long"))
    firsts = found.where("first").select(F.col("doc_id").alias(_KEY), F.col("c1").alias("_d1"), F.col("c2").alias("_d2")).distinct()
    chosen = repeated.join(firsts, same & F.col("_c1").eqNullSafe(F.col("_d1")) & F.col("_c2").eqNullSafe(F.col("_d2")), "left_semi")
    order = F.row_number().over(Window.partitionBy(_key(), "_c1", "_c2").orderBy(F.to_json(F.struct(*_columns(docs)))))
    once = chosen.where("_c1 IS NOT NULL").withColumn("_n", order).where("_n = 1")
    return kept.unionByName(once.select(*_columns(docs))).unionByName(chosen.where("_c1 IS NULL").select(*_columns(docs)))


def _digests(at: int):
    return lambda batch: ngram_join.set_digests(batch.column(at).cast(pa.string()))


@_shielded
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated units out of the texts; n_chars, if there, is their new length. Documents of which nothing but white space is left go."""
    cut = unit_dedup.cut_units(docs)
    changed = F.col("_gone") > 0
    out = cut.where(~changed | F.col("_clean").rlike(r"\S")).withColumn("text", F.col("_clean"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("_clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


@_shielded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_shielded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens of all documents into sequences: see packing.pack."""
    return packing.pack(materialize(packing.cut_pieces(docs), "pipeline-pieces"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # classifiers, retrieval and packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored for the next; what a stage stored for itself goes when its result is stored, and its input with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with noted() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before, *made[:-1])
        before = made[-1:]
    return docs
