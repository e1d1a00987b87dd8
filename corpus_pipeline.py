"""A training corpus from raw documents: quality, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it and gives it to the next one. All but
the last keep the columns of ``documents``, picked by name, whatever else a table has. The last returns the manifest of the
mix: which documents to read and how often. Every stage runs on empty tables, nulls in any column, repeated rows and texts
of any length; what it does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import common, decontaminate, mixing, near_dedup, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Tables that the results of stages read; those of earlier stages go when the next one begins.
_held: list[common.Scratch] = []


def _scratch(docs: DataFrame) -> common.Scratch:
    """Tables for one stage. What earlier stages stored goes, for their results have been written by now; only tables that
    ``docs`` itself still reads stay."""
    reads = docs.inputFiles() if _held else []
    for held in _held[:]:
        name = held.base.rsplit("/", 1)[1]
        if not any(name in path for path in reads):
            held.drop()
            _held.remove(held)
    _held.append(common.Scratch(docs.sparkSession))
    return _held[-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Language references come from the stage's own input. A null or empty text has no
    words, so it goes; a null lang is held against the nearest reference; repeated rows stay or go together."""
    return quality.judge(docs.select(COLUMNS), scratch=_scratch(docs)).filter("kept").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Null and empty texts, and rows without an id,
    are like nothing and stay. Rows of one id with different texts are told apart by the text; equal rows stay or go
    together. Only ids and hashes of what goes are joined."""
    docs = docs.select(COLUMNS)
    gone = near_dedup.near_duplicates(docs, held=_scratch(docs)).filter("not kept").select("doc_id", "text_hash").distinct()
    return docs.join(gone.withColumnRenamed("doc_id", "gone"), (F.col("doc_id") == F.col("gone")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, in whole characters; so do documents of which nothing is left. A null text
    becomes an empty one and stays; rows of one id, and rows without one, which come last, don't cut each other."""
    _scratch(docs)
    out = suffix_dedup.suffix_array_dedup(docs, keep=("lang", "source"), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    out = out.filter((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts have no window and stay."""
    return decontaminate.decontaminate(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"), scratch=_scratch(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of what the mix takes; documents that it leaves out, or that have no words, are not in it. A null source
    is a source of its own, repeated rows each have their line."""
    out = mixing.mix(docs.select(COLUMNS), keep=("lang", "n_chars"), scratch=_scratch(docs))
    return out.filter("taken > 0").select("doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mixing_stage),
]
#: SQL can't express the stages on whole tables; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again; a stage's input goes once
    the next one is written."""
    docs, outputs, before = common.table(spark, sf_dir, "documents"), common.Scratch(spark), None
    for _, stage in STAGES:
        docs, read = outputs.write(stage(spark, docs, sf_dir)), before
        if read is not None:
            outputs.remove(read)
        before = docs
    for held in _held:
        held.drop()
    _held.clear()
    return docs
