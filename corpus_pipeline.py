"""The corpus pipeline: quality, toxicity, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Each works on all rows its predecessor kept, and only what it rejects goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import jaccard, line_dedup, packing, quality, toxicity
from gaugeline.llm.bpe import vocabulary_path
from gaugeline.llm.common import columns_of, fresh, read, small_side, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score reaches the threshold stay; the labels train it."""
    name = fresh(docs, "_quality")
    scored = quality.score_documents(docs, read(spark, sf_dir, "labels"), name=name)
    return columns_of(scored.where(F.col(name) >= quality.THRESHOLD), docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples vote below the threshold stay."""
    name = fresh(docs, "_toxicity")
    scored = toxicity.score_documents(docs, read(spark, sf_dir, "labels"), name=name)
    return columns_of(scored.where(F.col(name)["score"] < toxicity.THRESHOLD), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that three documents or more share, but for one holder;
    ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    length = F.when(F.col(line_dedup.count_names(docs)[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return columns_of(out.withColumn("n_chars", length), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones stays; a repeated row stays once."""
    groups = written(jaccard.similar_groups(docs), "similar")
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(small_side(gone, gone.count()), "doc_id", "left_anti")
    again = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = again.count()
    if n:
        twice = kept.join(small_side(again, n), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = columns_of(kept.join(small_side(again, n), "doc_id", "left_anti"), docs.columns).union(columns_of(twice, docs.columns))
    return columns_of(kept, docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in their sequences."""
    return packing.packed(docs, vocabulary_path())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Learned scores and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
