"""From raw documents to packed training sequences, in five stages.

Each stage takes and (but for the last) returns rows with the columns of
``documents``; every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, line_dedup, ngram_join, packing, quality
from ledgerlake.llm.common import stash, table, unstash
from ledgerlake.llm.tokens import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, learnt from ``labels`` outside the held-out fold, gives 0.7 at least."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(docs, labels, ~quality.held_out(), metadata=("n_chars",))
    return quality.score(docs, machine, threshold=0.7).where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; those of which no word is left go, and n_chars follows the text."""
    got = line_dedup.drop_recurring_lines(docs)
    got = got.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    chars = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return got.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group that 5-word shingles link at 0.8."""
    return ngram_join.one_of_each_component(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the classifier is learnt, and packing is a search. Tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}")
            unstash(kept)  # the table of the stage before: nothing reads it any more
    return docs
