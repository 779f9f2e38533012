"""From raw documents to packed training sequences: STAGES in order, and run() over all of them.

Stages but the last return the columns of documents; each is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.llm import decontamination, near_duplicates, packing, quality, substrings
from sluicework.llm.frames import staging_path

#: No SQL: training, tokenizing and packing cannot be written in it; tests compare with plain versions.
ORACLE_SQL = None

#: The input row travels through an operator as one struct of this name, so that no input column,
#: whatever its name, meets a column the operator adds.
ROW = "__input_row"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text for the operator, the whole input row beside them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), F.col("doc_id"), F.col("text"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(ROW)[c].alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely the best one; toxic ones and junk go."""
    model = quality.train(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    graded = quality.grade(_packed(docs), model)
    return _unpacked(graded.where(quality.is_accepted()), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 on shingles of five words.

    Rows that share a doc_id with another are one document; documents without an id stay.
    """
    judged = near_duplicates.near_duplicates(docs, size=5, part=80, whole=100)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    left = docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(left.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that occurred earlier; others as they were."""
    left = substrings.remove_repeats(_packed(docs), window=50)
    changed = F.col("n_removed") > 0
    counted = {"text": F.when(changed, F.col("kept")).otherwise(F.col(ROW)["text"])}
    if "n_chars" in docs.columns:
        counted["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col(ROW)["n_chars"])
    return left.select(*[counted.get(c, F.col(ROW)[c]).alias(c) for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are passages of the benchmark."""
    found = decontamination.overlaps(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.where(~decontamination.is_contaminated()), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality), ("near_duplicates", one_of_each), ("substrings", without_repeats),
    ("decontamination", without_benchmarks), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each one's result below the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
