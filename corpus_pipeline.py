"""The corpus pipeline: its stages in order, each reading what the one before wrote.

Toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark items go, sources are mixed to their target weights (a document once per epoch),
and what is left is written as token files. Rows may have null texts (empty) and null ids:
a null id is never a duplicate and never contaminated by its id, so it stays until the end.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm import decontaminate, mixing, simhash, token_files, toxicity
from hustings.llm.common import Scratch, table

TOKENIZER = "word_bpe_49k.json"
MEMO = 200_000  # by its last stage an executor's heap is in use, which leaves the Python workers less


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the learned classifier does not predict toxic."""
    model = toxicity.learn(spark, sf_dir, docs)
    return toxicity.clean(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies, by five-word shingles at similarity 0.8.

    Candidates come from the SimHash grid and, beyond its distance, from cells of min-hashes.
    Different texts of one doc_id stay unless they are near copies. Of rows with the same
    doc_id and text the smallest stays; rows without an id stay as they are.
    """
    own = docs.where("doc_id IS NOT NULL")
    found = simhash.near_copies(own, Scratch(spark, "pipeline-simhash"))
    kept = found.where("first").select("doc_id", "mark").distinct()
    # A row is one struct here, so that no name of ours can meet one of its columns.
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    rows = own.select("doc_id", mark, F.struct(F.col("text").alias("by"), F.struct(*docs.columns).alias("row")).alias("one"))
    smallest = rows.join(kept, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.min("one").alias("one"))
    return smallest.select("one.row.*").unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the chosen mix; one that is used in n epochs comes n times.

    A column `domain` of the documents is used if there is one.
    """
    placed = docs if "domain" in docs.columns else docs.withColumn("domain", mixing.domain())
    return mixing.mix(placed).select("row.*").select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: a row per document and epoch."""
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER), memo=MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

# The learned classifier has no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
