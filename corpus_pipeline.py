"""The corpus pipeline: language ID, quality rules, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet and hands what it reads back to the next stage.

Null texts go in the first stage (no letter). Rows without a doc_id stay until packing; of rows that share a doc_id
near-duplicate removal leaves the one that is first by text, then by its other columns. Near-duplicates link from a
similarity of NEAR_PERCENT on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import language_id, near_dedup, packing, quality_rules, secret_scan
from newsloom.llm.common import materialise, table
from newsloom.llm.queries import held_out

#: The pipeline's models can't be written as SQL; tests hold its rows against a brute-force version.
ORACLE_SQL = None
LEAST_SCORE = 0.5
NEAR_PERCENT = 80
#: Smaller memos than op8's: here the executors' heaps have grown full in the stages before.
PACKING_MEMO_BYTES = 16 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told; those without a letter, or of no language more likely than all others together, go."""
    model = language_id.train(docs.where(~held_out()))
    known = language_id.identify(docs, model, carry=True)
    return known.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    return quality_rules.assess(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    keepers = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    text_first = sorted(rest, key=lambda c: c != "text")
    once = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*text_first)).alias("row"))
    return once.join(keepers, "doc_id", "left_semi").select("doc_id", "row.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    masked = secret_scan.mask(docs, secret_scan.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.packed_pieces(docs, keep_ids=False, memo_bytes=PACKING_MEMO_BYTES)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
