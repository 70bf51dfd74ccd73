"""From documents to packed training sequences: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. :func:`run` writes each result as Parquet into the session's shared folder and reads it again,
so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, queries, recompress, seqpack, sigjoin, weakrules
from gridloom.llm.durable import ensure_checkpoint_dir
from gridloom.session import attach


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of 50 words or more, mostly free of repetition, that the quality rules find good."""
    return weakrules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by 80 % of its five-word shingles."""
    return sigjoin.keep_one(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that a smaller doc_id has; n_chars follows, documents left without a word go."""
    cut = recompress.remove_repeats(docs, window=50).where("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    after = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*[after[c].alias(c) if c in after else c for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights 5, 2, 1 of their sources ask for, three times at most."""
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return seqpack.pack_documents(docs, queries.encoder, window=2048, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("mixture", mixture), ("packing", packing)]

#: No SQL: the first stage fits a model and the last one tokenizes. tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(attach(spark))}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
