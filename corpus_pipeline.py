"""Corpus preparation in five stages; each takes what its predecessor kept.

quality      documents that the classifier scores below 0.3 go
near_dedup   one document of each near-duplicate class stays
decontaminate  documents that contain a benchmark item to 0.8 go
secrets      spans that are credentials are replaced by [SECRET]; n_chars follows the text
bpe          token count and digests of the ids and of the decoded bytes

Defined results, by stage (quality, near_dedup, decontaminate, secrets, bpe):

* a null or empty text: scored as a difference of zero, kept; stays, each on its own; contains no item, stays; stays as it is; no tokens
* very long texts: taken whole by every stage
* ties and repeated rows: scored alike; one row stays for each class, of equal ids the first; judged each; replaced each; encoded each
* null ids: all stages keep such rows; near_dedup keeps one row of each class whose ids are all null
* an empty table: gives an empty table, of the columns of documents but for bpe
* extra columns, also with names that a stage uses itself (score, id, part, spans): kept by all but bpe, which returns its own
* without labels (or with labels of one kind) every text scores the smoothed share of good labels; without items all rows stay; without
  base matches to learn from only base spans are replaced
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import byte_bpe, dartminhash, lsh_ensemble, secret_automata, zstd_quality
from docquarry.llm.common import table, write_shared
from docquarry.llm.registry import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return zstd_quality.keep(docs, zstd_quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_ensemble.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_automata.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("bpe", bpe)]

#: Compression, dart throwing, state merging and BPE are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
