"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, leaked test items go, personal data is masked, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and reads its docs from the Parquet its predecessor wrote; all but the last return
the columns of documents. Rows with null or empty texts pass all filters, as nothing speaks against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurelens.llm import bpe, decontamination, minhash, pii, queries, toxicity
from lurelens.llm.common import shared_folder, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, k=5, percent=80)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_documents(docs, pii.fit(pii.with_candidates(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *queries.tokenizer("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaked),
    ("pii", mask_personal_data),
    ("byte_bpe", encode),
]

#: Trained classifiers and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"{number}-{name}")
    return docs
