"""Text vectors kept between runs: a table of (digest, embedding) to which a run adds only digests it hasn't seen.

Every row stands for itself, so parts of an interrupted run are of use, and a digest that two runs
wrote at once is read once. Null texts count as empty ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lurelens.functions.text import blank
from lurelens.operators.enrichment import left_on_key

SCHEMA = "_digest string, embedding array<float>"


def keyed_texts(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_digest", F.sha2(blank(text), 256))


def encoded(texts: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(digest, embedding) of (digest, text) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_digest": batch["_digest"], "embedding": encoder(batch[text].tolist())})

    return texts.select("_digest", text).mapInPandas(run, SCHEMA)


class VectorStore:
    """Vectors of one encoder below a shared folder. ``name`` must change when the encoder does."""

    def __init__(self, spark: SparkSession, folder: str, name: str, encoder: Callable[[list[str]], list[list[float]]]):
        self.spark, self.encoder, self.path = spark, encoder, f"{folder}/{name}"
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self.path)

    def vectors(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.groupBy("_digest").agg(F.first("embedding").alias("embedding"))

    def add(self, df: DataFrame, text: str) -> int:
        """Encodes the texts that have no vector yet; returns how many. Copies fold to one row before texts move."""
        distinct = keyed_texts(df, text).groupBy("_digest").agg(F.min(blank(text)).alias(text))
        unseen = distinct.join(self.spark.read.schema(SCHEMA).parquet(self.path).select("_digest"), "_digest", "left_anti")
        seen = Observation()
        encoded(unseen, text, self.encoder).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(self.path)
        return seen.get["n"]

    def encode(self, df: DataFrame, text: str, spread: tuple[str, ...] = ("id",)) -> DataFrame:
        """``df`` with ``embedding``; a text that stands in many rows is spread by the ``spread`` columns."""
        self.add(df, text)
        return left_on_key(keyed_texts(df, text), self.vectors(), "_digest", spread).drop("_digest")


def hashed_words(texts: list[str], size: int = 32) -> list[list[float]]:
    """A small encoder without a model: signed counts of hashed words, unit norm."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts):
        for word in text.lower().split():
            code = zlib.crc32(word.encode("utf-8", "replace"))
            row[code % size] += 1 if code >> 31 else -1
    return list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))
