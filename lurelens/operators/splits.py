"""Reproducible splits, folds and class-target sampling by hash order of the id.

A rank within a label would put half of the corpus in one task; ``global_row_number`` ranks inside
65 536 hash buckets and adds the totals of the buckets before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.functions.ranking import BUCKETS, global_row_number, hash_bucket, hash_key

RATIOS = (("train", 0.70), ("validation", 0.85), ("test", 1.0))


def _ranked(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    totals = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return global_row_number(df, keys, "id", seed).join(F.broadcast(totals), keys)  # one row per class


def stratified_split(df: DataFrame, label: str = "label", ratios=RATIOS, seed: int = 42) -> DataFrame:
    """Adds ``split``; exact cumulative cuts floor(ratio * n) within each label."""
    out = None
    for name, upto in ratios[:-1]:
        cut = F.col("rn") <= F.floor(F.col("n") * upto)
        out = F.when(cut, name) if out is None else out.when(cut, name)
    return _ranked(df, [label], seed).withColumn("split", out.otherwise(ratios[-1][0])).drop("rn", "n")


def grouped_split(group: Column, ratios=RATIOS, seed: int = 42) -> Column:
    """Split of a whole group (a sender) by the hash of its name: no shuffle, no leakage."""
    share = hash_bucket(hash_key(F.lower(group), seed)) / float(BUCKETS)
    out = None
    for name, upto in ratios[:-1]:
        out = F.when(share < upto, name) if out is None else out.when(share < upto, name)
    return out.otherwise(ratios[-1][0])


#: Senders are assigned by buckets of a hash; a very frequent sender is alone in its bucket, or nearly so.
SENDER_BUCKETS = 8192


def _assigned(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of every row of ``counts`` (groups x strata): the largest first, each to the split whose missing
    rows per stratum it fits best, which is the least growth of squared distances from the quotas."""
    totals = counts.sum(axis=0)
    held, quota = np.zeros((len(shares), counts.shape[1])), np.outer(shares, totals)
    weight = 1 / np.maximum(totals, 1)
    out = np.zeros(len(counts), int)
    for group in np.argsort(-counts.sum(axis=1), kind="stable"):
        row = counts[group]
        growth = (weight * row * (2 * (held - quota) + row)).sum(axis=1)
        out[group] = int(np.argmin(growth))
        held[out[group]] += row
    return out


def sender_stratified_split(
    df: DataFrame, group: str, strata: Sequence[str] = ("label", "source"), ratios=RATIOS, seed: int = 42, buckets: int = SENDER_BUCKETS
) -> DataFrame:
    """Adds ``split``: a sender, whatever its case, is never in two splits, and every stratum keeps the ratios as
    closely as whole senders allow.

    Rows are counted per sender bucket and stratum, partial sums first; that table, at most ``buckets`` rows per
    stratum, is all the driver sees, and the assignment goes back as one letter per bucket. Rows without a
    sender are senders of their own, by id.
    """
    name = F.coalesce(F.lower(F.col(group)), F.concat(F.lit("\0"), F.col("id").cast("string")))
    bucket = F.pmod(F.xxhash64(F.lit(seed), name), F.lit(buckets)).cast("int")
    keys = F.to_json(F.struct(*[F.col(c) for c in strata]))
    seen = df.groupBy(bucket.alias("bucket"), keys.alias("stratum")).agg(F.count("*").alias("n")).collect()
    column = {stratum: i for i, stratum in enumerate(sorted({r["stratum"] for r in seen}))}
    counts = np.zeros((buckets, max(1, len(column))))
    for r in seen:
        counts[r["bucket"], column[r["stratum"]]] = r["n"]
    shares = np.diff([0.0, *[upto for _, upto in ratios]])
    letters = "".join(chr(97 + i) for i in _assigned(counts, shares))
    split = F.element_at(F.array(*[F.lit(n) for n, _ in ratios]), F.ascii(F.substring(F.lit(letters), bucket + 1, F.lit(1))) - 96)
    return df.withColumn("split", split)


def leaked_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that occur in more than one split; must be empty."""
    sides = df.groupBy(group).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return sides.filter("lo <> hi").select(group)


def sample_to_ratio(df: DataFrame, label: str = "label", positive_share: float = 0.35, seed: int = 42) -> DataFrame:
    """Cuts the class that is too frequent, exactly, so positives hold the share asked for."""
    ratio = positive_share / (1 - positive_share)
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).select(
        F.struct(
            F.least(F.col("pos"), F.floor(F.col("neg") * ratio)).alias("pos"),
            F.least(F.col("neg"), F.floor(F.col("pos") / ratio)).alias("neg"),
        ).alias("keep")
    ).scalar()
    keep = F.when(F.col(label) == 1, counts.getField("pos")).otherwise(counts.getField("neg"))
    return global_row_number(df, [label], "id", seed).filter(F.col("rn") <= keep).drop("rn")


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", seed: int = 42) -> DataFrame:
    return global_row_number(df, [label], "id", seed).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")
