"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of queries and blocks of candidates.

A dimension is a term. A block of candidates is turned into postings (candidate, weight) by term; every sparse query row
scatters weight times posting into a dense score array of the block, term by term, and partition selection keeps the k
best of the block; the blocks' winners are merged by rank. Both block sizes are bounded, so any number of queries and
candidates spreads over tasks, and no task holds more than one block of each.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as zero beyond their
end, empty ones score 0. Ties go to the smaller id. Rows of one id are separate candidates and none of them is a
candidate for a query of that id; equal query rows are one query. Scores wrap at 64 bits. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as double; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id; equal to sorting all, in linear time."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
        if len(places) > 4 * k:  # many ties at the cut
            above, at = places[scores[places] > cut], places[scores[places] == cut]
            places = np.concatenate([above, at[np.argpartition(ids[at], min(k, len(at) - 1))[:k]]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block of candidates for every query row of one block."""
    columns = ["query_id", "query_row", "vec_id", "score"]
    if not len(queries) or not len(candidates):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    width = max(1, max(map(len, queries["vector"])), max(map(len, candidates["vector"])))
    ids = candidates["vec_id"].to_numpy(np.int64)
    weights, asked = _matrix(candidates["vector"], width), _matrix(queries["vector"], width)
    largest = lambda m: int(max(abs(int(m.min())), abs(int(m.max()))))
    kind = np.int32 if largest(weights) * largest(asked) * width < 1 << 31 else np.int64
    postings = []
    for term in range(width):
        held = np.flatnonzero(weights[:, term])
        full = len(held) * 2 > len(ids)  # a long list is kept as a whole column, and is then added without look-ups
        postings.append((None, weights[:, term].astype(kind)) if full else (held, weights[held, term].astype(kind)))
    scores, part = np.empty(len(ids), kind), np.empty(len(ids), kind)
    out = []
    for query_id, row, vector in zip(queries["vec_id"].to_numpy(), queries["query_row"].to_numpy(), asked):
        scores[:] = 0
        for term in np.flatnonzero(vector):
            held, posting = postings[term]
            if held is None:
                np.multiply(posting, kind(vector[term]), out=part)
                np.add(scores, part, out=scores)
            else:
                scores[held] += posting * kind(vector[term])
        others = ids != query_id
        own, own_ids = (scores, ids) if others.all() else (scores[others], ids[others])
        for place in _best(own, own_ids, k):
            out.append((query_id, row, own_ids[place], int(own[place])))
    return pd.DataFrame(out, columns=columns).astype("int64")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 2048, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query row, exactly."""
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    asked = usable(queries).distinct().withColumn("query_row", F.xxhash64("vec_id", "vector"))
    held = usable(candidates)
    query_blocks, blocks = max(1, -(-queries.count() // query_rows)), max(1, -(-candidates.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.col("query_row"), F.lit(query_blocks)).cast("int")).withColumn("cb", every(blocks))
    right = held.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("qb", every(query_blocks))

    def found(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, k)

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(found, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
