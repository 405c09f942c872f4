"""Hard negatives by rotated one-bit codes with deterministic intervals.

Every integer vector v is rotated by one random orthogonal matrix. Its code holds the signs of the rotated entries, a unit
vector b once divided by the root of the width; stored beside it is the alignment <v, b>. What the code leaves is coded
again the same way, `levels` times, and the norm of the last remainder is stored: v = sum of alignment * b + remainder.
An anchor q is cut into 8 bit planes, so that popcounts of planes and codes give <q, b> up to a known error, and

    <q, v> lies within  sum of alignment * <q, b>  +-  (errors of the planes + |q without its share along the last code| * |remainder|)

by Cauchy and Schwarz, as the remainder is at a right angle to the last code. The interval is certain, not probable: no
row outside it can have the score. Rows whose interval misses the range still open are left; all others are scored in
integers. So results are exact whatever the codes, which only decide how much work is left.

Anchors and rows meet in blocks of bounded size, by hashes of their ids: a label or a vector that most rows share is
spread over all blocks. First every block returns its best k positives of each anchor, merged by rank; then, with the
positives known, its best k negatives of each window. Every block pair is one task that anyone can repeat.

Rows with a missing id or label, a null vector or a null or non-finite component take no part. Rows of an anchor's own id
are never its partners. Equal anchor rows are one anchor; equal partner rows are partners of their own. Vectors count as
zero beyond their end. A positive score of 0 admits negatives of score 0, one below 0 none. Entries beyond 2^24 count as
2^24, so that scores of up to 256 dimensions, times 100, fit a long. Empty tables give no rows; extra columns are left
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import written

PLANES = 8
LIMIT = float(1 << 24)


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as double; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long")))


def rotation(width: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix. Intervals hold for any; a fixed one makes codes repeatable."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(r.diagonal())


def padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words; their number is a multiple of 64."""
    return np.packbits(bits, axis=1).view(np.uint64)


def code(vectors: np.ndarray, turn: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x levels x words), alignments (rows x levels) and norms of the last remainder."""
    rest, root = vectors.astype(np.float64) @ turn.T, np.sqrt(len(turn))
    words, along = [], []
    for _ in range(levels):
        bits = rest >= 0
        words.append(packed(bits))
        along.append(np.abs(rest).sum(axis=1) / root)
        rest = rest - along[-1][:, None] * np.where(bits, 1 / root, -1 / root)
    return np.stack(words, axis=1), np.stack(along, axis=1), np.linalg.norm(rest, axis=1)


class Anchor:
    """An anchor's bit planes, and its intervals with coded rows."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray):
        q = turn @ vector.astype(np.float64)
        self.root, self.norm, self.low = np.sqrt(len(q)), float(np.linalg.norm(q)), float(q.min())
        self.step = (float(q.max()) - self.low) / ((1 << PLANES) - 1) or 1.0
        level = np.rint((q - self.low) / self.step).astype(np.uint8)
        self.total = int(level.sum())
        self.planes = np.stack([packed(((level >> p) & 1).astype(bool)[None])[0] for p in range(PLANES)])
        self.off = float(np.linalg.norm(q - (self.low + self.step * level)))

    def along(self, codes: np.ndarray) -> np.ndarray:
        """<q, b> of codes (rows x words), off by at most `off`."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        held = sum(np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << p for p, plane in enumerate(self.planes))
        width = codes.shape[1] * 64
        return (self.low * (2 * ones - width) + self.step * (2 * held - self.total)) / self.root

    def intervals(self, codes: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of <q, v> that hold for certain, a little wider than rounding needs."""
        middle = np.zeros(len(rest))
        for level in range(codes.shape[1]):
            share = self.along(codes[:, level])
            middle += along[:, level] * share
        across = np.sqrt(np.maximum(self.norm ** 2 - np.maximum(np.abs(share) - self.off, 0) ** 2, 0))
        wide = self.off * along.sum(axis=1) + across * rest
        wide += 1e-9 * (self.norm * (along.sum(axis=1) + rest) + 1) + 1e-6
        return middle - wide, middle + wide


class Block:
    """The rows of a block: ids, labels, whole vectors, codes."""

    def __init__(self, rows: pd.DataFrame, width: int, levels: int):
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.vectors = padded(rows["vector"], width)
        self.codes = np.stack(rows["code"].to_list()).view(np.uint64).reshape(len(rows), levels, -1)
        self.along, self.rest = np.stack(rows["along"].to_list()), rows["rest"].to_numpy(np.float64)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64) if self.largest < 2.0 ** 53 else None
        self.scored = 0

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products."""
        self.scored += len(places)
        if self.floats is not None and self.largest * float(np.abs(anchor).max(initial=0)) * len(anchor) < 2.0 ** 53:
            return (self.floats[places] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[places] @ anchor


def ranked(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    return np.lexsort((ids[places], -scores))[:k]


def largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-values, k - 1)[:k] if len(values) > k else np.arange(len(values))


def best_positives(block: Block, anchor_id: int, label: int, vector: np.ndarray, bits: Anchor, k: int) -> Iterator[tuple[int, int]]:
    """(id, score) of the k best rows of the anchor's label in the block."""
    places = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
    if len(places) > k:
        low, high = bits.intervals(block.codes[places], block.along[places], block.rest[places])
        sure = block.scores(places[largest(low + high, k)], vector).min()  # k rows reach this
        places = places[high >= sure]
    scores = block.scores(places, vector)
    for at in ranked(places, scores, block.ids, k):
        yield int(block.ids[places[at]]), int(scores[at])


def best_negatives(block: Block, anchor_id: int, label: int, vector: np.ndarray, bits: Anchor, limits: list[int], k: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(limit, id, score) of the k best rows of other labels in the block, for each limit with percent/100 * limit <= score <= limit."""
    limits = [p for p in limits if p >= 0]
    places = np.flatnonzero((block.labels != label) & (block.ids != anchor_id))
    if not limits or not len(places):
        return
    low, high = bits.intervals(block.codes[places], block.along[places], block.rest[places])
    near = (high >= percent * min(limits) / 100 - 1) & (low <= max(limits))
    places, low, high = places[near], low[near], high[near]
    seeds = largest(low + high, 8 * k)
    tried = block.scores(places[seeds], vector)
    open_rows = np.zeros(len(places), bool)
    for limit in limits:
        inside = np.sort(tried[(tried <= limit) & (100 * tried >= percent * limit)])
        least = float(inside[-k]) if len(inside) >= k else percent * limit / 100 - 1
        open_rows |= (high >= least) & (low <= limit)
    places = places[open_rows]
    scores = block.scores(places, vector)
    for limit in limits:
        fits = np.flatnonzero((scores <= limit) & (100 * scores >= percent * limit))
        for at in ranked(places[fits], scores[fits], block.ids, k):
            yield limit, int(block.ids[places[fits[at]]]), int(scores[fits[at]])


def coded(vectors: DataFrame, width: int, levels: int, seed: int) -> DataFrame:
    """vec_id, label, vector with its codes (bytes), alignments and remainder."""
    turn = rotation(width, seed)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, along, rest = code(padded(batch.column("vector").to_numpy(zero_copy_only=False), width), turn, levels)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("vec_id", "label", "vector")), pa.array(list(words.reshape(len(words), -1).view(np.int64)), pa.list_(pa.int64())),
                pa.array(list(along), pa.list_(pa.float64())), pa.array(rest, pa.float64()),
            ], ["vec_id", "label", "vector", "code", "along", "rest"])

    return vectors.mapInArrow(task, "vec_id long, label long, vector array<long>, code array<long>, along array<double>, rest double")


def hard_negatives(
    vectors: DataFrame, anchors: Column, folder: str, positives: int = 5, negatives: int = 5, percent: int = 80, label: Column | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", levels: int = 3, seed: int = 42, anchor_rows: int = 2048, block_rows: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank of rows that `anchors` (over vec_id) selects.

    `label` replaces the label column, over the columns vec_id and label. Work tables go to `folder`.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole(F.col(vector_col)).alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    longest, count, asked = rows.select(F.max(F.size("vector")), F.count("*"), F.count_if(anchors)).first()
    width = 64 * max(1, -(-(longest or 0) // 64))
    table = written(coded(rows, width, levels, seed), folder, "codes")
    asked_blocks, blocks = max(1, -(-asked // anchor_rows)), max(1, -(-count // block_rows))
    turn = rotation(width, seed)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = table.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("ab", every(asked_blocks))
    chosen = table.filter(anchors).select("vec_id", "label", "vector").distinct().withColumn("anchor_row", F.xxhash64("vec_id", "label", "vector"))
    chosen = written(chosen, folder, "anchors")

    def meet(left: DataFrame, search, shape: str) -> DataFrame:
        left = left.withColumn("ab", F.pmod(F.col("anchor_row"), F.lit(asked_blocks)).cast("int")).withColumn("cb", every(blocks))
        return left.groupBy("ab", "cb").cogroup(held.groupBy("ab", "cb")).applyInPandas(search, shape)

    def anchors_of(a: pd.DataFrame) -> Iterator[tuple]:
        for row, vector in zip(a.itertuples(index=False), padded(a["vector"], width)):
            yield row, vector, Anchor(vector, turn)

    def find_positives(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        block = Block(b, width, levels) if len(a) and len(b) else None
        out = [
            (row.vec_id, row.anchor_row, found, score)
            for row, vector, bits in (anchors_of(a) if block else ()) for found, score in best_positives(block, row.vec_id, row.label, vector, bits, positives)
        ]
        return pd.DataFrame(out, columns=["vec_id", "anchor_row", "positive_id", "positive_score"]).astype("int64")

    best = Window.partitionBy("vec_id", "anchor_row").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(chosen, find_positives, "vec_id long, anchor_row long, positive_id long, positive_score long")
    near = near.withColumn("positive_rank", F.row_number().over(best)).filter(F.col("positive_rank") <= positives)
    near = written(near, folder, "positives")
    limits = near.groupBy("vec_id", "anchor_row").agg(F.collect_set("positive_score").alias("limits"))

    def find_negatives(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        block = Block(b, width, levels) if len(a) and len(b) else None
        out = [
            (row.vec_id, row.anchor_row, limit, found, score)
            for row, vector, bits in (anchors_of(a) if block else ())
            for limit, found, score in best_negatives(block, row.vec_id, row.label, vector, bits, [int(x) for x in row.limits], negatives, percent)
        ]
        return pd.DataFrame(out, columns=["vec_id", "anchor_row", "positive_score", "negative_id", "negative_score"]).astype("int64")

    hard = meet(chosen.join(limits, ["vec_id", "anchor_row"]), find_negatives, "vec_id long, anchor_row long, positive_score long, negative_id long, negative_score long")
    hardest = Window.partitionBy("vec_id", "anchor_row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
    return hard.join(near, ["vec_id", "anchor_row", "positive_score"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"
    )
