"""Toxicity by a convolutional text classifier trained in numpy.

Words (runs of ASCII letters and digits or other non-ASCII characters, A-Z lower-cased) get embeddings by hashing: the sum of
the vectors of the buckets of the word and of its character n-grams, so inflected forms are met too. Filters of several
widths slide over the whole text, each keeps its largest response, and a logistic layer turns these into a score.

All labelled training rows are written once, in shards by the hash of their id, and all are learnt from, in tasks. Buckets are
counted over the rows of all shards; those rare in them, both labels weighing alike, carry nothing. One task fits a start on a
few rows; from there every shard goes on over all its rows, and the mean of what the shards moved, weighed by their rows, is
added, in several rounds where rows are few. Every CALIBRATE-th id is left out of the fit instead, and all of these set a decision threshold for every language.

Null and empty texts are one unknown word; texts without words are never rejected. Rows are independent, so repeated rows score alike; missing or conflicting
labels: null labels are left out, and a document counts as toxic if any of its labels says so.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import fold, shared_folder, text_of, written

WIDTHS = (1, 2, 3)
FILTERS = 12
DIMENSIONS = 12
BUCKETS = 1 << 24
GRAMS = (4, 5, 6)
#: Labelled rows that the start is fitted on, half of them toxic, of at most so many characters; all others follow in the shards.
START_ROWS, START_CHARS = 1200, 200_000
#: Rows of a shard, about; rows and characters that a shard is fitted on at a time.
SHARD_ROWS, BLOCK_ROWS, BLOCK_CHARS = 8192, 1024, 8_000_000
#: Labelled ids sent to all tasks at most; more of them meet the texts in a shuffle.
SENT_IDS = 1 << 18
#: Rounds over all shards: the fewest, the most, and the rows that they pass together where those are few.
ROUNDS, ROUND_ROWS = (1, 6), 30_000
#: Every CALIBRATE-th labelled id, by hash, sets thresholds instead of weights.
CALIBRATE = 5
#: Steps of a unit in which moves of the weights are summed, as integers; steps of a unit of log odds in which scores are counted.
_FINE, _BINS = 1 << 28, 1024
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 50_000


#: What one byte does to a running crc32.
_CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
_BITS = 24  # of a bucket


def _hashed(words: list[bytes], places: list[int], known: np.ndarray | None) -> np.ndarray:
    """Place and bucket in one number, for the marked words and their n-grams; a byte of every n-gram is hashed in each step."""
    marked = [b"<%b>" % w for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8)
    starts = np.flatnonzero(data & 0xC0 != 0x80)  # of characters
    chars = np.array([len(m) if m.isascii() else len(m.decode("utf-8", "replace")) for m in marked])
    room = np.repeat(np.cumsum(chars), chars) - np.arange(len(starts))
    place = np.array(places, np.int64) << _BITS
    owner = np.repeat(place, chars)
    out = [place | np.array([zlib.crc32(m) % BUCKETS for m in marked], np.int64)]
    ends = np.concatenate([starts, np.full(max(GRAMS), len(data))])
    spans = {n: np.where(room >= n, ends[n:len(starts) + n] - starts, 0) for n in GRAMS}
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for step in range(1, max(span.max() for span in spans.values()) + 1):
        state = _CRC[(state ^ data[np.minimum(starts + (step - 1), len(data) - 1)]) & 255] ^ (state >> 8)
        for n, span in spans.items():
            if n <= step <= 4 * n:
                own = np.flatnonzero(span == step)
                bucket = ~state[own] % BUCKETS
                if known is not None:
                    own, bucket = own[known[bucket]], bucket[known[bucket]]
                out.append(owner[own] | bucket)
    return np.concatenate(out)


def word_buckets(words: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, hash bucket) of the words and their character n-grams, ends marked: distinct and in order; only buckets that `known` marks, if given. Words are UTF-8."""
    plain = [i for i, w in enumerate(words) if w.isascii()]
    other = [i for i, w in enumerate(words) if not w.isascii()]
    pairs = np.concatenate([np.zeros(0, np.int64), *[_hashed([words[i] for i in part], part, known) for part in (plain, other) if part]])
    if known is not None:
        pairs = pairs[known[pairs & BUCKETS - 1]]
    pairs = np.sort(pairs)
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    return pairs >> _BITS, pairs & BUCKETS - 1


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(values[order], starts, axis=0)


class ConvText:
    """The classifier: known buckets with embeddings, filters, output layer, thresholds by language."""

    def __init__(self, buckets: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets = np.sort(buckets)
        scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.weights = {"e": scale(len(buckets), DIMENSIONS), "v": scale(len(WIDTHS) * FILTERS), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.weights[f"w{w}"] = scale(w, DIMENSIONS, FILTERS)
            self.weights[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.thresholds: dict[str, float] = {}
        self.threshold = 0.5
        self._forget()

    def _forget(self):
        self._known = np.zeros(BUCKETS, bool)
        self._known[self.buckets] = True
        self._index: dict[bytes, int] = {}
        self._table = np.zeros((1, DIMENSIONS), np.float32)  # word 0 is the unknown one
        self._grams, self._ends = np.zeros(0, np.int64), np.zeros(1, np.int64)  # buckets of the words one after another, and where each word's end; kept for the fit

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_index", "_table", "_grams", "_ends")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def ids(self, texts: list[str], most: int = 400_000, keep: bool = False) -> list[np.ndarray]:
        """Places of the texts' words in the table of word vectors, which is made anew when it has grown large; `keep` remembers the words' buckets for the fit."""
        split = [text.encode("utf-8", "replace").translate(_WORDS).split() for text in texts]
        if len(self._index) > most:
            self._forget()
        index = self._index
        new = list(set().union(*split).difference(index))
        for begin in range(0, len(new), _PIECE):
            self._learn(new[begin:begin + _PIECE], keep)
        return [np.fromiter(map(index.__getitem__, words), np.int32, len(words)) if words else np.zeros(1, np.int32) for words in split]

    def _learn(self, words: list[bytes], keep: bool) -> None:
        """Vectors of words not met before; words without a known bucket are the unknown one."""
        self._index.update(dict.fromkeys(words, 0))
        owner, bucket = word_buckets(words, self._known)
        if not len(owner):
            return
        grams = np.searchsorted(self.buckets, bucket)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        self._index.update(zip([words[i] for i in owner[starts].tolist()], range(len(self._table), len(self._table) + len(starts))))
        self._table = np.concatenate([self._table, np.add.reduceat(self.weights["e"][grams], starts, axis=0)])
        if keep:
            self._ends = np.concatenate([self._ends, len(self._grams) + np.append(starts[1:], len(grams))])
            self._grams = np.concatenate([self._grams, grams])

    def _grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of known words one after another, and how many each has."""
        sizes = self._ends[words] - self._ends[words - 1]
        return self._grams[np.repeat(self._ends[words - 1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    def _refresh(self, words: np.ndarray) -> None:
        """Word vectors anew after a step of the fit."""
        words = words[words > 0]
        if len(words):
            grams, sizes = self._grams_of(words)
            self._table[words] = np.add.reduceat(self.weights["e"][grams], np.cumsum(sizes) - sizes, axis=0)

    def pooled(self, texts: list[np.ndarray], at: bool = False):
        """Largest response of each filter to each text, and where it was. Long texts go in overlapping pieces."""
        reach = max(WIDTHS) - 1
        out = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.zeros(out.shape, np.int64) if at else None
        group: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for row, ids in enumerate(texts):
            for begin in range(0, len(ids), _PIECE):
                piece = ids[begin:begin + _PIECE + reach]
                group.append((row, begin, piece))
                held += len(piece)
                if held >= _PIECE:
                    self._pool(group, out, where)
                    group, held = [], 0
        if group:
            self._pool(group, out, where)
        return (out, where) if at else out

    def _pool(self, group, out, where):
        reach = max(WIDTHS) - 1
        sizes = np.array([len(p) for _, _, p in group]) + reach
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.zeros(sizes.sum(), np.int32)
        pad = np.ones(len(flat), bool)
        for s, (_, _, p) in zip(starts, group):
            flat[s:s + len(p)] = p
            pad[s:s + len(p)] = False
        embedded = self._table[np.concatenate([flat, np.zeros(reach, np.int32)])]
        rows = np.array([r for r, _, _ in group])
        for k, width in enumerate(WIDTHS):
            filters = self.weights[f"w{width}"]
            response = embedded[:len(flat)] @ filters[0]
            for j in range(1, width):
                response += embedded[j:len(flat) + j] @ filters[j]
            response[pad] = -np.inf
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if where is None:
                np.maximum.at(out[:, cols], rows, np.maximum.reduceat(response, starts, axis=0))
                continue
            for g, (row, begin, _) in enumerate(group):
                part = response[starts[g]:starts[g] + sizes[g]]
                arg = part.argmax(axis=0)
                best = part[arg, np.arange(FILTERS)]
                better = best > out[row, cols]
                where[row, cols] = np.where(better, arg + begin, where[row, cols])
                out[row, cols] = np.where(better, best, out[row, cols])

    def _bias(self) -> np.ndarray:
        return np.concatenate([self.weights[f"b{w}"] for w in WIDTHS])

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        features = np.maximum(self.pooled(texts) + self._bias(), 0)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights["v"] + self.weights["c"], -30, 30).astype(np.float64)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 7,
            shares: tuple[float, float] | None = None, state: dict | None = None) -> None:
        """Adam on the log loss; only the windows that won a filter carry gradients. Vectors of words met before lag behind until `move`. `shares`: weights of the labels; `state`: of an earlier call that this one goes on from."""
        rng = np.random.default_rng(seed)
        state = {} if state is None else state
        if not state:
            state |= {"slow": {k: np.zeros_like(v) for k, v in self.weights.items()}, "square": {k: np.zeros_like(v) for k, v in self.weights.items()}, "step": 0}
        slow, square = state["slow"], state["square"]
        clean, toxic = shares or [len(labels) / max(1, 2 * (labels == y).sum()) for y in (0, 1)]
        weight = np.where(labels == 1, toxic, clean)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for begin in range(0, len(order), batch):
                own = order[begin:begin + batch]
                part = [texts[i] for i in own]
                self._refresh(np.unique(np.concatenate(part)))
                best, where = self.pooled(part, at=True)
                raw = best + self._bias()
                features = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-np.clip(features @ self.weights["v"] + self.weights["c"], -30, 30)))
                error = ((p - labels[own]) * weight[own] / len(own)).astype(np.float32)
                grad = {k: np.zeros_like(v) for k, v in self.weights.items() if k != "e"}
                grad["v"], grad["c"] = features.T @ error, error.sum(keepdims=True)
                back = error[:, None] * self.weights["v"] * (raw > 0)
                flat, sizes = np.concatenate(part), np.array([len(ids) for ids in part])
                starts = np.cumsum(sizes) - sizes
                won, moves = [], []
                for k, width in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    grad[f"b{width}"] = back[:, cols].sum(0)
                    for j in range(width):
                        at = where[:, cols] + j
                        inside = at < sizes[:, None]
                        tokens = np.where(inside, flat[starts[:, None] + np.minimum(at, sizes[:, None] - 1)], 0)
                        g = back[:, cols] * inside
                        grad[f"w{width}"][j] += np.einsum("rfd,rf->df", self._table[tokens], g)
                        won.append(tokens.ravel())
                        moves.append((self.weights[f"w{width}"][j].T * g[:, :, None]).reshape(-1, DIMENSIONS))
                state["step"] += 1
                for k in grad:
                    self._adam(k, slice(None), grad[k], slow, square, state["step"], rate)
                tokens, moved = _summed(np.concatenate(won), np.concatenate(moves))
                tokens, moved = tokens[tokens > 0], moved[tokens > 0]
                if len(tokens):  # only the buckets of winning words move
                    grams, sizes = self._grams_of(tokens)
                    self._adam("e", *_summed(grams, np.repeat(moved, sizes, axis=0)), slow, square, state["step"], rate)

    def flat(self) -> np.ndarray:
        """All weights one after another."""
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)]).astype(np.float64)

    def move(self, to: np.ndarray) -> None:
        """Takes weights as `flat` gives them."""
        at = 0
        for k in sorted(self.weights):
            size = self.weights[k].size
            self.weights[k] = to[at:at + size].astype(np.float32).reshape(self.weights[k].shape)
            at += size
        self._forget()

    def _adam(self, k, own, grad, slow, square, step, rate, decay=1e-3):
        slow[k][own] += 0.1 * (grad - slow[k][own])
        square[k][own] += 0.001 * (grad ** 2 - square[k][own])
        moved = rate * (slow[k][own] / (1 - 0.9 ** step)) / (np.sqrt(square[k][own] / (1 - 0.999 ** step)) + 1e-6)
        self.weights[k][own] -= moved
        if k[0] in "wve":
            self.weights[k][own] *= 1 - decay


def best_threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Halfway between two neighbouring groups of scores where F1 is largest (the middle one of equals); 0.5 without both labels. Groups: lowest and highest score, rows of each label."""
    if not toxic.sum() or not clean.sum():
        return 0.5
    order = np.argsort(-high, kind="stable")
    hits, misses = np.cumsum(toxic[order]), np.cumsum(clean[order])
    f1 = 2 * hits / (hits + misses + toxic.sum())
    cuts = (low[order] + np.append(high[order][1:], 0.0)) / 2
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(min(max(cuts[best[len(best) // 2]], 1e-6), 1 - 1e-6))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the documents whose labels may be learnt."""
    return labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, label, order, held, shard) of all labelled training documents; a shard is a partition by the hash of the id, `held` rows set thresholds."""
    truth = training_labels(labels)
    n = truth.count()
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.filter(F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", text_of().alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    shards = max(1, -(-n // SHARD_ROWS))
    if n <= SENT_IDS:
        rows = texts.join(F.broadcast(truth), "doc_id").repartition(shards, "doc_id")
    else:  # texts move once: fewer partitions than a shuffle's would be moved again by the join
        shards = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = texts.repartition(shards, "doc_id").join(truth.repartition(shards, "doc_id").hint("merge"), "doc_id")
    order = F.xxhash64("doc_id")
    return rows.select("doc_id", "text", "lang", F.col("label").cast("int").alias("label"), order.alias("order"), (F.pmod(order, F.lit(CALIBRATE)) == 0).alias("held"),
                       F.spark_partition_id().alias("shard")).sortWithinPartitions("order", "doc_id", "text")


class Counts:
    """How often whole numbers (below 2 ** 31) were met: `most` or so wait, then they join the sorted ones. Memory follows the distinct numbers, not their range."""

    def __init__(self, most: int = 1 << 22):
        self.most, self.keys, self.counts = most, np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys.astype(np.int32))
        self.held += len(keys)
        if self.held >= self.most:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """All numbers met so far, in order, and their counts."""
        if self.held:
            keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.waiting, self.held = [], 0
            at = np.searchsorted(self.keys, keys)
            old = np.append(self.keys, np.int32(-1))[at] == keys
            self.counts[at[old]] += counts[old]
            self.keys, self.counts = np.insert(self.keys, at[~old], keys[~old]), np.insert(self.counts, at[~old], counts[~old])
        return self.keys, self.counts


class WordBuckets:
    """Buckets of words and their n-grams, one word after another in one array; all are forgotten when there are more than `most`."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.buckets, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: set[bytes], at_once: int = 10_000) -> None:
        if len(self.index) > self.most:
            self._forget()
        new = list(words.difference(self.index))
        for begin in range(0, len(new), at_once):
            own = new[begin:begin + at_once]
            place, bucket = word_buckets(own)
            self.index.update(zip(own, range(len(self.ends) - 1, len(self.ends) - 1 + len(own))))
            self.ends = np.concatenate([self.ends, len(self.buckets) + np.cumsum(np.bincount(place, minlength=len(own)))])
            self.buckets = np.concatenate([self.buckets, bucket.astype(np.int32)])

    def of(self, words: set[bytes]) -> np.ndarray:
        """Buckets of words learnt, one word after another."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.ends[at + 1] - self.ends[at]
        return self.buckets[np.repeat(self.ends[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def frequent_buckets(rows: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """Buckets of three of the (text, label) rows at least and of a 200th of them, both labels weighing alike; no more than 200 times the buckets of a row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = Counts(), WordBuckets()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                split = [set(text.encode("utf-8", "replace").translate(_WORDS).split()) for text in part.column(0).to_pylist()]
                known.learn(set().union(*split))
                for words, label in zip(split, part.column(1).to_pylist()):
                    if words:
                        met = np.sort(known.of(words))
                        held.add(met[np.diff(met, prepend=-1) > 0] * 2 + (label == 1))  # each bucket once a row
        keys, counts = held.merged()
        buckets, toxic = keys >> 1, np.where(keys & 1, counts, 0)
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        sums = [np.add.reduceat(c, starts) if len(starts) else c for c in (counts - toxic, toxic)]
        for at in range(0, len(starts), 1 << 18):
            own = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(buckets[starts[own]], pa.int32()), *[pa.array(c[own], pa.int64()) for c in sums]], ["k", "clean", "toxic"])

    seen = rows.select("text", "label").mapInArrow(counted, "k int, clean long, toxic long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    often = (F.col("clean") + F.col("toxic") >= 3) & (F.col("clean") / clean + F.col("toxic") / toxic >= 2 / 200)
    return np.sort(seen.filter(often).select("k").toArrow()["k"].to_numpy()).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(shard, texts, labels) of (text, label, shard) rows, a bounded number of them at a time."""
    at, texts, labels, chars = None, [], [], 0
    for batch in batches:
        for text, label, shard in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if texts and (shard != at or len(texts) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                yield at, texts, np.array(labels)
                texts, labels, chars = [], [], 0
            at = shard
            texts.append(text)
            labels.append(label)
            chars += len(text)
    if texts:
        yield at, texts, np.array(labels)


def started(model: ConvText, rows: DataFrame) -> np.ndarray:
    """Weights after a fit, in one task, on a few rows: half of each label, lowest hash first."""
    short = rows.filter(F.length("text") <= START_CHARS)
    ids = [short.filter(F.col("label") == y).select("order", "doc_id").distinct().orderBy("order", "doc_id").limit(START_ROWS // 2) for y in (0, 1)]
    few = short.join(F.broadcast(ids[0].unionByName(ids[1]).select("doc_id")), "doc_id")  # at most START_ROWS ids

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            batch = batch.slice(0, 2 * START_ROWS - len(texts))  # repeated ids
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if texts:
            model.fit(model.ids(texts, keep=True), np.array(labels), epochs=max(6, min(40, 8_000 // len(texts))))
        yield pa.RecordBatch.from_arrays([pa.array(model.flat())], ["v"])

    one = few.select("text", "label", "order").repartition(1).sortWithinPartitions("order", "text")
    return one.select("text", "label").mapInArrow(fitted, "v double").toArrow()["v"].to_numpy()


def gone_on(model: ConvText, rows: DataFrame, clean: int, toxic: int, rate: float) -> np.ndarray:
    """Weights after every shard went on from the model's over all its rows: the mean of their moves, weighed by rows. Moves are summed as integers, so reruns agree."""
    shares = ((clean + toxic) / (2 * clean), (clean + toxic) / (2 * toxic))
    start = model.flat()

    def moved(own: ConvText, n: int) -> pa.RecordBatch:
        by = np.rint((own.flat() - start) * _FINE).astype(np.int64) * n
        at = np.flatnonzero(by)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(by[at])], ["k", "v"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, n, state = None, None, 0, {}
        for shard, texts, labels in _blocks(batches):
            if own is None or shard != at:
                if own is not None:
                    yield moved(own, n)
                own, at, n, state = copy.deepcopy(model), shard, 0, {}
            own.fit(own.ids(texts, most=100_000, keep=True), labels, epochs=1, batch=64, rate=rate, shares=shares, state=state)
            n += len(labels)
        if own is not None:
            yield moved(own, n)

    sums = rows.select("text", "label", "shard").mapInArrow(fitted, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # a row a weight
    out = start.copy()
    out[sums["k"].to_numpy()] += sums["v"].to_numpy() / _FINE / (clean + toxic)
    return out


def calibrated(model: ConvText, held: DataFrame, least: int = 40) -> tuple[float, dict[str, float]]:
    """Thresholds with the best F1 on all held rows, over all and by language; languages with few rows, or without both labels, take the common one.

    Rows are counted by score, in fine steps of the log odds, so as many counts are held as there are steps, however many rows.
    """
    score = F.col("score")
    scored = held.select("lang", "label", score_column(model, F.col("text")).alias("score"))
    step = F.floor(F.log(score / (1 - score)) * _BINS).cast("int").alias("step")
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    counts = scored.groupBy("lang", step).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum((F.col("label") == 1).cast("long")).alias("toxic"), F.sum((F.col("label") != 1).cast("long")).alias("clean"))
    counts = written(counts, shared_folder(held.sparkSession), "steps")

    def best(part: pd.DataFrame) -> float:
        return best_threshold(*[part[c].to_numpy() for c in ("low", "high", "toxic", "clean")])

    def of_language(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": part["lang"][:1], "threshold": [best(part)]})

    usable = counts.groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(f"toxic > 0 and clean > 0 and toxic + clean >= {least}").select("lang")
    by_language = counts.join(usable, "lang").groupBy("lang").applyInPandas(of_language, "lang string, threshold double").collect()  # a row a language
    return best(counts.groupBy("step").agg(*ends).toPandas()), {r.lang: r.threshold for r in sorted(by_language)}


def train(docs: DataFrame, labels: DataFrame) -> ConvText:
    """Fits the classifier on all labelled training rows. Without both labels every score is the same and below the threshold."""
    rows = written(labelled_rows(docs, labels), shared_folder(docs.sparkSession), "labelled")
    fitted = rows.filter("not held")
    counts = dict(fitted.groupBy("label").count().collect())
    clean, toxic = sum(n for y, n in counts.items() if y != 1), counts.get(1, 0)
    if not clean or not toxic:
        model = ConvText(np.zeros(0, np.int64))
        model.weights["v"][:] = 0
        model.threshold = math.inf  # nothing was learnt, so nothing is flagged
        return model
    model = ConvText(frequent_buckets(fitted, clean, toxic))
    model.move(started(model, fitted))
    rounds = max(ROUNDS[0], min(ROUNDS[1], ROUND_ROWS // (clean + toxic)))
    for number in range(rounds):
        model.move(gone_on(model, fitted, clean, toxic, rate=0.02 / (1 + number)))
    model.threshold, model.thresholds = calibrated(model, rows.filter("held"))
    return model


def score_column(model: ConvText, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [model.score(model.ids(texts[at:at + 200].tolist())) for at in range(0, len(texts), 200)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    return scores(text)


def threshold_column(model: ConvText, lang: Column) -> Column:
    out = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def score_documents(docs: DataFrame, model: ConvText) -> DataFrame:
    """Id, held_out, score, predicted (score of 0.5 or more), flagged (score at or above the language's threshold)."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select("doc_id", lang.alias("lang"), score_column(model, text_of()).alias("score"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                         (F.col("score") >= threshold_column(model, F.col("lang"))).alias("flagged"))


def reject_toxic(docs: DataFrame, model: ConvText) -> DataFrame:
    """The documents without words and those whose score is below the threshold of their language, with their own columns."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    wordless = ~text_of().rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
    return docs.filter(wordless | (score_column(model, text_of()) < threshold_column(model, lang)))
