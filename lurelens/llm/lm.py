"""Language-model scores by causal self-attention over subword ids, trained in numpy.

A text is lower-cased (A-Z), cut into words at ASCII white space, and each word into subword ids of a public vocabulary; an
end id closes it. Windows of ids overlap by half so that every id but a text's first few has half a window before it or more; each id
is scored once, all windows of a batch in one masked attention. The model gives a class of ids from the context, and the id from
the class and the class before by counts: frequent ids are their own class, the others are clustered by what stands before them.
All training documents are encoded once into the shared folder, and all these counts are summed over all of them in Spark. The
attention weights start from a fit on the driver, on FIT_WINDOWS windows or so drawn evenly from all documents. From there every
task goes on over all ids of its documents, each id the goal of one window, and the mean of what the tasks moved, weighed by
their windows, is added. Only the documents kept back for the mix are left out.

The base is a unigram over words with counts from all training documents: counts are gathered by hash, the most frequent
words (a fixed number) are sent to all tasks, and the rest of the words meet their counts in a join. The score of a word mixes
the product of its ids' probabilities, its share in the counts and its share in the words before it in the text; the three weights
are set by expectation-maximisation, in Spark, on all words of all documents kept back, a KEPT-th by the hash of their ids, with
their own words and ids taken out of the counts. A word without a count has no share in the counts.

Null and empty texts are the end alone. Rows are independent, repeated rows score alike; missing ids hash as empty text.
"""

from __future__ import annotations

import base64
import copy
import functools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lurelens.llm.common import Remembered, by_size, fold, shared_folder, small_batches, spaced_ids, text_of, written

DIMENSIONS, WINDOW, OVERLAP, CLASSES, OWN_CLASS, OWN_INPUT = 16, 24, 12, 80, 48, 4096
#: Words sent to all tasks.
TOP_WORDS = 1 << 16
#: Windows of the start, about; windows of a step.
FIT_WINDOWS, BATCH = 57_600, 96
#: A KEPT-th of the training documents sets the three weights of the mix instead of the attention; `train` hands out at most so many of their texts.
KEPT, KEPT_DOCS = 12, 100
#: Bytes of text that are cut into words at once.
RUN_BYTES = 4 << 20
#: Steps of a unit in which moves of the weights are summed, as integers.
_FINE = 1 << 28
#: Numbers whose exp may be summed in single precision as they are.
_FAR = 40.0
_SEED = 11


class Subwords:
    """Ids of words, by the tiktoken library; the end id follows the last rank."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.path, self.pattern = path, pattern
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.end = max(ranks.values()) + 1
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        alone = regex.compile(pattern).findall(" a\n\n b") == [" a", "\n\n", " b"]
        self.mark = self.encode("\n\n") if alone else []

    def of(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode("utf-8", "replace"))

    def lists(self, words: list[str]) -> pa.ListArray:
        """Ids of many words, END_WORD among them."""
        return spaced_ids(words, self.mark, lambda texts: [[self.end] if t == f" {END_WORD.decode()}" else self.encode(t) for t in texts])


@functools.cache
def subwords_of(path: str, pattern: str) -> Subwords:
    """Held once by a process."""
    return Subwords(path, pattern)


class Listed:
    """Counts over sequences of ids at hand, each with an end in front; the end is the last id of the vocabulary."""

    def __init__(self, sequences: list[np.ndarray], end: int):
        self.flats = [np.append(end, s).astype(np.int64) for s in sequences]

    def summed(self, keys: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for flat in self.flats:
            _count(out, keys(flat))
        return out


def _count(held: np.ndarray, keys: np.ndarray) -> None:
    """One more for each key; ones of the array's own type, as numpy is many times slower when it has to convert them."""
    np.add.at(held, keys, np.ones(len(keys), held.dtype))


class Gathered:
    """Counts over a table of encoded documents, each closed by the end: summed in every task, then by key in Spark."""

    def __init__(self, ids: DataFrame, end: int):
        self.ids, self.end = ids, end

    def summed(self, keys: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        end = self.end

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(size, np.int32)
            for batch in batches:
                for flat in _flats(batch, end):
                    _count(held, keys(flat))
            found = np.flatnonzero(held)
            for at in range(0, len(found), 1 << 19):
                own = found[at:at + (1 << 19)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(held[own], pa.int64())], ["k", "c"])

        out = np.zeros(size, np.int64)
        table = self.ids.mapInArrow(counted, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # at most `size` keys
        out[table["k"].to_numpy()] = table["c"].to_numpy()
        return out


def _flats(batch: pa.RecordBatch, end: int, rows: int = 500) -> Iterator[np.ndarray]:
    """Ids of some documents one after another, an end in front."""
    for at in range(0, batch.num_rows, rows):
        yield np.append(end, batch.column(0).slice(at, rows).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)


class _Room:
    """Arrays by name that are used again: making large ones anew for each step costs more than what is done with them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


class AttentionModel:
    """One causal attention layer between embedded ids and classes of the next id."""

    def __init__(self, vocabulary: int, source: Gathered | list[np.ndarray], kept: Gathered | list[np.ndarray] | None = None, seed: int = _SEED):
        """`kept`: sequences of the source whose ids are taken out of the counts in `aside`."""
        if isinstance(source, list):
            source = Listed(source, vocabulary - 1)
        rng = np.random.default_rng(seed)
        counts = source.summed(lambda flat: flat[1:], vocabulary)
        self.n_ids = int(counts.sum())
        order = np.argsort(-counts, kind="stable")
        self.input = np.full(vocabulary, 0, np.int64)
        self.input[order[:OWN_INPUT]] = np.arange(min(OWN_INPUT, vocabulary))
        self.cls = np.zeros(vocabulary, np.int64)
        own = min(OWN_CLASS, vocabulary)
        self.cls[order[:own]] = np.arange(own)
        rest = order[own:]
        groups = CLASSES - own
        self.cls[rest] = own + (self._clusters(source, order, rest, groups - 1, counts, rng) if groups > 1 else 0)
        self.input[order[OWN_INPUT:]] = OWN_INPUT + self.cls[order[OWN_INPUT:]]
        total = np.bincount(self.cls, counts + 1.0, CLASSES)
        cls = self.cls
        pairs = lambda flat: cls[flat[:-1]] * vocabulary + flat[1:]
        seen = source.summed(pairs, CLASSES * vocabulary)
        self.inside = self.aside = self._inside(seen, counts)
        if kept:
            own = Listed(kept, vocabulary - 1) if isinstance(kept, list) else kept
            taken = own.summed(pairs, len(seen))
            self.aside = self._inside(np.maximum(seen - taken, 0), np.maximum(counts - taken.reshape(CLASSES, -1).sum(axis=0), 0))
        scale = lambda *s: rng.normal(0, 1 / math.sqrt(DIMENSIONS), s).astype(np.float32)
        self.w = {"e": scale(OWN_INPUT + CLASSES, DIMENSIONS), "p": 0.1 * scale(WINDOW, DIMENSIONS), "q": scale(DIMENSIONS, DIMENSIONS), "k": scale(DIMENSIONS, DIMENSIONS),
                  "v": scale(DIMENSIONS, DIMENSIONS), "o": scale(DIMENSIONS, DIMENSIONS), "c": scale(DIMENSIONS, CLASSES), "b": np.log((total + 1e-3) / total.sum()).astype(np.float32)}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def __getstate__(self):
        return self.__dict__ | {"aside": None}

    def _inside(self, seen: np.ndarray, counts: np.ndarray, pull: float = 20.0) -> np.ndarray:
        """log10 probability of an id in its class after an id of each class: counts, drawn towards the share that the id has in its class anyway."""
        alone = (counts + 1.0) / np.bincount(self.cls, counts + 1.0, CLASSES)[self.cls]
        out = np.zeros((CLASSES, len(alone)), np.float32)
        for c, own in enumerate(seen.reshape(CLASSES, -1)):
            held = np.bincount(self.cls, own, CLASSES)
            out[c] = np.log10((own + pull * alone) / (held + pull)[self.cls])
        return out

    @staticmethod
    def _clusters(source, order, rest, groups, counts, rng) -> np.ndarray:
        """Clusters of the seen ids by the frequent ids right before them and two before them; unseen ids are the last cluster."""
        columns = np.full(len(counts), 255, np.int64)
        columns[order[:255]] = np.arange(min(255, len(order)))
        seen = rest[counts[rest] > 0]
        row = np.full(len(counts), -1, np.int64)
        row[seen] = np.arange(len(seen))
        end = len(counts) - 1

        def before(flat: np.ndarray) -> np.ndarray:
            keys = []
            for back in (1, 2):
                at, ids = flat[:-back], flat[back:]
                own = row[ids] >= 0
                if back == 2:
                    own &= flat[1:-1] != end  # not beyond the text's begin
                keys.append(row[ids[own]] * 512 + columns[at[own]] + 256 * (back - 1))
            return np.concatenate(keys)

        out = np.full(len(rest), groups, np.int64)
        if len(seen) <= groups:
            out[counts[rest] > 0] = np.arange(len(seen))
            return out
        table = source.summed(before, len(seen) * 512).astype(np.float32).reshape(len(seen), 512)
        table /= np.maximum(table.sum(1, keepdims=True), 1)
        np.sqrt(table, out=table)
        weight = np.sqrt(counts[seen]).astype(np.float32)[:, None]
        gram = sum((b * w).T @ b for b, w in ((table[i:i + 4096], weight[i:i + 4096]) for i in range(0, len(table), 4096)))
        _, vectors = np.linalg.eigh(gram)
        points = table @ vectors[:, -DIMENSIONS:]
        centres = points[np.argsort(-counts[seen], kind="stable")[:groups]] + rng.normal(0, 1e-3, (groups, points.shape[1]))
        for _ in range(15):
            near = np.argmin(-2 * points @ centres.T + (centres ** 2).sum(1), axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points * weight)
            mass = np.bincount(near, weight[:, 0], groups)
            centres[mass > 0] = sums[mass > 0] / mass[mass > 0, None]
        out[counts[rest] > 0] = near
        return out

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every input and of every place in a window: what is embedded and asked, and what is met and handed on, so that a place is the sum of two rows. The weights of the output are taken in."""
        w = self.w
        sides = [(lambda y: [y, y @ w["q"] / math.sqrt(DIMENSIONS)]), (lambda y: [y @ w["k"], y @ w["v"] @ w["o"]])]
        return [tuple(np.ascontiguousarray(np.hstack(side(w[n])), np.float32) for n in "ep") for side in sides]

    def _attended(self, tables: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, first: int, room: _Room) -> np.ndarray:
        """What stands at the places from `first` of each window on after the attention."""
        d, (n, size) = DIMENSIONS, ids.shape
        asking, met = room("asking", n, size - first, 2 * d), room("met", n, size, 2 * d)
        for (by_id, by_place), at, out in zip(tables, (first, 0), (asking, met)):
            np.take(by_id, ids[:, at:], axis=0, out=out, mode="clip")
            out += by_place[at:]
        a, total = _softly(asking[:, :, d:], met[:, :, :d], self.mask[first:], room)
        h = np.matmul(a, met[:, :, d:], out=room("h", n, size - first, d))
        h /= total
        h += asking[:, :, :d]
        return h

    def fit(self, sequences: list[np.ndarray], end: int, steps: int = 600, batch: int = BATCH, seed: int = _SEED) -> None:
        """Fits over windows drawn from the sequences."""
        rng = np.random.default_rng(seed)
        flat = np.concatenate([np.append(s, end) for s in sequences] + [np.full(WINDOW + 1, end)])
        if len(flat) < 2 * WINDOW + 2:
            return
        self.fit_windows((flat[rng.integers(0, len(flat) - WINDOW - 1, batch)[:, None] + np.arange(WINDOW + 1)] for _ in range(steps)), steps)

    def fit_windows(self, batches: Iterator[np.ndarray], steps: float, rate: float = 0.01) -> None:
        """Adam on the log loss of the class, one step for each batch of windows."""
        d, names = DIMENSIONS, list(self.w)
        ends = np.cumsum([0, *(self.w[n].size for n in names)])
        every, grad, slow, square, up, down = (np.zeros(ends[-1], np.float32) for _ in range(6))
        views = lambda y: {n: y[a:b].reshape(self.w[n].shape) for n, a, b in zip(names, ends[:-1], ends[1:])}
        w, g = views(every), views(grad)
        for n in names:
            w[n][...] = self.w[n]
        self.w = w
        rows, lanes, room = lambda y: y.reshape(-1, y.shape[2]), np.arange(d), _Room()
        half = np.float32(1 / math.sqrt(d))
        for step, window in enumerate(batches, 1):
            ids, goal = self.input[window[:, :-1]], self.cls[window[:, 1:]].ravel()
            (n, size), places = ids.shape, np.arange(goal.size)
            x = np.take(w["e"], ids, axis=0, out=room("x", n, size, d), mode="clip")
            x += w["p"]
            qkv = np.hstack([w["q"] * half, w["k"], w["v"]])
            y = np.matmul(rows(x), qkv, out=room("y", goal.size, 3 * d)).reshape(n, size, 3 * d)
            q, k, v = y[:, :, :d], y[:, :, d:2 * d], y[:, :, 2 * d:]
            a, total = _softly(q, k, self.mask, room)
            a /= total
            m = np.matmul(a, v, out=room("m", n, size, d))
            h = np.matmul(rows(m), w["o"], out=room("h", goal.size, d))
            h += rows(x)
            z = np.matmul(h, w["c"], out=room("z", goal.size, CLASSES))
            bias = w["b"]
            if np.abs(bias).max() >= _FAR:
                z += bias
                bias = np.zeros_like(bias)
            total, share = _raised(z, bias), np.exp(bias)  # z * share / total is the chance of each class
            z[places, goal] -= total / share[goal]
            weight = np.empty((goal.size, 1), np.float32)
            weight[:, 0] = 1 / (total * goal.size)
            h *= weight
            np.matmul(h.T, z, out=g["c"])
            np.matmul(weight[:, 0], z, out=g["b"])
            g["c"] *= share
            g["b"] *= share
            dx = np.matmul(z, (w["c"] * share).T, out=room("dx", goal.size, d))
            dx *= weight
            np.matmul(rows(m).T, dx, out=g["o"])
            dm = np.matmul(dx, w["o"].T, out=room("dm", goal.size, d)).reshape(x.shape)
            ds = np.matmul(dm, v.transpose(0, 2, 1), out=room("ds", n, size, size))
            ds -= np.einsum("bid,bid->bi", dm, m)[:, :, None]
            ds *= a
            dy = room("dy", n, size, 3 * d)
            np.matmul(ds, k, out=dy[:, :, :d])
            np.matmul(ds.transpose(0, 2, 1), q, out=dy[:, :, d:2 * d])
            np.matmul(a.transpose(0, 2, 1), dm, out=dy[:, :, 2 * d:])
            moved = rows(x).T @ rows(dy)
            g["q"][...], g["k"][...], g["v"][...] = moved[:, :d] * half, moved[:, d:2 * d], moved[:, 2 * d:]
            dx += np.matmul(rows(dy), qkv.T, out=room("back", goal.size, d))
            dx.reshape(x.shape).sum(0, out=g["p"])
            g["e"][...] = 0
            np.add.at(g["e"].reshape(-1), (ids.reshape(-1, 1) * d + lanes).ravel(), dx.ravel())
            pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            grown = math.sqrt(1 - 0.99 ** step)
            np.subtract(grad, slow, out=up)
            up *= 0.1
            slow += up
            np.square(grad, out=down)
            down -= square
            down *= 0.01
            square += down
            np.sqrt(square, out=down)
            down += 1e-8 * grown
            np.divide(slow, down, out=up)
            up *= pace * grown / (1 - 0.9 ** step)
            every -= up
        self.w = {n: value.copy() for n, value in w.items()}

    def score(self, sequences: list[np.ndarray], end: int, rows: int = 128) -> np.ndarray:
        """log10 probability of each sequence and the end after it."""
        sizes = np.array([len(s) + 1 for s in sequences])
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.log_probabilities(np.concatenate([np.append(s, end) for s in sequences]), sizes, rows), len(sizes))

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray, rows: int = 128) -> np.ndarray:
        """log10 probability of every id of sequences that stand one after another, each closed by its end id."""
        step = WINDOW - OVERLAP
        starts = np.cumsum(sizes + 1) - sizes - 1  # each sequence gets an end in front
        scored = np.ones(len(ids) + len(sizes), bool)
        scored[starts] = False
        flat = np.empty(len(scored), np.int64)
        flat[scored], flat[~scored] = ids, ids[-1]
        windows = np.maximum(1, -(-(sizes - OVERLAP) // step))
        owner = np.repeat(np.arange(len(sizes)), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = starts[owner] + number * step
        left = sizes[owner] - number * step  # ids of the sequence from here on
        reach = np.arange(WINDOW)
        inputs = np.concatenate([self.input[flat], np.full(WINDOW + 1, self.input[ids[-1]])])
        classes = self.cls[flat]
        out = np.zeros(len(flat))
        out[1:] = self.inside[classes[:-1], flat[1:]]
        later = number > 0  # these count from place OVERLAP on
        tables, bias, room = self._tables(), self.w["b"].astype(np.float64), _Room()
        for some, first in ((np.flatnonzero(~later), 0), (np.flatnonzero(later), OVERLAP)):
            for own in (some[at:at + rows] for at in range(0, len(some), rows)):
                place = begin[own, None] + reach
                h = self._attended(tables, inputs[place], first, room).reshape(-1, DIMENSIONS)
                counted = (reach[first:] < left[own, None]).ravel()
                goal = place[:, first:].ravel() + 1
                if not counted.all():
                    h, goal = h[counted], goal[counted]
                z, met = np.matmul(h, self.w["c"], out=room("z", len(goal), CLASSES)), classes[goal]
                hit = z[np.arange(len(goal)), met] + bias[met]
                out[goal] += (hit - _logs(z, self.w["b"])) / math.log(10)
        return out[scored]


def _softly(q: np.ndarray, k: np.ndarray, mask: np.ndarray, room: _Room) -> tuple[np.ndarray, np.ndarray]:
    """exp of the products of what asks and what is met, 0 where the mask is; and their sums, by which they are still to be divided. Where products are large, rows are lowered by their largest, as exp would overflow."""
    a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", q.shape[0], q.shape[1], k.shape[1]))
    if not -_FAR < a.min() <= a.max() < _FAR:
        a -= np.where(mask > 0, a, -np.inf).max(axis=2, keepdims=True)
        np.minimum(a, 0, out=a)
    np.exp(a, out=a)
    a *= mask
    return a, (a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], np.float32)).reshape(*a.shape[:2], 1)


def _raised(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Turns z into its exp, and gives the sums of exp(z + bias) of the rows. Where numbers are large, rows are lowered by their largest."""
    if not -_FAR < z.min() <= z.max() < _FAR:
        z -= (z + bias).max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.exp(bias)


def _logs(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the sum of exp(z + bias) of each row; z is used up."""
    if max(np.abs(bias).max(), -z.min(initial=0), z.max(initial=0)) < _FAR:
        return np.log(_raised(z, bias))
    top = (z + bias).max(axis=1)
    return top + np.log(np.exp(z + bias - top[:, None]).sum(axis=1))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """id, ids of (id, text): every text's ids and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in words_of(path, pattern).runs(batch.column(1)):
                ends = np.append(0, np.cumsum(some.by_text))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some.count)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(some.ids, pa.int32()))], ["id", "ids"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>")


def windows(ids: DataFrame, end: int, chance: float) -> DataFrame:
    """Windows of ids and the id after them, as many of each document as its ids win by that chance, whatever the batch; short documents are repeated in theirs."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc in batch.column(0):
                doc = doc.values.to_numpy()
                dice = np.random.default_rng([_SEED, xxhash.xxh3_64_intdigest(doc.tobytes())])
                number = dice.binomial(len(doc), chance)
                if number:
                    flat = np.append(end, np.resize(doc, max(len(doc), WINDOW)))
                    out.append(flat[dice.integers(0, len(flat) - WINDOW, number)[:, None] + np.arange(WINDOW + 1)])
            if out:
                flat = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * (WINDOW + 1), pa.int32()), pa.array(flat.ravel(), pa.int32()))], ["ids"])

    return ids.mapInArrow(drawn, "ids array<int>")


def gone_on(model: AttentionModel, ids: DataFrame, end: int, rate: float = 0.002) -> dict[str, np.ndarray]:
    """Attention weights after every task went on from the model's over all ids of its documents: the mean of their moves, weighed by windows. Moves are summed as integers."""
    names = sorted(model.w)
    start = np.concatenate([model.w[n].ravel() for n in names]).astype(np.float64)
    light = copy.copy(model)
    light.inside = None

    def cut(batches: Iterator[pa.RecordBatch], seen: list[int]) -> Iterator[np.ndarray]:
        """BATCH windows, fewer at the end; the documents one after another, so that each id is a goal once."""
        left = np.full(1, end, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                left = np.concatenate([left, batch.column(0).slice(at, 500).flatten().to_numpy(zero_copy_only=False)])
                n = (len(left) - 1) // (WINDOW * BATCH) * BATCH
                for begin in range(0, n, BATCH):
                    seen[0] += BATCH
                    yield left[(begin + np.arange(BATCH))[:, None] * WINDOW + np.arange(WINDOW + 1)]
                left = left[n * WINDOW:]
        n = -(-(len(left) - 1) // WINDOW)
        if n:
            seen[0] += n
            left = np.append(left, np.full(n * WINDOW + 1 - len(left), end))
            yield left[np.arange(n)[:, None] * WINDOW + np.arange(WINDOW + 1)]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = copy.copy(light), [0]
        own.w = {n: v.copy() for n, v in light.w.items()}
        own.fit_windows(cut(batches, seen), math.inf, rate)
        moves = np.rint((np.concatenate([own.w[n].ravel() for n in names]) - start) * _FINE).astype(np.int64) * seen[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moves) + 1), pa.int32()), pa.array(np.append(moves, seen[0]))], ["k", "v"])

    sums = ids.select("ids").mapInArrow(fitted, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # a row a weight
    by = np.zeros(len(start) + 1, np.int64)
    by[sums["k"].to_numpy()] = sums["v"].to_numpy()
    to = start + by[:-1] / _FINE / max(1, by[-1])
    sizes = np.cumsum([model.w[n].size for n in names])[:-1]
    return {n: part.astype(np.float32).reshape(model.w[n].shape) for n, part in zip(names, np.split(to, sizes))}


def kept_back() -> Column:
    """Whether a training document of column id sets the weights of the mix instead of the attention."""
    return F.pmod(F.xxhash64("id"), F.lit(KEPT)) == 0


def train(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[AttentionModel, list[str]]:
    """The model over all training documents, and texts of at most KEPT_DOCS of the documents kept back for the weights of the mix."""
    rows = training_rows(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        model = fitted_model(rows, path, pattern, folder or shared_folder(docs.sparkSession))
    return model, sorted(r.text for r in rows.filter(kept_back()).select("id", "text").orderBy(F.xxhash64("id"), "id", "text").limit(KEPT_DOCS).collect())


def training_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(fold("id", 7) != 2)


def fitted_model(rows: DataFrame, path: str, pattern: str, folder: str) -> AttentionModel:
    """The model over all (id, text) rows."""
    ids = written(encoded(rows, path, pattern), folder, "ids")
    end = subwords_of(path, pattern).end
    model = AttentionModel(end + 1, Gathered(ids.select("ids"), end), Gathered(ids.filter(kept_back()).select("ids"), end))
    if not model.n_ids:
        return model
    ids = ids.filter(~kept_back())
    few = windows(ids.select("ids"), end, min(1.0, FIT_WINDOWS / model.n_ids)).toArrow()["ids"]  # about FIT_WINDOWS rows
    if len(few):
        few = few.combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, WINDOW + 1)
        few = few[np.lexsort(few.T[::-1])]
        dice, steps = np.random.default_rng(_SEED), FIT_WINDOWS // BATCH
        model.fit_windows((few[dice.integers(0, len(few), BATCH)] for _ in range(steps)), steps)
        model.w = gone_on(model, ids, end)
    return model


def mix_weights(model: AttentionModel, subwords: Subwords, kept: DataFrame | list[str], vocabulary: DataFrame, total: int, rounds: int = 30) -> np.ndarray:
    """Weights of the model, of the counts and of the words before, where the texts' own words and ids are taken out of their counts; equal ones without texts. `kept`: texts, or a table of them."""
    spark, folder = vocabulary.sparkSession, shared_folder(vocabulary.sparkSession)
    texts = kept.select("text") if isinstance(kept, DataFrame) else spark.createDataFrame([(t,) for t in kept], "text string")
    apart = copy.copy(model)
    apart.inside = model.aside
    sent, path, pattern = spark.sparkContext.broadcast(apart), subwords.path, subwords.pattern  # a fixed number of weights

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in words_of(path, pattern).runs(batch.column(0)):
                chance, before = _scored_words(sent.value, some)
                yield pa.RecordBatch.from_arrays([pa.array(some.hashes), pa.array(chance), pa.array(before)], ["h", "chance", "before"])

    words = written(texts.mapInArrow(shared, "h long, chance double, before double"), folder, "kept-words")
    rest = vocabulary.join(words.groupBy("h").agg(F.count("*").alias("own")), "h").select("h", (F.col("c") - F.col("own")).alias("rest")).filter("rest > 0")
    counted = F.when(F.col("rest").isNull(), 0.0).otherwise((F.col("rest") + 1) / total)
    shares = written(words.join(rest, "h", "left").select(F.pow(F.lit(10.0), "chance").alias("s0"), counted.alias("s1"), F.col("before").alias("s2")), folder, "kept-shares")
    weights = np.full(3, 1 / 3)
    for _ in range(rounds):
        held = [F.col(f"s{i}") * float(weights[i]) for i in range(3)]
        mean = shares.agg(*[F.avg(h / F.greatest(held[0] + held[1] + held[2], F.lit(1e-300))) for h in held]).first()
        if mean[0] is None:
            return weights
        weights = np.maximum(np.array(mean), 0.01)
        weights /= weights.sum()
    return weights


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


END_WORD = b"\n"  # no word holds white space


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, c: how often each word (and the end) occurs in the training documents; words met only elsewhere are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in by_size(batch.column(0), RUN_BYTES):
                words, _ = _split(batch.column(0).slice(at, to - at))
                hashes = [_hash(w.encode()) for w in words.dictionary.to_pylist()] + [_hash(END_WORD)]
                counts = np.append(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)), to - at)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())], ["h", "c"])

    return training_rows(docs, id_col, text_col).select("text").mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _split(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some texts, A-Z lower-cased, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes, words = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    empty = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))  # a text without words is one empty part
    if len(empty):
        sizes[np.searchsorted(np.cumsum(sizes), empty, side="right")] = 0
        words = words.filter(pc.not_equal(words, ""))
    return words.dictionary_encode(), sizes


class _Some(NamedTuple):
    """Words of some texts, each text closed by the end: places and hashes, the number of places, of each word the number of its ids, all ids, of each text the number of words and of ids."""

    places: np.ndarray
    hashes: np.ndarray
    known: int
    sizes: np.ndarray
    ids: np.ndarray
    count: np.ndarray
    by_text: np.ndarray


class Words:
    """What a process knows of words: subword ids and hash."""

    def __init__(self, subwords: Subwords, most: int = 200_000):
        self.known = Remembered(lambda words: [subwords.lists(words), pa.array([_hash(w.encode()) for w in words], pa.int64())], most)

    def runs(self, texts: pa.StringArray, rows: int = 400) -> Iterator[tuple[int, _Some]]:
        """Where they begin, and the words of so many texts or less."""
        for begin, to in by_size(texts, RUN_BYTES):
            words, sizes = _split(texts.slice(begin, to - begin))
            ends = np.cumsum(sizes + 1)
            places = np.full(ends[-1], len(words.dictionary), np.int32)
            inner = np.ones(len(places), bool)
            inner[ends - 1] = False
            places[inner] = words.indices.to_numpy()
            places = self.known.places(pa.concat_arrays([words.dictionary, pa.array([END_WORD.decode()])]))[places]
            lists, hashes = self.known.columns[0], self.known.columns[1].to_numpy()
            del words, inner
            for at in range(0, to - begin, rows):
                count = sizes[at:at + rows] + 1
                own = places[ends[at] - count[0]:ends[at + len(count) - 1]]
                taken = lists.take(pa.array(own))
                n = np.diff(taken.offsets.to_numpy()).astype(np.int64)
                yield begin + at, _Some(own, hashes[own], len(hashes), n, taken.values.to_numpy().astype(np.int64), count, np.add.reduceat(n, np.cumsum(count) - count))


@functools.cache
def words_of(path: str, pattern: str) -> Words:
    """Held once by a process."""
    return Words(subwords_of(path, pattern))


def _scored_words(model: AttentionModel, some: _Some) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of some texts: log10 chance by the model, share in the text's words before."""
    begin = np.cumsum(some.sizes) - some.sizes
    by_id = model.log_probabilities(some.ids, some.by_text)
    key = np.repeat(np.arange(len(some.count)), some.count) * some.known + some.places
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    again = np.empty(len(key))
    again[order] = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
    position = np.arange(len(key)) - np.repeat(np.cumsum(some.count) - some.count, some.count)
    return np.add.reduceat(by_id, begin), again / np.maximum(position, 1)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10(10 ** a + b), where b may be 0."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(a * math.log(10), np.log(b)) / math.log(10)


SCORED = "id long, row long, held_out boolean, n_tokens long, known long, logs double, score double, rest array<struct<h:long,chance:double>>"


def _scored_documents(docs: DataFrame, path: str, pattern: str, folder: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Row, float]:
    """Counts of words; the documents scored but for the words that aren't sent to all tasks; counts in all; weight of the counts."""
    spark = docs.sparkSession
    vocabulary = written(word_counts(docs, id_col, text_col), folder, "words")
    totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total = totals.n + totals.v + 1
    training = training_rows(docs, id_col, text_col)
    model = fitted_model(training, path, pattern, folder)
    by_model, by_counts, by_before = map(float, mix_weights(model, subwords_of(path, pattern), training.filter(kept_back()), vocabulary, total))
    model.aside = None
    top = vocabulary.orderBy(F.desc("c"), "h").limit(TOP_WORDS).toArrow().sort_by("h")
    sent = spark.sparkContext.broadcast((model, top["h"].to_numpy(), np.log10(top["c"].to_numpy() + 1)))  # a fixed number of weights and words

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent, logs = sent.value
        for batch in batches:
            for at, some in words_of(path, pattern).runs(batch.column(3)):
                part = batch.slice(at, len(some.count))
                hashes, count, (chance, before) = some.hashes, some.count, _scored_words(own, some)
                log = np.full(len(hashes), -1.0)
                if len(frequent):
                    near = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    log = np.where(frequent[near] == hashes, logs[near], log)
                chance = _log_sum(chance + math.log10(by_model), by_before * before)
                doc = np.repeat(np.arange(len(count)), count)
                here = log >= 0  # the others meet their counts in the join
                mixed = _log_sum(chance[here], by_counts / total * 10.0 ** log[here])
                rest = pa.StructArray.from_arrays([pa.array(hashes[~here]), pa.array(chance[~here])], ["h", "chance"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~here], minlength=len(count)))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(count, pa.int64()), pa.array(np.bincount(doc[here], minlength=len(count)), pa.int64()),
                     pa.array(np.bincount(doc[here], log[here], len(count))), pa.array(np.bincount(doc[here], mixed, len(count))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                    ["id", "row", "held_out", "n_tokens", "known", "logs", "score", "rest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), (fold(id_col, 7) == 2).alias("held_out"), text_of(text_col).alias("text"))
    part = written(rows.mapInArrow(scored, SCORED), folder, "scored")  # row numbers are fixed here
    return vocabulary, part, totals, by_counts


def score_documents(docs: DataFrame, path: str, pattern: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row."""
    spark = docs.sparkSession
    with small_batches(spark):
        vocabulary, part, totals, by_counts = _scored_documents(docs, path, pattern, folder, id_col, text_col)
    total = totals.n + totals.v + 1
    chance, log = F.col("chance"), F.log10(F.col("c") + 1)
    mixed = F.when(F.col("c").isNull(), chance).otherwise(F.log10(F.pow(F.lit(10.0), chance) + by_counts / total * (F.col("c") + 1)))
    tail = part.select("row", F.inline("rest")).join(vocabulary, "h", "left").groupBy("row").agg(F.count("c").alias("more"), F.sum(log).alias("more_logs"), F.sum(mixed).alias("more_score"))
    out = part.drop("rest").join(tail, "row", "left")
    sum_of = lambda own, more: F.col(own) + F.coalesce(F.col(more), F.lit(0))
    base = sum_of("logs", "more_logs") - F.col("n_tokens") * F.lit(math.log10(total))
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", sum_of("known", "more").alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"), base.alias("base_score"), sum_of("score", "more_score").alias("score"))
