"""Benchmark decontamination by a BM25 inverted index of the test items and block-max WAND.

Every window of words of every document (windows overlap by half, so an item's full length fits into one) is a query. An
item's score is its BM25 score for the window's distinct words, divided by its score for its own words, and all items at
or above a threshold are retrieved: postings are cut into blocks of items with the largest impact of each block; windows
whose bound, and then blocks whose bound, stay below the threshold are skipped, and pivots walk the rest. An item counts
as leaked if the 5-word shingles of both its question and its answer are found again around any retrieved window, or those of
the whole item and, close to them, half of each part's pairs of words (words, for a part shorter than a shingle), as one
changed word may break every shingle of a short part. Of the windows where an item is found, the one of the best score is reported.

An item's question is what stands before its last question mark, or else all but its last sentence, or else its first half; the
answer is the rest. Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Items without
words match nothing; null and empty texts leak nothing; repeated items and documents are judged each by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import Cache, text_of

K1, B = 1.2, 0.75
BLOCK = 4
#: Least share of an item's own score; least share of the shingles of its question and of its answer, or of the whole item; words of a shingle.
THRESHOLD, OVERLAP, SHINGLE = 0.65, 0.8, 5
#: Least share of each part's runs of two words where the whole item decides: a changed word breaks two of these, but five shingles.
PART = 0.5
#: Items are indexed in shards of at most so many characters, so what is sent to the executors is bounded.
SHARD_CHARS = 32_000_000
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HIT = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    at = text.rfind("?") + 1
    if not at or not words_of(text[at:]):
        ends = [m.end() for m in re.finditer(r"[.!?]\s", text)]
        at = next((e for e in reversed(ends) if len(words_of(text[e:])) >= SHINGLE and len(words_of(text[:e])) >= SHINGLE), 0)
    if not at:
        words = words_of(text)
        return words[:(len(words) + 1) // 2], words[(len(words) + 1) // 2:]
    return words_of(text[:at]), words_of(text[at:])


class ItemIndex:
    """Postings of normalised impacts, cut into blocks of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        bags = [(item, text, Counter(words_of(text))) for item, text in items]
        bags = [x for x in bags if x[2]]
        self.items = [item for item, _, _ in bags]
        cut = [halves(text) for _, text, _ in bags]
        self.parts = [tuple(map(shingles, parts)) for parts in cut]
        #: Shingles of the whole item; of each part the runs of two words, or the words of a part shorter than a shingle, and its size.
        self.wholes = [(shingles(a + b), *((shingles(x, 2 if len(x) >= SHINGLE else 1), len(x)) for x in (a, b))) for a, b in cut]
        self.lengths = [sum(bag.values()) for _, _, bag in bags]
        self.threshold = threshold
        mean = sum(self.lengths) / max(1, len(bags))
        spread = Counter(w for _, _, bag in bags for w in bag)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for number, (_, _, bag) in enumerate(bags):
            impact = {w: math.log(1 + (len(bags) - spread[w] + 0.5) / (spread[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * self.lengths[number] / mean)) for w, n in bag.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                postings.setdefault(w, []).append((number, x / own))
        self.terms = {w: t + 1 for t, w in enumerate(postings)}
        self.postings = [([], [])] + [([n for n, _ in p], [x for _, x in p]) for p in postings.values()]
        #: For each term and block: begin and end of its postings there, and their largest impact.
        self.blocks: list[dict[int, tuple[int, int, float]]] = []
        for numbers, impacts in self.postings:
            own: dict[int, tuple[int, int, float]] = {}
            for at, (n, x) in enumerate(zip(numbers, impacts)):
                begin, _, best = own.get(n // BLOCK, (at, at, 0.0))
                own[n // BLOCK] = (begin, at + 1, max(best, x))
            self.blocks.append(own)
        self.n_blocks = -(-len(bags) // BLOCK)
        # Terms of many items cannot decide alone: together they give no item of a block more than `common` of its score. Windows need the rest from other terms.
        given, rare = np.zeros(len(bags)), np.ones(len(self.postings), bool)
        for t in sorted(range(1, len(self.postings)), key=lambda t: -len(self.postings[t][0])):
            more = given.copy()
            more[self.postings[t][0]] += self.postings[t][1]
            if more.max() > threshold / 2:
                break
            given, rare[t] = more, False
        self.common = np.maximum.reduceat(given, np.arange(0, len(bags), BLOCK)) if bags else given
        counts = np.array([len(b) if r else 0 for b, r in zip(self.blocks, rare)])
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        held = [b for b, r in zip(self.blocks, rare) if r]
        self.block_of = np.array([n for b in held for n in b], dtype=np.int64)
        self.block_max = np.array([x for b in held for _, _, x in b.values()])
        self.stride = max(32, max(self.lengths, default=0))
        self._known = None

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def retrieve(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """The block's items at or above the threshold for these distinct terms: the pivot is the first item that the lists up to it could lift there."""
        lists = []
        for t in terms:
            at = self.blocks[t].get(block)
            if at is not None:
                lists.append([self.postings[t][0][at[0]], at[0], at[1], at[2], *self.postings[t]])
        if sum(x[3] for x in lists) < self.threshold - 1e-9:
            return []
        first = block * BLOCK
        out = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for entry in lists:
                bound += entry[3]
                if bound >= self.threshold - 1e-9:
                    pivot = entry[0]
                    break
            if pivot is None:
                break
            score = 0.0
            for entry in lists:
                while entry[0] < pivot:
                    entry[1] += 1
                    entry[0] = entry[4][entry[1]] if entry[1] < entry[2] else first + BLOCK
                if entry[0] == pivot:
                    score += entry[5][entry[1]]
                    entry[1] += 1
                    entry[0] = entry[4][entry[1]] if entry[1] < entry[2] else first + BLOCK
            if score >= self.threshold - 1e-9:
                out.append((pivot, score))
            lists = [x for x in lists if x[1] < x[2]]
        return out

    def _windows(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of window and block whose bound reaches the threshold; window w holds steps w and w + 1, and repeated words count once."""
        held = np.flatnonzero(self.starts[ids + 1] > self.starts[ids])
        terms, step = ids[held], held // self.stride
        order = np.argsort(terms, kind="stable")
        last = np.full(len(held), -2)  # the step of the same term's place before
        same = terms[order[1:]] == terms[order[:-1]]
        last[order[1:][same]] = step[order[:-1][same]]
        n = max(1, -(-len(ids) // self.stride) - 1)
        first, second = last < step, (last < step - 1) & (step > 0)
        window = np.concatenate([step[first], step[second] - 1])
        terms = np.concatenate([terms[first], terms[second]])
        keep = window < n
        window, terms = window[keep], terms[keep]
        at_once = max(1, 2_000_000 // max(1, self.n_blocks))
        for begin in range(0, n, at_once):
            own = (window >= begin) & (window < begin + at_once)
            w, t = window[own] - begin, terms[own]
            sizes = self.starts[t + 1] - self.starts[t]
            place = np.repeat(self.starts[t] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(t) else np.zeros(0, np.int64)
            keys = np.repeat(w, sizes) * self.n_blocks + self.block_of[place]
            rows = min(at_once, n - begin)
            bound = np.bincount(keys, self.block_max[place], rows * self.n_blocks).reshape(rows, self.n_blocks) + self.common
            for i, block in np.argwhere(bound >= self.threshold - 1e-9):
                yield int(i) + begin, int(block)

    def nearly(self, number: int, around: Surroundings, begin: int, end: int) -> bool:
        """Whether the shingles of the whole item stand in that range and, where they do, enough runs of each part."""
        whole, *parts = self.wholes[number]
        span = around.span(whole, begin, end, OVERLAP)
        if not span:
            return False
        for runs, size in parts:
            reach = size + SHINGLE
            if around.share(runs, max(begin, span[0] - reach), min(end, span[1] + reach)) < PART:
                return False
        return True

    def leaks(self, text: str) -> list[dict]:
        """Verified items of a whole text, by item: id, best score, shares of the question's and the answer's shingles there."""
        if self._known is None:
            self._known = Cache(lambda w: self.terms.get(w, 0))
        words = words_of(text)
        if not words or not self.items:
            return []
        ids = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        best: dict[int, dict] = {}
        last, terms, around = -1, [], None
        for w, block in self._windows(ids):
            a, b = w * self.stride, min((w + 2) * self.stride, len(words))
            if w != last:
                last, terms = w, [t for t in np.unique(ids[a:b]).tolist() if t]
                around = Surroundings(words, max(0, a - self.stride), min(len(words), b + self.stride))
            for number, score in self.retrieve(terms, block):
                if number in best and score <= best[number]["score"]:
                    continue
                begin, end = a - self.lengths[number], b + self.lengths[number]
                question, answer = (around.share(part, begin, end) for part in self.parts[number])
                if question >= OVERLAP and answer >= OVERLAP or self.nearly(number, around, begin, end):
                    best[number] = {"item_id": self.items[number], "score": score, "question": question, "answer": answer}
        return [hit for _, hit in sorted(best.items())]


class Surroundings:
    """Where runs of words stand in words[begin:end]; places are looked up once for all items of a window."""

    def __init__(self, words: list[bytes], begin: int, end: int):
        self.words, self.begin, self.end, self.places = words, begin, end, {}

    def share(self, runs: set[tuple[bytes, ...]], begin: int, end: int) -> float:
        """Share of the runs, all of one length, that stand in words[begin:end]; none to look for counts as found."""
        if not runs:
            return 1.0
        n = len(next(iter(runs)))
        held = self._held(n)
        return sum(any(begin <= i <= end - n for i in held.get(run, ())) for run in runs) / len(runs)

    def span(self, runs: set[tuple[bytes, ...]], begin: int, end: int, least: float) -> tuple[int, int] | None:
        """From the first to the last word of the runs in words[begin:end], if at least that share of them stands there."""
        n = len(next(iter(runs)))
        held = self._held(n)
        found = [own for run in runs if (own := [i for i in held.get(run, ()) if begin <= i <= end - n])]
        return (min(map(min, found)), max(map(max, found)) + n) if found and len(found) >= least * len(runs) else None

    def _held(self, n: int) -> dict[tuple[bytes, ...], list[int]]:
        if n not in self.places:
            held = self.places[n] = {}
            for i in range(self.begin, self.end - n + 1):
                held.setdefault(tuple(self.words[i:i + n]), []).append(i)
        return self.places[n]


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = SHARD_CHARS, threshold: float = THRESHOLD) -> list[ItemIndex]:
    """Indexes of all items, each over at most `chars` characters (or one item). The items pass the driver shard by shard."""
    rows = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    n = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // chars)
    part = F.pmod(F.xxhash64("id", F.length("text")), F.lit(max(1, n)))
    return [ItemIndex([(r.id, r.text) for r in rows.filter(part == i).orderBy("id", "text").toLocalIterator()], threshold) for i in range(n)]


def leak_column(indexes: list[ItemIndex], text: Column) -> Column:
    """Array of leaked items of each text."""
    columns = [_hits(index)(text) for index in indexes]
    return F.concat(*columns) if columns else F.array().cast(HIT)


def _hits(index: ItemIndex):
    @F.pandas_udf(HIT)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([index.leaks(t) for t in texts], dtype="object")

    return hits


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each leaked item of a document."""
    found = docs.select("doc_id", F.explode(leak_column(shards(benchmark), text_of())).alias("h"))
    return found.select("doc_id", F.col("h.item_id").alias("item_id"), F.col("h.score").alias("score"), F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leaked item, with their own columns."""
    return docs.filter(F.size(leak_column(shards(benchmark), text_of())) == 0)
