"""Helpers that several operators share: work tables, columns, digests of ids, cached splitting of text."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Only a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lurelens-llm-")
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4()}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


#: ASCII letters to lower case, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A space that may be part of a longer run of white space.
IN_RUN = re.compile(r" (?:\s|\Z)")


def lower_words(text: str) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


class Cache(dict):
    """Remembers what `make` returns for a key. When it holds `most` entries it sets them aside and starts anew, taking back those still asked for; at most twice as many are held."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.aside = make, most, {}

    def turn(self) -> None:
        self.aside = dict(self)
        self.clear()

    def __missing__(self, key):
        if len(self) >= self.most:
            self.turn()
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


@contextmanager
def small_batches(spark: SparkSession, rows: int = 800) -> Iterator[None]:
    """Jobs run in here hand Python so many rows at once at most: lists of ids and texts of a default batch take much memory on both sides. The setting before comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def by_size(texts: pa.StringArray, most: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts of that many bytes or so."""
    filled = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // most
    starts = np.append(np.flatnonzero(np.diff(filled, prepend=-1)), len(texts)).tolist()
    return zip(starts[:-1], starts[1:])


class Remembered:
    """Values of words in Arrow arrays: `make` gives the columns for new words, `at_once` at most. About `most` words are held, those asked for last."""

    def __init__(self, make: Callable[[list[str]], list[pa.Array]], most: int, at_once: int = 16_384):
        self.make, self.most, self.at_once, self.batch = make, most, at_once, 0
        self.words, self.columns, self.used = pa.array([], pa.string()), make([]), np.empty(0, np.int64)

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Places of distinct words in the columns as they are now."""
        self.batch += 1
        if len(self.words) > self.most:
            last = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
            self.words, self.used = self.words.take(pa.array(last)), self.used[last]
            self.columns = [c.take(pa.array(last)) for c in self.columns]
        places = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = words.take(pa.array(np.flatnonzero(places < 0)))
        places[places < 0] = len(self.words) + np.arange(len(new))
        if len(new):
            made = [self.make(new.slice(at, self.at_once).to_pylist()) for at in range(0, len(new), self.at_once)]
            self.words, self.columns = pa.concat_arrays([self.words, new]), [pa.concat_arrays(c) for c in zip(self.columns, *made)]
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[places] = self.batch
        return places


def spaced_ids(words: list[str], mark: list[int], run: Callable[[list[str]], list[list[int]]]) -> pa.ListArray:
    """Ids of words, each with a space in front. `run` gets them as one text, with an empty line after each: that line is a piece of its own, and `mark`, if one id,
    shows where they end. Words with white space at an end or empty lines go one by one."""
    plain = np.array([len(mark) == 1 and bool(s) and s.strip() == s and "\n\n" not in s for s in words], bool)
    joined = pa.array([], pa.list_(pa.int32()))
    if plain.any():
        ids = np.asarray(run(["".join([f" {s}\n\n" for s, p in zip(words, plain) if p])])[0], dtype=np.int32)
        held = ids != mark[0]
        if len(ids) - held.sum() == plain.sum():
            joined = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)[~held]), pa.int32()), pa.array(ids[held]))
        else:
            plain[:] = False
    alone = pa.array(run([" " + s for s, p in zip(words, plain) if not p]), pa.list_(pa.int32()))
    return pa.concat_arrays([joined, alone]).take(pa.array(np.argsort(np.argsort(~plain, kind="stable"))))


class PieceEncoder:
    """Encodes whole texts piece by piece, where `pattern` cuts a text into pieces and `encode` gives a piece's packed ids.

    The pattern must be of the byte-level family: no alternative holds a space but at its start or in a run of white
    space. A single space between other characters then always begins a piece, so the text is cut at spaces first and
    the stretches between them are remembered; texts with longer runs of white space take the pattern over the whole text.
    """

    def __init__(self, pattern: str, encode: Callable[[str], bytes]):
        self.split = regex.compile(pattern).findall
        self.pieces = Cache(encode, 400_000)
        self.stretches = Cache(lambda s: self._whole(" " + s), 150_000)

    def _whole(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split(text)])

    def packed(self, text: str) -> bytes:
        if IN_RUN.search(text):
            return self._whole(text)
        head, *rest = text.split(" ")
        return self._whole(head) + b"".join(map(self.stretches.__getitem__, rest))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
