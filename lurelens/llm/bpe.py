"""Byte-level BPE by prefix dynamic programming, and its inverse.

For every prefix of a piece the table holds the one token with which the prefix's encoding ends. A token t may follow
a token s iff merging their joined bytes gives back [s, t]; an encoding is the right one iff every token may follow its
predecessor, so exactly one token that is a suffix of the prefix may follow the entry stored at its start. Appending
bytes only adds entries, and after an edit entries are made anew until a full token length of them is unchanged.

Null and empty texts encode to no ids. Rows are independent: repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import Cache, PieceEncoder, text_of

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Token bytes with their merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for data, token in ranks.items():
            self.bytes_of[token] = data
        #: Whether merging a token's own bytes yields the token; whether the token in the low bits may follow the one in the high bits.
        self.whole = Cache(lambda token: self.merged(self.bytes_of[token]) == [token], len(ranks))
        self.pairs = Cache(self._pair, 600_000)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(data): int(rank) for data, rank in (line.split() for line in lines if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """The plain definition: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        get, none = self.ranks.get, 1 << 60
        parts = [data[i:i + 1] for i in range(len(data))]
        joins = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while joins:
            rank = min(joins)
            if rank == none:
                break
            at = joins.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(joins):
                joins[at] = get(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def _pair(self, key: int) -> bool:
        after, token = key >> 32, key & 0xFFFFFFFF
        return self.merged(self.bytes_of[after] + self.bytes_of[token]) == [after, token]


class PrefixTable:
    """Last tokens of all prefixes of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> PrefixTable:
        self.data += data
        self._fill(len(self.data))
        return self

    def _fill(self, upto: int) -> None:
        """Entries for the prefixes up to that length. One token at most fits, so the likeliest starts are tried first: that of the entry before, and later ones."""
        data, last, longest = self.data, self.last, self.vocabulary.longest
        rank, whole, pairs, bytes_of = self.vocabulary.ranks.get, self.vocabulary.whole, self.vocabulary.pairs, self.vocabulary.bytes_of
        for end in range(len(last) + 1, upto + 1):
            likely = end - 1 - len(bytes_of[last[-1]]) if last else 0
            for begin in chain(range(likely, end), range(likely - 1, max(-1, end - longest - 1), -1)):
                token = rank(data[begin:end])
                if token is not None and whole[token] and (begin == 0 or pairs[last[begin - 1] << 32 | token]):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes")

    def edit(self, begin: int, end: int, data: bytes) -> int:
        """Replaces data[begin:end]; returns the number of entries made anew."""
        old, shift = self.last, len(data) - (end - begin)
        self.data = self.data[:begin] + data + self.data[end:]
        self.last, made, same = old[:begin], 0, 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            if same >= self.vocabulary.longest:  # an entry depends on no earlier ones than these
                self.last += old[at - shift:]
                break
            self._fill(at + 1)
            made += 1
            same = same + 1 if at >= begin + len(data) and old[at - shift] == self.last[at] else 0
        return made

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Codec:
    """Text to packed ids (little-endian, unsigned, 32 bits) and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.read(path)
        self.texts = PieceEncoder(pattern, self._piece)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        token = self.vocabulary.ranks.get(data)  # a piece that is a token is not merged
        if token is not None:
            return array("I", [token]).tobytes()
        return array("I", PrefixTable(self.vocabulary, data).tokens()).tobytes()

    def encode(self, text: str) -> bytes:
        return self.texts.packed(text)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, array("I", packed)))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker, with what it remembers."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, digests of ids and of the bytes decoded from them; with_ids adds the ids as array<int>."""

    id_type = docs.schema[id_col].dataType

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # what is made of a batch leaves in slices
                part = batch.slice(at, 500)
                packed = [own.encode(text) for text in part.column(1).to_pylist()]
                sizes = np.array([len(p) // 4 for p in packed], np.int64)
                columns = [
                    part.column(0), pa.array(sizes), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in packed], pa.string()),
                ]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    shape = f"id {id_type.simpleString()}, {RESULT}" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(encoded, shape).withColumnRenamed("id", id_col)
