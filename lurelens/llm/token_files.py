"""Token ids in ORC files: one row a document, in ascending id order, ids as run-length encoded integers.

Spark's ORC writer makes the stripes, row indexes and the Bloom filter on the document id. Files hold ascending ranges of
ids, so readers take stripes in parallel and a look-up by id skips files, stripes and row groups by their metadata.

Null and empty texts hold the end id alone. Rows without an id come first; rows of one id are ordered by the hash of their
text, and repeated rows are stored as often as they occur. Extra columns are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelens.llm.common import IN_RUN, Remembered, by_size, crc, spaced_ids, text_of


def _joined(table: pa.ListArray, codes: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The table's lists by their numbers, one after another; a new list ends after so many of them."""
    taken = table.take(pa.array(codes))
    return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[np.append(0, ends)], pa.int32()), taken.values)


class LibraryEncoder:
    """Ids by the tokenizers library, as Arrow lists.

    Texts are cut at single spaces, and each distinct stretch of a batch is cut once more before closing marks that stand behind
    a letter or digit: both cuts are cuts of the vocabulary's pattern too. What was met before is remembered,
    the rest goes to the library, many as one text. Texts with longer runs of white space go one by one.
    """

    MARKS, BEFORE = ".,;:!?)", "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"

    def __init__(self, path: str, most: int = 1_000_000, at_once: int = 16_384):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = self.library.encode("\n\n", add_special_tokens=False).ids
        self.known = Remembered(lambda words: [spaced_ids(words, self.mark, self._run)], most, at_once)

    def _run(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, stretches: pa.StringArray) -> pa.ListArray:
        """Ids of distinct stretches, each with a space in front."""
        bare = pc.ascii_rtrim(stretches, characters=self.MARKS)
        cut = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(stretches)), pc.match_substring_regex(bare, self.BEFORE))
        words = pc.if_else(cut, bare, stretches).dictionary_encode()
        marks = pc.struct_field(pc.extract_regex(stretches.filter(cut), f"(?P<marks>[{self.MARKS}]+)$"), "marks").dictionary_encode()
        places = self.known.places(words.dictionary)
        lists = self.known.columns[0]
        sizes = 1 + cut.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        codes = np.empty(sizes.sum(), np.int64)
        codes[ends - sizes] = places[words.indices.to_numpy()]
        codes[ends[sizes == 2] - 1] = len(lists) + marks.indices.to_numpy()
        return _joined(pa.concat_arrays([lists, pa.array(self._run(marks.dictionary.to_pylist()), pa.list_(pa.int32()))]), codes, ends)

    def ids(self, texts: pa.StringArray, end_id: int) -> pa.ListArray:
        """Ids of each text and the end."""
        strings = texts.to_pylist()
        whole = ["<|" in t or bool(IN_RUN.search(t)) for t in strings]
        parts = pc.split_pattern(pc.if_else(pa.array(whole, pa.bool_()), "", texts), " ")
        sizes = pc.list_value_length(parts).to_numpy().astype(np.int64)
        heads = pa.array(self._run([t if w else t.partition(" ")[0] for t, w in zip(strings, whole)]), pa.list_(pa.int32()))
        behind = np.ones(sizes.sum(), bool)
        behind[np.cumsum(sizes) - sizes] = False
        rest = parts.flatten().filter(pa.array(behind)).dictionary_encode()
        lists = self._stretches(rest.dictionary)
        ends = np.cumsum(sizes + 1)
        codes = np.full(ends[-1] if len(ends) else 0, len(lists) + len(heads), np.int64)  # the end, where nothing else stands
        at = ends - sizes - 1
        codes[at] = len(lists) + np.arange(len(heads))
        inner = np.ones(len(codes), bool)
        inner[at] = inner[ends - 1] = False
        codes[inner] = rest.indices.to_numpy()
        return _joined(pa.concat_arrays([lists, heads, pa.array([[end_id]], pa.list_(pa.int32()))]), codes, ends)


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 16) -> None:
    """Encodes and writes all documents to ORC files in `folder`: id, tie (orders rows of one id), n_tokens, ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for batch in batches:
            for at, to in by_size(batch.column(2)):
                part = batch.slice(at, to - at)
                ids = own.ids(part.column(2), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pc.list_value_length(ids).cast(pa.int64()), ids], ["id", "tie", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    (
        ordered.mapInArrow(encoded, "id long, tie long, n_tokens long, ids array<int>")
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.stripe.size", str(stripe_mb << 20)).option("orc.compress", "ZSTD")
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as stored: id, tie, n_tokens, ids."""
    return spark.read.schema("id long, tie long, n_tokens long, ids array<int>").orc(folder)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """The rows of one document; the filter reaches the ORC reader, which skips by ranges and Bloom filters."""
    return read_token_files(spark, folder).filter(F.col("id") == doc_id)


def document_positions(spark: SparkSession, folder: str) -> DataFrame:
    """One row a stored document: id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files.

    Positions come from the running count inside each file plus the counts of the files before it: a file holds a range of
    ids of bounded size, and only one row a file meets in the ordering of files.
    """

    @F.pandas_udf("long")
    def checksum(ids: pd.Series) -> pd.Series:
        return pd.Series([crc(np.asarray(x, dtype="<i4").tobytes()) for x in ids], dtype="int64")

    rows = read_token_files(spark, folder).select("id", "tie", "n_tokens", checksum("ids").alias("ids_crc32"), F.col("_metadata.file_path").alias("file"))
    files = read_token_files(spark, folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum("n_tokens").alias("in_file"), F.min(F.struct("id", "tie")).alias("first"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("id", "tie", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select(
        "id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )
