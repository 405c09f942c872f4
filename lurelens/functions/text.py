"""Text columns: keyword counts, word splits, rounding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column | str) -> Column:
    """NULL text behaves like empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def joined(*cols: str, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[blank(c) for c in cols])


def lowered(*cols: str, sep: str = " ") -> Column:
    return F.lower(joined(*cols, sep=sep))


#: Texts of an Arrow batch that are Python strings at the same time.
TEXTS_AT_ONCE = 64


def _strings(texts: pa.Array) -> Iterator[str]:
    """The texts one by one, NULL as empty; only a few of a batch exist as strings at any time."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        for text in texts.slice(at, TEXTS_AT_ONCE).to_pylist():
            yield text or ""


def lexicon_hits(text: Column, *lexicons: list[str]) -> Column:
    """ARRAY<INT>: non-overlapping occurrences, summed over the keywords of each lexicon.

    The text crosses once, in Arrow batches, for all lexicons together, and each keyword is one search in it;
    a column expression would build a copy of the text per keyword.
    """
    words = [list(lexicon) for lexicon in lexicons]

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([[sum(map(t.count, lexicon)) for lexicon in words] for t in _strings(texts)], pa.list_(pa.int32()))

    return F.arrow_udf(count, "array<int>")(text)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Non-overlapping occurrences, summed over keywords, of one lexicon in a short text.

    ``text`` should be a plain column: inside the lambda an expression would be evaluated once per
    keyword. One literal array keeps the generated code small whatever the lexicon.
    """
    return F.aggregate(
        F.array(*[F.lit(k) for k in keywords]),
        F.lit(0),
        lambda total, k: total
        + ((F.length(text) - F.length(F.replace(text, k, F.lit("")))) / F.length(k)).cast("int"),
    )


def any_in(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Whole words made of a-z only. A word ends where a letter, digit or underscore of any
    script does, so 'été' gives no token."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]+$"))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def round6(c: Column) -> Column:
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def _entropies(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts))
    for i, text in enumerate(_strings(texts)):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points):
            counts = np.bincount(points) if points.max() < 4096 else np.unique(points, return_counts=True)[1]
            shares = counts[counts > 0] / len(points)
            out[i] = -(shares * np.log2(shares)).sum()
    return pa.array(out)


def entropy(text: Column) -> Column:
    """Shannon entropy over characters: one histogram of code points per text, in Arrow batches (no shuffle)."""
    return F.arrow_udf(_entropies, "double")(text)
