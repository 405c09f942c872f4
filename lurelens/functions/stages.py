"""Stage boundaries inside a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sealed(df: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """Evaluates the columns once per row and keeps later filters on them above this point.

    A filter on a derived column is otherwise pushed below the projections that build it, with every
    intermediate step copied into the predicate. Columns named in ``beside`` are not sealed, so that
    filters on them reach the scan. No shuffle, and it works on streams.
    """
    inside = [c for c in df.columns if c not in beside]
    return df.select(*beside, F.inline(F.array(F.struct(*inside)))).select(*df.columns)


def unpacked(df: DataFrame, keys, array: Column, position: str, value: str) -> DataFrame:
    """One row per array element. The array is built once: without the seal Spark copies its whole
    expression into a 'not empty' filter below the explode and evaluates it twice or more. Keys stay
    outside the seal: a filter on them reaches the scan."""
    rows = sealed(df.select(*keys, array.alias("_array")), keys)
    return rows.select(*keys, F.posexplode("_array").alias(position, value))
