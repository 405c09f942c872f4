"""Global ranks and running totals without a one-task window.

Rows are cut into many ordered buckets, by leading bits of a hash or by quantiles of a score. Totals per bucket are a small table (groups x buckets, a
proven bound), so their prefix sums are cheap; the fine order is settled inside each bucket. No
group, however hot, is ever sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65536


def hash_key(c: Column, seed: int = 42) -> Column:
    """Reproducible shuffle order: an md5 of the id and a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def hash_bucket(key: Column) -> Column:
    """Leading 16 bits of a hex key, in the key's own order."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


#: Cuts of a distribution; a bucket between two of them holds about 1/EDGES of the values.
EDGES, COARSE = 1024, 32


def quantile_edges(df: DataFrame, value: str) -> list[float]:
    """EDGES - 1 ascending cuts at even shares of the values, from a quantile sketch that tasks build and merge.

    They become literals of the plan: a plan that reads its input twice sees the same buckets both times.
    """
    shares = [i / EDGES for i in range(1, EDGES)]
    return df.agg(F.percentile_approx(value, shares, 10 * EDGES).alias("e")).first()["e"] or []


def quantile_bucket(value: Column, edges: list[float]) -> Column:
    """Number of cuts below the value, found in two steps of at most COARSE and EDGES / COARSE comparisons."""
    if not edges:
        return F.lit(0)
    step = -(-len(edges) // COARSE)
    cuts = [F.expr("array(" + ", ".join(f"{float(e)!r}D" for e in part) + ")") for part in (edges[step - 1::step], edges)]
    coarse = F.size(F.filter(cuts[0], lambda e: e < value))
    fine = F.size(F.filter(F.slice(cuts[1], coarse * step + 1, F.lit(step)), lambda e: e < value))
    return coarse * step + fine


def bucketed_prefix(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], values: list[str],
    descending: bool = False,
) -> DataFrame:
    """Adds ``<value>_run``: inclusive running total of each value per key, in global order."""
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"{v}_total") for v in values])
    by = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, bucket,
        *[F.coalesce(F.sum(f"{v}_total").over(before), F.lit(0)).alias(f"{v}_before") for v in values],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.select("*", *[F.sum(v).over(inside).alias(f"{v}_in") for v in values])
    return ranked.join(offsets, [*keys, bucket]).select(
        *df.columns, *[(F.col(f"{v}_in") + F.col(f"{v}_before")).alias(f"{v}_run") for v in values]
    )


def global_row_number(df: DataFrame, keys: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """Adds ``rn`` (1..n per key) in hash order of the id."""
    marked = df.withColumn("_h", hash_key(F.col(id_col), seed)).withColumn("_one", F.lit(1).cast("bigint"))
    marked = marked.withColumn("_b", hash_bucket(F.col("_h")))
    out = bucketed_prefix(marked, keys, "_b", [F.col("_h"), F.col(id_col)], ["_one"])
    return out.withColumnRenamed("_one_run", "rn").drop("_h", "_b", "_one")
