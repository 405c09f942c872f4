"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / weight, u drawn from a digest of its id (of its text, where the id is missing) and
the seed; a heavier document tends to come earlier. Sources ordered by code point, the missing one last, weigh `weights`
in turn and share `percent` of all words; a target stops at `most` times its source's words and what it leaves is shared
again by weight, which is the level at which water stands over all sources. A source gives its complete epochs first;
then its documents in the order of their keys, whole, until the words left are used up. The document on that edge gives
only the words up to it, so a source's words differ from its target by less than one.

Order inside a source is global though no task sorts a source: rows are dealt out by ranges of (source, key), each
range sums its sizes, and prefix sums over ranges (a row for each range and source) carry the sums on. A source that
holds most rows is spread over most ranges. Texts are read once; what moves is id, source, size and key.

Missing or empty texts have size 0 and give 0 words; a missing source is a source of its own, the empty name another.
Rows of one id are documents of their own; equal rows are interchangeable. Without words all targets are 0. An empty
table gives an empty result. Extra columns are left out, whatever their names. The same rows give the same result in any
order and partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import text_of, written

#: Fixed values of the usual mix: weights by turn, percent of all words, largest multiple of a source.
WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2
#: Characters that tell of tables, markup and junk rather than prose.
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A text of so many words has half the weight of a very long one; no weight is below LEAST.
HALF_AT, LEAST = 20.0, 0.05
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight of a document: the share of characters that are no digits or marks, less for short texts."""
    prose = F.length(F.translate(text, MARKS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST), prose * (size / (size + F.lit(HALF_AT))))


def sampling_key(seed_text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), seed_text))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """missing, name, source_size, target: one row per source. Its windows hold one row per source."""
    per = sizes.groupBy("missing", "name").agg(F.sum("size").alias("source_size"))
    alphabetic = Window.partitionBy(F.lit(0)).orderBy("missing", "name")
    turn = F.pmod(F.row_number().over(alphabetic) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("fills_at", F.col("cap") / F.col("weight"))
    filling = Window.partitionBy(F.lit(0)).orderBy("fills_at", "missing", "name")
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    words = F.sum("source_size").over(everything) * percent / F.lit(100)
    # a source is full where the level that it and all later ones would reach is beyond its own
    level = per.withColumn("level", (words - before) / still)
    water = F.max(F.when(F.col("level") < F.col("fills_at"), F.col("level"))).over(everything)
    target = F.when(F.col("level") < F.col("fills_at"), water * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return level.select("missing", "name", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, folder: str, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = 42,
    weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """id, size, source_size, target, taken, epochs (complete ones), weight and key of every document.

    `weight` is any positive column over docs; without one, `quality` of the text. Work tables go to `folder`.
    """
    source = F.col(source_col).cast("string")
    read = docs.select(
        F.col(id_col).alias("id"), source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name"), text_of(text_col).alias("text"),
        word_count(text_of(text_col)).alias("size"), (F.lit(None) if weight is None else weight).cast("double").alias("given"),
    )
    read = read.withColumn("weight", quality(F.col("text"), F.col("size")) if weight is None else F.col("given")).withColumn("digest", F.xxhash64("text"))
    read = read.withColumn("key", sampling_key(F.coalesce(F.col("id").cast("string"), F.md5("text")), F.col("weight"), seed))
    # the row's number only parts equal rows, which are interchangeable
    sizes = written(read.select("id", "missing", "name", "size", "digest", "weight", "key", F.monotonically_increasing_id().alias("row")), folder, "sizes")
    targets = written(source_targets(sizes, weights, percent, most), folder, "targets")
    order = ["key", "id", "digest", "row"]
    ranged = written(sizes.repartitionByRange("missing", "name", *order).withColumn("range", F.spark_partition_id()), folder, "ranges")
    earlier = Window.partitionBy("missing", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("missing", "name", "range").agg(F.sum("size").alias("words")).select(
        "missing", "name", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carried")
    ).join(targets, ["missing", "name"])
    inside = Window.partitionBy("missing", "name", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.withColumn("run", F.sum("size").over(inside)).join(carried, ["missing", "name", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("carried") + F.col("run") - F.col("size"))))
    return run.withColumn("epochs", epochs).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs", "weight", "key"
    )
