"""Hot keys and crowded scores spread over tasks, and results stay the same."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from lurelens.functions import ranking as R
from lurelens.operators import enrichment as J
from lurelens.operators import evaluation as V


@pytest.fixture
def plain_shuffles(spark):
    """Shuffles as planned: neither merged nor split at run time, and no broadcast."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_half_of_all_rows_on_one_key(spark, plain_shuffles):
    n = 60_000
    key = F.when(F.col("id") % 2 == 0, "hot.example").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("d"), F.col("id") % 5000))
    left = spark.range(n).select("id", key.alias("domain"))
    right = spark.range(6000).select(F.concat(F.lit("d"), F.col("id")).alias("domain"), F.col("id").alias("value")).unionByName(
        spark.createDataFrame([("hot.example", -1)], "domain string, value long"))
    salts = {r.domain: r._salts for r in J.hot_salts(left, "domain").collect()}
    assert salts["hot.example"] == max(salts.values()) and len(salts) <= J.HOT_KEYS
    out = J.left_on_key(left, right, "domain")
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) == 16 and max(tasks) <= 2 * median(tasks)
    plain = left.join(right, "domain", "left").select(out.columns)
    assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0


def test_join_without_hot_keys_and_of_nothing(spark):
    left = spark.range(100).select("id", F.col("id").cast("string").alias("domain"))
    right = left.select("domain", F.col("id").alias("value"))
    assert J.left_on_key(left, right, "domain").filter("value = id").count() == 100
    assert J.left_on_key(left.filter("false"), right, "domain").count() == 0
    assert J.left_on_key(left, right.filter("false"), "domain").filter("value IS NULL").count() == 100


def test_scores_crowded_at_both_ends(spark):
    """All scores within 1e-4 of 0 or 1: no bucket holds many, and areas equal those of all pairs."""
    n = 20_000
    noise = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0) * 1e-4
    label = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).cast("int")
    rows = spark.range(n).select("id", label.alias("label"))
    high = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < F.when(F.col("label") == 1, 8).otherwise(3)
    rows = rows.select("*", F.when(high, 1 - noise).otherwise(noise).alias("probability"), F.lit("m").alias("model"))
    buckets = [r["count"] for r in V.bucketed_totals(rows, "model").groupBy("bucket").count().collect()]
    assert len(buckets) > 500 and max(buckets) <= 4 * n / R.EDGES
    tied = {}
    for r in rows.collect():
        tied.setdefault(r.probability, [0, 0])[r.label] += 1
    below, wins = 0, 0.0
    for _, (neg, pos) in sorted(tied.items()):
        wins += pos * (below + neg / 2)
        below += neg
    want = wins / (below * (n - below))
    assert abs(V.roc_auc(rows, "model").first().roc_auc - want) < 1e-12
    assert abs(V.curve_areas(rows, "model").first().roc_auc - want) < 1e-9


def test_edges_cut_odd_scores(spark):
    for scores in ([], [0.5], [0.5] * 10, [None, 0.1, 0.1, 0.9], [0.0, 1.0]):
        df = spark.createDataFrame([(s,) for s in scores], "probability double")
        got = df.select("probability", R.quantile_bucket(F.col("probability"), R.quantile_edges(df, "probability")).alias("b")).dropna().collect()
        order = sorted(got, key=lambda r: r.probability)
        assert [r.b for r in order] == sorted(r.b for r in order) and len({r.b for r in got}) <= len(set(scores))
