"""Reports, history, distributions, vote resolution and exact deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.functions.risk import risk_rank
from lurelens.functions.stages import unpacked
from lurelens.functions.text import blank, flag


def batch_statistics(df: DataFrame, *keys: str) -> DataFrame:
    """``phishing`` 0/1 and ``confidence`` per row."""
    n, bad = F.count("*"), F.count_if(F.col("phishing") == 1)
    return df.groupBy(*keys).agg(
        n.alias("total"), bad.alias("phishing"), (n - bad).alias("legitimate"),
        F.coalesce(bad / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("phishing_ratio"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def prediction_report(df: DataFrame, *keys: str) -> DataFrame:
    """Batch statistics plus range and population deviation; one zero row when there is no input
    and no key."""
    n, bad = F.count("*"), F.count_if(F.col("phishing") == 1)

    def safe(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return df.groupBy(*keys).agg(
        n.alias("total"), bad.alias("phishing"), (n - bad).alias("legitimate"),
        safe(bad / F.nullif(n, F.lit(0))).alias("phishing_ratio"),
        safe(F.avg("confidence")).alias("avg_confidence"), safe(F.min("confidence")).alias("min_confidence"),
        safe(F.max("confidence")).alias("max_confidence"), safe(F.stddev_pop("confidence")).alias("std_confidence"),
    )


def dashboard_tiles(df: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("phishing") == 1).alias("phishing"),
        F.count_if(level == "MEDIUM").alias("suspicious"), F.count_if(level == "LOW").alias("safe"),
    )


def class_distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and share of all rows per key combination."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("share", F.col("rows") / total)


def corpus_statistics(df: DataFrame) -> DataFrame:
    """``token_count`` and ``urls`` per mail. Lengths are few distinct integers, so the exact
    median stays a small map per task."""
    n = F.count("*")
    return df.agg(
        n.alias("mails"),
        F.avg("token_count").alias("avg_length"),
        F.percentile("token_count", F.lit(0.5)).alias("median_length"),
        F.min("token_count").alias("min_length"), F.max("token_count").alias("max_length"),
        (F.count_if(F.col("token_count") < 50) / n).alias("short_share"),
        (F.count_if(F.col("token_count") > 2000) / n).alias("long_share"),
        F.avg(F.size("urls")).alias("avg_urls"),
        (F.count_if(F.size("urls") > 0) / n).alias("with_urls_share"),
    )


def vocabulary_size(tokens: DataFrame) -> DataFrame:
    """Distinct terms of an array column ``tokens``; terms fold map-side and per row first."""
    terms = unpacked(tokens, [], F.array_distinct("tokens"), "_n", "term").groupBy("term").agg(F.count("*").alias("df"))
    return terms.agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings"))


def duplicate_key(*columns: str) -> Column:
    """Digest of the compared fields, with their lengths, so that fields cannot run together."""
    parts = [F.concat(F.length(blank(c)).cast("string"), F.lit(":"), blank(c)) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def exact_duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Per distinct content: the id kept (the first) and the copies. A group of copies folds
    map-side to one row per task, so a third of the corpus in one group is no hot spot."""
    return df.select("id", duplicate_key(*columns).alias("key")).groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")
    ).select("id", "copies")


def drop_duplicates(df: DataFrame, *columns: str) -> DataFrame:
    return df.join(exact_duplicates(df, *columns).select("id"), "id", "left_semi")


def majority_labels(votes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Majority label per id, its share, and whether the share reaches the threshold. Two partial
    aggregates; ties go to the smaller label."""
    counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("label")).alias("neg"))).alias("best")
    out = counts.groupBy("id").agg(best, F.sum("n").alias("votes"))
    share = F.col("best.n") / F.col("votes")
    return out.select(
        "id", (-F.col("best.neg")).alias("label"), share.alias("confidence"), flag(share >= threshold).alias("accepted")
    )


def history_page(df: DataFrame, limit: int, offset: int = 0, keep_hours: int | None = None) -> DataFrame:
    """Newest first. The page is a top-k, so only limit + offset rows per task are moved."""
    if keep_hours is not None:
        newest = df.agg(F.max("ts").alias("t")).scalar()
        df = df.filter(F.col("ts") >= newest - F.make_dt_interval(hours=F.lit(keep_hours)))
    return df.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def search_history(
    df: DataFrame, text: str = "", level: str | None = None, phishing: int | None = None,
    sort: str = "ts", ascending: bool = False, limit: int | None = None,
) -> DataFrame:
    q = text.lower()
    if q:
        df = df.filter(F.lower(blank("subject")).contains(q) | F.lower(blank("from_email")).contains(q))
    if level:
        df = df.filter(F.col("risk_level") == level)
    if phishing is not None:
        df = df.filter(F.col("phishing") == phishing)
    keys = {
        "ts": F.col("ts"), "subject": F.lower(blank("subject")), "sender": F.lower(blank("from_email")),
        "risk_level": risk_rank(F.col("risk_level")),
    }
    by = keys.get(sort, F.col(sort))
    out = df.orderBy(by.asc() if ascending else by.desc(), F.col("id"))
    return out.limit(limit) if limit else out


def high_risk_alerts(df: DataFrame) -> DataFrame:
    """A plain filter: works on batch and stream alike."""
    return df.filter(F.upper("risk_level").isin("CRITICAL", "HIGH"))


def latest_per_scan(events: DataFrame) -> DataFrame:
    """Newest status per scan with its creation time, as one partial aggregate."""
    order = F.struct("ts", "event_id")
    return events.groupBy("scan_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max_by("status", order).alias("status"), F.count("*").alias("updates"),
    )


def status_counts(events: DataFrame, *keys: str) -> DataFrame:
    status = F.col("status")
    return events.groupBy(*keys).agg(
        F.count_if(status == "completed").alias("completed"), F.count_if(status == "queued").alias("queued"),
        F.count_if(~status.isin("completed", "queued")).alias("failed"),
    )
