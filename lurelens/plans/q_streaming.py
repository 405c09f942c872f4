"""Streaming queries run to completion over the given tables; twins are their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.functions.text import round6
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.q_verdict import _FULL, API_P, OP_VIEWS
from lurelens.plans.q_domains import TRUST_VIEWS
from lurelens.plans.registry import query
from lurelens.session import work_folder
from lurelens.streaming import jobs as S


def _events(spark, sf):
    rows = S.stream_table(spark, sf, "events")
    return rows.select(F.col("user_id").alias("scan_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), fx.scan_status().alias("status"), "value")


@query("stream__running_counts", s.sql("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, status, count(*) AS rows FROM scan_events GROUP BY 1, 2", "scan_events"))
def stream_running_counts(spark, sf):
    rows, _ = S.run_available(S.running_counts(_events(spark, sf), "status"), work_folder(spark), "update")
    return S.newest_batch(rows, "window_start", "status").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream__latest_status", s.sql("SELECT scan_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(status, (ts, event_id)) AS status, count(*) AS updates FROM scan_events GROUP BY scan_id", "scan_events"))
def stream_latest_status(spark, sf):
    rows, _ = S.run_available(S.latest_status(_events(spark, sf)), work_folder(spark), "update")
    out = S.newest_batch(rows, "scan_id")
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def _lives(keep: str) -> dict[str, str]:
    """Islands of events without a gap beyond the keeping time of the status before the gap."""
    return {
        "ev": "SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS before_us, lag(status) OVER w AS before FROM scan_events WINDOW w AS (PARTITION BY scan_id ORDER BY ts, event_id)",
        "li": f"SELECT *, sum(CASE WHEN before_us IS NULL OR us - before_us > {keep.format(status='before')} THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY ts, event_id) AS life FROM ev",
        "lv": "SELECT scan_id, life, arg_max(status, (ts, event_id)) AS status, min(us) AS created_us, max(us) AS updated_us, count(*) AS updates FROM li GROUP BY scan_id, life",
        "lx": f"SELECT *, CAST(life < max(life) OVER (PARTITION BY scan_id) OR (updated_us + {keep.format(status='status')}) // 1000 < (SELECT max(us) // 1000 - 600000 FROM ev) AS INT) AS expired FROM lv",
    }


_SCAN_KEEP = "7200000000"
_CACHE_KEEP = "CASE WHEN {status} = 'completed' THEN 86400000000 ELSE 3600000000 END"


def _run_lives(spark, sf, **keep):
    own = S.with_state_store(spark)
    rows, _ = S.run_available(S.scan_lifecycle(_events(own, sf), **keep), work_folder(spark), "update")
    return S.newest_batch(rows, "scan_id", "life_us").withColumn("expired", F.col("expired").cast("int"))


@query("stream__scan_expiry", s.sql("SELECT scan_id, status, created_us, updated_us, updates, expired FROM lx", "scan_events", **_lives(_SCAN_KEEP)))
def stream_scan_expiry(spark, sf):
    """Every life of a scan: it ends when nothing came for two hours."""
    return _run_lives(spark, sf).drop("life_us")


@query("stream__cache_expiry", s.sql("SELECT scan_id, status, created_us, updated_us, updates, expired FROM lx", "scan_events", **_lives(_CACHE_KEEP)))
def stream_cache_expiry(spark, sf):
    """Cached results: completed ones are kept for a day, others for an hour."""
    return _run_lives(spark, sf, expiry_hours=1, by_status={"completed": 24}).drop("life_us")


@query("stream__scan_lifecycle", s.sql("SELECT scan_id, status, created_us, updated_us, updates, expired FROM lx QUALIFY life = max(life) OVER (PARTITION BY scan_id)", "scan_events", **_lives(_SCAN_KEEP)))
def stream_scan_lifecycle(spark, sf):
    """The newest life of every scan under the declared expiry."""
    values = F.struct("created_us", "status", "updated_us", "updates", "expired")
    return _run_lives(spark, sf).groupBy("scan_id").agg(F.max_by(values, "life_us").alias("v")).select("scan_id", "v.*")


@query("stream__unexpired_history", s.sql("SELECT event_id, scan_id, status FROM scan_events WHERE ts >= (SELECT max(ts) FROM scan_events) - INTERVAL 1 HOUR", "scan_events"))
def stream_unexpired_history(spark, sf):
    """What the history still keeps, an hour, after the newest event of the batch."""
    rows, _ = S.run_available(_events(spark, sf), work_folder(spark), transform=lambda batch: S.unexpired(batch, batch.agg(F.max("ts")).scalar()))
    return rows.select("event_id", "scan_id", "status")


@query("stream__once_per_message", s.sql("SELECT DISTINCT event_id, user_id FROM events"))
def stream_once_per_message(spark, sf):
    """Every message is sent twice; one of each pair remains."""
    rows = S.stream_table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    out, _ = S.run_available(S.once_per_message(twice, "event_id"), work_folder(spark))
    return out.select("event_id", "user_id")


_SCORED = {**OP_VIEWS, **TRUST_VIEWS,
    "v1": f"SELECT f.id, {API_P} AS h, trust.trust_score, trust.n_imp FROM f JOIN trust ON trust.id = f.id",
    "v2": "SELECT *, CASE WHEN trust_score > 3e-1 AND n_imp = 0 THEN greatest(0e0, h - least(1.5e-1, trust_score * 2.5e-1)) WHEN n_imp > 0 THEN least(1e0, h + 2e-1) ELSE h END AS p FROM v1",
    "v3": f"SELECT id, {s.r6('p')} AS probability, CASE WHEN n_imp > 0 THEN 'CRITICAL' ELSE {s.ladder('p', 'operational')} END AS risk_level FROM v2"}


def _mail_stream(spark, sf):
    return fx.emails(spark, sf, urls=True, documents=S.stream_table(spark, sf, "documents"))


@query("stream__scored_mails", s.sql("SELECT * FROM v3", "email_urls", "trusted", "brands", **_SCORED))
def stream_scored_mails(spark, sf):
    scored = S.score_arriving(_mail_stream(spark, sf)).select("id", round6(F.col("probability")).alias("probability"), "risk_level")
    return S.run_available(scored, work_folder(spark))[0].drop("batch")


@query("stream__alerts", s.sql("SELECT id, risk_level FROM v3 WHERE risk_level IN ('CRITICAL', 'HIGH')", "email_urls", "trusted", "brands", **_SCORED))
def stream_alerts(spark, sf):
    scored = S.score_arriving(_mail_stream(spark, sf)).select("id", "risk_level")
    return S.run_available(S.alerts(scored), work_folder(spark))[0].drop("batch")


@query("stream__verdicts", s.sql(f"SELECT id, {s.r6('p')} AS probability, CAST(phish AS INT) AS phishing, risk_level, array_to_string(reasoning, ' | ') AS reasoning FROM v3", "email_urls", "trusted", "brands", "dns_records", **_FULL))
def stream_verdicts(spark, sf):
    """Arriving mails against a versioned DNS snapshot; an older version says that nothing resolves."""
    folder = work_folder(spark)
    records = fx.dns_records(spark, sf)
    S.write_snapshot(records.withColumn("rdtype", F.lit("TXT")), f"{folder}/dns", 1)
    S.write_snapshot(records, f"{folder}/dns", 2)
    score = S.score_with_dns(f"{folder}/dns")
    columns = ["id", round6(F.col("probability")).alias("probability"), "phishing", "risk_level", F.array_join("reasoning", " | ").alias("reasoning")]
    return S.run_available(_mail_stream(spark, sf), f"{folder}/out", transform=lambda batch: score(batch).select(columns))[0].drop("batch")
