"""Streaming forms of the jobs. Late data policy: rows older than the watermark are dropped, and the
number dropped is read from the query progress (``late_rows``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lurelens.operators import enrichment
from lurelens.operators.analytics import high_risk_alerts
from lurelens.plans import scoring

EXPIRY = {"message": "30 minutes", "history": "1 hour", "scan": "2 hours"}


def once_per_message(mails: DataFrame, id_col: str = "id", ts: str = "ts", within: str = EXPIRY["message"]) -> DataFrame:
    """Each message once; a repeat is recognised for ``within`` after its first arrival."""
    return mails.withWatermark(ts, within).dropDuplicatesWithinWatermark([id_col])


def running_counts(events: DataFrame, *keys: str, ts: str = "ts", width: str = "1 hour", late: str = EXPIRY["scan"]) -> DataFrame:
    """Event-time counts per window and key; counts fold map-side before the state store."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("rows"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "rows")


def latest_status(events: DataFrame, ts: str = "ts", late: str = EXPIRY["scan"]) -> DataFrame:
    """Newest status per scan as a streaming aggregate (update mode)."""
    order = F.struct(ts, "event_id")
    return events.withWatermark(ts, late).groupBy("scan_id").agg(
        F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.max_by("status", order).alias("status"),
        F.count("*").alias("updates"),
    )


LIFECYCLE = "scan_id bigint, life_us bigint, status string, created_us bigint, updated_us bigint, updates bigint, expired boolean"
_STATE = "life_us bigint, status string, created_us bigint, updated_us bigint, event_id bigint, updates bigint"
_HOUR_US = 3_600_000_000


class _Lifecycle(StatefulProcessor):
    """Constant-size state per scan: newest status, first and last time, number of updates.

    A scan that was quiet for longer than its status may be kept has expired: by a later event, which
    opens a new life, or by an event-time timer once the watermark has passed. A row so far before the
    open life that it can't belong to it is a life of its own.
    """

    def __init__(self, keep_hours: float, by_status: dict[str, float]) -> None:
        self.keep_us = int(keep_hours * _HOUR_US)
        self.by_status = {status: int(hours * _HOUR_US) for status, hours in by_status.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", _STATE)

    def _keep(self, status: str) -> int:
        return self.by_status.get(status, self.keep_us)

    def _rows(self, key, lives: list[tuple[tuple, bool]]) -> pd.DataFrame:
        return pd.DataFrame(
            [(key[0], life, status, created, updated, updates, gone) for (life, status, created, updated, _, updates), gone in lives],
            columns=["scan_id", "life_us", "status", "created_us", "updated_us", "updates", "expired"],
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(r for batch in rows for r in zip(batch["ts_us"].tolist(), batch["event_id"].tolist(), batch["status"].tolist()))
        now = tuple(self.scan.get()) if self.scan.exists() else None
        closed = []
        for ts, event_id, status in arrived:
            fresh = (ts, status, ts, ts, event_id, 1)
            if now is None:
                now = fresh
                continue
            life, newest, created, updated, last_id, updates = now
            if ts > updated + self._keep(newest):
                closed.append((now, True))
                now = fresh
            elif ts < created - self._keep(status):
                closed.append((fresh, True))
            elif (ts, event_id) > (updated, last_id):
                now = (life, status, created, ts, event_id, updates + 1)
            else:
                now = (life, newest, min(created, ts), updated, last_id, updates + 1)
        if now is not None:
            self.scan.update(now)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((now[3] + self._keep(now[1])) // 1000)
            closed.append((now, False))
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.scan.exists():
            now = tuple(self.scan.get())
            self.scan.clear()
            yield self._rows(key, [(now, True)])

    def close(self) -> None:
        pass


def scan_lifecycle(
    events: DataFrame, expiry_hours: float = 2, ts: str = "ts", late: str = "10 minutes", by_status: dict[str, float] | None = None
) -> DataFrame:
    """Lives of scans with expiry: every change of a life is a row, ``life_us`` names the life.

    ``by_status`` gives some statuses their own keeping time, as for cached look-ups. Needs the RocksDB
    state store provider (see ``with_state_store``).
    """
    rows = events.withWatermark(ts, late).select(
        "scan_id", "event_id", "status", F.unix_micros(F.col(ts)).alias("ts_us"), F.col(ts)
    )
    return rows.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(expiry_hours, by_status or {}), outputStructType=LIFECYCLE,
        outputMode="Update", timeMode="EventTime",
    )


class _Remembered(StatefulProcessor):
    """Newest status per scan, which the state store itself forgets after the time to live."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "status string, updates bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(r for batch in rows for r in zip(batch["ts"].tolist(), batch["event_id"].tolist(), batch["status"].tolist()))
        known = self.seen.get()[1] if self.seen.exists() else 0
        state = (arrived[-1][2], known + len(arrived))
        self.seen.update(state)
        yield pd.DataFrame({"scan_id": [key[0]], "status": [state[0]], "updates": [state[1]], "remembered": [known > 0]})

    def close(self) -> None:
        pass


def remembered_status(events: DataFrame, keep_seconds: float = 3600) -> DataFrame:
    """Newest status per scan with a count that starts anew once nothing came for the time to live.
    The time is the cluster's clock, so it suits live caches, not the replay of old events."""
    return events.select("scan_id", "event_id", "status", "ts").groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_Remembered(int(keep_seconds * 1000)),
        outputStructType="scan_id bigint, status string, updates bigint, remembered boolean",
        outputMode="Update", timeMode="ProcessingTime",
    )


def with_state_store(spark: SparkSession, idle_batches: bool = True) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB; the caller's settings stay as they are.

    Event-time timers need batches without data; a stream on the cluster's clock that is to stop once
    all is read must do without, as it would ask for the next one for ever.
    """
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    return own


def score_arriving(mails: DataFrame) -> DataFrame:
    """Features and verdict of arriving mails; a projection, so it adds no state."""
    return scoring.score_stateless(mails)


def write_snapshot(records: DataFrame, folder: str, version: int) -> None:
    """One version of a snapshot, whole before anyone reads it: it gets its number's name as a folder."""
    records.write.mode("errorifexists").parquet(f"{folder}/version={version}")


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest finished version; only its folder is read. A version without a success mark is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in system.listStatus(path)]
    done = [int(n.partition("=")[2]) for n in names if n.startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    if not done:
        raise ValueError(f"no finished version of the snapshot in {folder}")
    return spark.read.parquet(f"{folder}/version={max(done)}")


def score_with_dns(folder: str) -> Callable[[DataFrame], DataFrame]:
    """Verdict of a micro-batch of mails with the DNS snapshot that is newest when the batch starts: the batch
    verdict as it is, look-ups and reasons included. For ``run_available``; the scoring itself keeps no state."""

    def score(batch: DataFrame) -> DataFrame:
        records = newest_snapshot(batch.sparkSession, folder)
        return scoring.score_mails(batch, enrichment.dns_status(records))

    return score


def unexpired(rows: DataFrame, now: Column, ts: str = "ts", hours: int = 1) -> DataFrame:
    """Rows that are still within their keeping time at ``now``."""
    return rows.filter(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))


def alerts(scored: DataFrame) -> DataFrame:
    return high_risk_alerts(scored)


# -- running ---------------------------------------------------------------------------
def run_available(
    stream: DataFrame, work: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Processes what is there and stops. Every micro-batch is written to its own folder, replaced as
    a whole when the batch is repeated after a failure, so nothing is doubled."""
    out = f"{work}/rows"
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out), query


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark so far."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def newest_batch(rows: DataFrame, *keys: str) -> DataFrame:
    """Last written version per key of an update-mode result."""
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, a single file or a folder of files, as a file stream with its fixed schema."""
    whole = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(whole).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(whole)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
