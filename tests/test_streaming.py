"""Streams run to completion and agree with what batch says."""

import datetime as dt
import time

from pyspark.sql import functions as F

from lurelens.sources import mail as M
from lurelens.streaming import jobs as S


def _write(spark, rows, path, name):
    schema = "scan_id long, event_id long, status string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _t(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_lifecycle_expires_quiet_scans(spark, tmp_path):
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "scan_id long, event_id long, status string, ts timestamp"
    _write(spark, [(1, 1, "queued", _t(0)), (1, 2, "running", _t(5))], src, "a")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    states = S.scan_lifecycle(stream, expiry_hours=2)
    S.run_available(states, work, "update")
    _write(spark, [(2, 3, "queued", _t(300))], src, "b")
    _write(spark, [(2, 4, "completed", _t(301))], src, "c")
    rows, _ = S.run_available(states, work, "update")
    got = rows.collect()
    assert {(r.scan_id, r.status, r.expired) for r in got} >= {(1, "running", False), (1, "running", True), (2, "completed", False)}
    assert S.newest_batch(rows.filter("scan_id = 2").drop("expired"), "scan_id").first().updates == 2


def test_lives_follow_gaps_across_batches(spark, tmp_path):
    """Out-of-order rows, gaps inside one batch and over batches, keeping times by status."""
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "scan_id long, event_id long, status string, ts timestamp"
    _write(spark, [(1, 3, "completed", _t(200)), (1, 1, "queued", _t(0)), (1, 2, "running", _t(30)), (2, 9, "queued", _t(10))], src, "a")
    own = S.with_state_store(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == own.conf.get("spark.sql.shuffle.partitions")
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    states = S.scan_lifecycle(stream, expiry_hours=1, by_status={"completed": 24})
    S.run_available(states, work, "update")
    _write(spark, [(1, 4, "running", _t(200 + 24 * 60)), (1, 5, "queued", _t(200 + 24 * 60 + 60)), (1, 6, "queued", _t(200 + 24 * 60 + 121))], src, "b")
    rows, _ = S.run_available(states, work, "update")
    lives = {(r.scan_id, r.created_us // 60_000_000 - 28401120): (r.status, r.updates, r.expired) for r in S.newest_batch(rows, "scan_id", "life_us").collect()}
    zero = min(m for k, m in lives if k == 1)
    lives = {(k, m - zero): v for (k, m), v in lives.items()}
    assert lives == {(1, 0): ("running", 2, True), (1, 200): ("queued", 3, True), (1, 1761): ("queued", 1, False), (2, 10): ("queued", 1, True)}


def test_state_store_forgets_after_the_time_to_live(spark, tmp_path):
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "scan_id long, event_id long, status string, ts timestamp"
    own = S.with_state_store(spark, idle_batches=False)

    def more(event_id, keep):
        _write(spark, [(1, event_id, f"s{event_id}", _t(event_id))], src, "x")
        rows, _ = S.run_available(S.remembered_status(own.readStream.schema(schema).parquet(src), keep), work, "update")
        return max((r.batch, r.status, r.updates, r.remembered) for r in rows.collect())[1:]

    assert more(1, 3600) == ("s1", 1, False) and more(2, 3600) == ("s2", 2, True)
    work = str(tmp_path / "short")
    assert more(3, 1)[1:] == (3, False)
    time.sleep(1.5)
    assert more(4, 1) == ("s4", 1, False)


def test_repeats_and_late_rows_are_dropped(spark, tmp_path):
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "scan_id long, event_id long, status string, ts timestamp"
    _write(spark, [(1, 1, "queued", _t(0)), (1, 1, "queued", _t(1)), (9, 9, "queued", _t(500))], src, "a")
    stream = spark.readStream.schema(schema).parquet(src)
    job = S.once_per_message(stream, "event_id")
    S.run_available(job, work)
    _write(spark, [(7, 7, "queued", _t(2)), (8, 8, "queued", _t(499))], src, "b")
    rows, query = S.run_available(job, work)
    assert sorted(r.event_id for r in rows.collect()) == [1, 8, 9]
    assert S.late_rows(query) == 1


def test_mail_stream_is_scored(spark, tmp_path):
    src = tmp_path / "mails"
    src.mkdir()
    (src / "a.json").write_text('{"id": "1", "subject": "Urgent: verify now", "from": "a@paypa1-x.com", "body": "click", "urls": ["https://bit.ly/x"]}\n{bad\n')
    mails = M.stream_json_lines(spark, str(src)).withColumn("reply_to", F.lit(None).cast("string"))
    scored = S.score_arriving(mails).select("id", "risk_level", "probability")
    rows, _ = S.run_available(scored, str(tmp_path / "work"))
    assert [(r.id, r.risk_level) for r in rows.collect()] == [("1", "CRITICAL")]
    assert S.alerts(rows).count() == 1


def test_bad_lines_are_kept_as_a_stream(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    (src / "a.jsonl").write_text('{"id": "1"}\n{broken\n')
    bad, _ = S.run_available(M.stream_json_quarantine(spark, str(src)), str(tmp_path / "work"))
    assert [r.value for r in bad.collect()] == ["{broken"]


def test_every_batch_reads_the_newest_finished_snapshot(spark, tmp_path):
    src, dns, work = tmp_path / "mails", str(tmp_path / "dns"), str(tmp_path / "work")
    src.mkdir()

    def arrive(n):
        (src / f"{n}.json").write_text(f'{{"id": "{n}", "subject": "hello", "from_email": "a@known.example", "body": "text", "urls": ["https://known.example/x"]}}\n')

    def run():
        rows, _ = S.run_available(M.stream_json_lines(spark, str(src)), work, transform=score)
        return {r.id: r.unresolved_sender_domain for r in rows.collect()}

    def records(kind):
        return spark.createDataFrame([("known.example", kind, "198.51.100.1")], "domain string, rdtype string, value string")

    score = S.score_with_dns(dns)
    S.write_snapshot(records("MX"), dns, 1)
    arrive(1)
    assert run() == {"1": 1}
    S.write_snapshot(records("A"), dns, 2)
    (tmp_path / "dns" / "version=3").mkdir()  # begun, never finished
    arrive(2)
    assert run() == {"1": 1, "2": 0}


def test_tables_stream_from_a_file_and_from_a_folder(spark, tmp_path):
    """A table of several files is a folder; its files do not bear the table's name."""
    rows = spark.range(20).selectExpr("id", "cast(id as string) AS text")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "single/documents.parquet")
    rows.limit(3).write.parquet(str(tmp_path / "single/other"))
    for place in (tmp_path, tmp_path / "single"):
        got, _ = S.run_available(S.stream_table(spark, str(place), "documents"), str(tmp_path / f"work-{place.name}"))
        assert sorted(r.id for r in got.collect()) == list(range(20))
