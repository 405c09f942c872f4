"""Snapshot join queries and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.functions import links as L
from lurelens.functions.text import flag, round6
from lurelens.operators import enrichment as J
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.q_domains import CROSS
from lurelens.plans.q_links import LATEST_URL_REP, _origin_path
from lurelens.plans.q_verdict import FLAG_VIEWS
from lurelens.plans.registry import query

_LEAN = {"m": CROSS["m"], "ud": CROSS["ud"], **FLAG_VIEWS}


@query("mail_dns_flags", s.sql("SELECT id, domains, dns_u AS unresolved_url_domain, dns_s AS unresolved_sender_domain, array_to_string(lost, ',') AS unresolved_domains FROM fl", "email_urls", "dns_records", **_LEAN))
def mail_dns_flags(spark, sf):
    out = J.mail_dns_flags(fx.emails(spark, sf, urls=True, text=False), J.dns_status(fx.dns_records(spark, sf)))
    return out.withColumn("unresolved_domains", F.array_join("unresolved_domains", ","))


_POSTURE = "SELECT domain, " + ", ".join(
    f"coalesce(string_agg(value, ',' ORDER BY value) FILTER (WHERE kind = '{k}'), '') AS {k.lower()}_records" for k in ("A", "AAAA", "MX", "NS", "TXT")
) + ", min(value) FILTER (WHERE kind = 'TXT' AND contains(lower(value), 'v=spf1')) AS spf_record, min(value) FILTER (WHERE kind = 'DMARC' AND contains(lower(value), 'v=dmarc1')) AS dmarc_record FROM (SELECT regexp_replace(domain, '^_dmarc\\.', '') AS domain, CASE WHEN starts_with(domain, '_dmarc.') THEN 'DMARC' ELSE rdtype END AS kind, value FROM dns_records) GROUP BY domain"


@query("dns_posture", s.sql("SELECT *, CAST(spf_record IS NOT NULL AS INT) AS has_spf, CAST(dmarc_record IS NOT NULL AS INT) AS has_dmarc FROM p", "dns_records", p=_POSTURE))
def dns_posture(spark, sf):
    out = J.dns_posture(fx.dns_records(spark, sf))
    return out.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])


@query("dns_summary", s.sql("""
SELECT md.id, count(*) AS total_domains, count(CASE WHEN st = 'resolved' THEN 1 END) AS resolved, count(CASE WHEN st = 'unresolved' THEN 1 END) AS unresolved,
 count(CASE WHEN st = 'timeout' THEN 1 END) AS timed_out, count(CASE WHEN st = 'error' THEN 1 END) AS errors,
 CAST(count(CASE WHEN st = 'resolved' THEN 1 END) = count(*) AS INT) AS all_resolved
FROM (SELECT DISTINCT id, d FROM md WHERE role = 'url') md LEFT JOIN rs ON rs.domain = md.d GROUP BY md.id""", "email_urls", "dns_records", **_LEAN,
    rs="SELECT domain, CASE WHEN m % 5 <> 0 THEN 'resolved' WHEN m % 15 = 5 THEN 'timeout' WHEN m % 15 = 10 THEN 'error' ELSE 'unresolved' END AS st FROM url_hosts"))
def dns_summary(spark, sf):
    rows = J.mail_domains(fx.emails(spark, sf, urls=True, text=False)).filter("role = 'url'")
    return J.dns_summary(J.left_on_key(rows, fx.dns_results(spark, sf), "domain"), "id")


@query("reputation_states", s.sql("""SELECT u.id, CAST(u.pos AS INT) AS pos, CASE WHEN r.status IS NULL THEN 'skipped' WHEN r.status = 'rate_limited' THEN 'unknown' ELSE 'known' END AS state, r.malicious, r.suspicious
FROM email_urls u LEFT JOIN r ON r.key = lower(u.url)""", "email_urls", "reputation", r=LATEST_URL_REP.format(kind="url")))
def reputation_states(spark, sf):
    urls = fx.email_urls(spark, sf).withColumn("key", F.lower("url"))
    rows = J.left_on_key(urls, J.latest_reputation(fx.reputation(spark, sf, "url")), "key")
    return rows.select("id", "pos", J.reputation_state().alias("state"), "malicious", "suspicious")


_PTS = "coalesce(least(60, {m} * 20) + least(30, {p} * 10), 0)"
_RISK = {
    "p": _POSTURE,
    "dr": f"SELECT key, CASE WHEN status <> 'rate_limited' THEN malicious END AS dm, CASE WHEN status <> 'rate_limited' THEN suspicious END AS dp FROM ({LATEST_URL_REP.format(kind='domain')})",
    "ur": f"SELECT key, CASE WHEN status <> 'rate_limited' THEN malicious END AS um, CASE WHEN status <> 'rate_limited' THEN suspicious END AS up FROM ({LATEST_URL_REP.format(kind='url')})",
    "er": f"""SELECT id, pos, dom AS domain, a_ok AS resolves, um, up, CAST(least(100, CASE WHEN a_ok THEN 0 ELSE 30 END + CASE WHEN coalesce(ns_records, '') = '' THEN 10 ELSE 0 END
 + CASE WHEN coalesce(mx_records, '') = '' THEN 5 ELSE 0 END + CASE WHEN spf_record IS NULL THEN 5 ELSE 0 END + CASE WHEN dmarc_record IS NULL THEN 5 ELSE 0 END
 + {_PTS.format(m='dm', p='dp')} + {_PTS.format(m='um', p='up')}) AS INT) AS risk_score
 FROM (SELECT e.id, e.pos, e.dom, p.*, coalesce(p.a_records, '') <> '' OR coalesce(p.aaaa_records, '') <> '' AS a_ok, dr.dm, dr.dp, ur.um, ur.up
  FROM (SELECT id, pos, lower(url) AS uk, {s.lenient_host('url')} AS dom FROM email_urls) e LEFT JOIN p ON p.domain = e.dom LEFT JOIN dr ON dr.key = e.dom LEFT JOIN ur ON ur.key = e.uk)""",
}


def _external(spark, sf):
    return J.external_risk(
        fx.email_urls(spark, sf), fx.dns_records(spark, sf), fx.reputation(spark, sf, "domain"), fx.reputation(spark, sf, "url"))


@query("external_risk", s.sql(f"SELECT id, CAST(pos AS INT) AS pos, domain, risk_score, {s.ladder('risk_score', 'external')} AS risk_label FROM er", "email_urls", "dns_records", "reputation", **_RISK))
def external_risk(spark, sf):
    return _external(spark, sf).select("id", "pos", "domain", "risk_score", "risk_label")


@query("scan_rollup__max", s.sql(f"SELECT id, count(*) AS urls, max(risk_score) AS external_risk_score, {s.ladder('max(risk_score)', 'external')} AS risk_label FROM er GROUP BY id", "email_urls", "dns_records", "reputation", **_RISK))
def scan_rollup_max(spark, sf):
    return J.scan_rollup(_external(spark, sf))


_SUM = "CAST(least(100, sum(CASE WHEN NOT resolves THEN 30 ELSE 0 END + CASE WHEN um > 0 THEN 50 ELSE 0 END + CASE WHEN up > 0 THEN 20 ELSE 0 END)) AS BIGINT)"


@query("scan_rollup__sum", s.sql(f"SELECT id, {_SUM} AS risk_score, {s.ladder(_SUM, 'popup')} AS risk_label FROM er GROUP BY id", "email_urls", "dns_records", "reputation", **_RISK))
def scan_rollup_sum(spark, sf):
    return J.scan_rollup_sum(_external(spark, sf))


@query("scan_outcomes", s.sql("""SELECT page_id, CASE WHEN page_id % 4 <> 0 AND page_id % 8 <> 1 THEN 'queued' ELSE 'failed' END AS submit_status,
 CASE WHEN page_id % 10 = 0 THEN 'failed' WHEN page_id % 6 = 0 THEN 'rate_limited' WHEN page_id % 6 = 1 THEN 'failed' WHEN page_id % 5 = 2 THEN 'queued' WHEN page_id % 5 = 3 THEN 'unknown' ELSE 'completed' END AS poll_status FROM pages"""))
def scan_outcomes(spark, sf):
    k = F.col("page_id")
    rows = fx.table(spark, sf, "pages").select(
        "page_id", (k % 4 != 0).alias("submitted"), F.when(k % 8 != 1, F.concat(F.lit("a"), k)).otherwise("").alias("analysis_id"),
        (k % 10 == 0).alias("skipped"), F.when(k % 6 == 0, "rate_limit").when(k % 6 == 1, "http_500").alias("error"),
        F.when(k % 5 == 2, "queued").when(k % 5 != 3, "completed").alias("provider_status"))
    return rows.select("page_id", J.submit_outcome().alias("submit_status"), J.poll_outcome().alias("poll_status"))


def raw_analyses(spark, sf):
    """Provider answers as JSON text, one per page URL."""
    k = F.col("page_id")
    names = F.array(*[F.lit(f"Engine{i:02d}") for i in range(14)])
    kinds = F.array(*[F.lit(x) for x in ("malicious", "suspicious", "harmless", "undetected")])
    results = F.map_from_arrays(
        names,
        F.transform(names, lambda n, i: F.struct(
            F.element_at(kinds, ((k + i) % F.when(k % 2 == 0, 2).otherwise(4) + 1).cast("int")).alias("category"), n.alias("engine_name"))))
    stats = F.struct((k % 7).alias("malicious"), (k % 9).alias("suspicious"), F.lit(60).alias("harmless"), F.lit(5).alias("undetected"), F.lit(1).alias("timeout"))
    status = F.when(k % 3 == 0, "queued").otherwise("completed")
    start = F.lit(fx.OBSERVED).cast("timestamp_ntz")
    return fx.table(spark, sf, "pages").select(
        "page_id", "url", F.to_json(F.struct(status.alias("status"), stats.alias("stats"), results.alias("last_analysis_results"))).alias("raw"),
        start.alias("queued_at"), (start + F.make_dt_interval(secs=k.cast("decimal(18,6)") * F.lit("1.5").cast("decimal(18,6)"))).alias("completed_at"))


_ST = "CASE WHEN page_id % 3 = 0 THEN 'queued' ELSE 'completed' END"


@query("analysis_normalized", s.sql(f"""
SELECT page_id, {_ST} AS status, split_part(string_split(url, '://')[-1], '/', 1) AS domain, CAST(page_id * 1500 AS BIGINT) AS queue_time_ms, page_id % 7 AS malicious, page_id % 9 AS suspicious,
 CASE WHEN {_ST} = 'queued' THEN 'UNKNOWN' WHEN page_id % 7 >= 5 OR page_id % 9 >= 8 THEN 'CRITICAL' WHEN page_id % 7 >= 2 OR page_id % 9 >= 4 THEN 'HIGH' WHEN page_id % 7 >= 1 OR page_id % 9 >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN {_ST} = 'completed' THEN array_to_string(list_transform(list_filter(range(14), lambda i: (page_id + i) % (CASE WHEN page_id % 2 = 0 THEN 2 ELSE 4 END) < 2)[1:10], lambda i: printf('Engine%02d', i)), ',') ELSE '' END AS flagged_engines,
 translate(rtrim(base64(encode(url)), '='), '+/', '-_') AS url_key FROM pages"""))
def analysis_normalized(spark, sf):
    out = J.normalize_analysis(raw_analyses(spark, sf), "page_id")
    return out.select("page_id", "status", "domain", "queue_time_ms", "malicious", "suspicious", "risk_level", F.array_join("flagged_engines", ",").alias("flagged_engines"), "url_key")


@query("mail_reputation", s.sql(f"""SELECT u.id, count(*) AS urls_checked, CAST(coalesce(bool_or(r.malicious > 0 OR r.suspicious > 3), false) AS INT) AS malicious_detected,
 {s.r6('coalesce(max(least(1e0, 2e0 * (r.malicious + 5e-1 * r.suspicious) / (r.malicious + r.suspicious + r.harmless + r.undetected))), 0e0)')} AS max_risk_score
FROM email_urls u LEFT JOIN r ON r.key = lower(u.url) GROUP BY u.id""", "email_urls", "reputation", r=LATEST_URL_REP.format(kind="url")))
def mail_reputation(spark, sf):
    out = J.mail_reputation(fx.email_urls(spark, sf), fx.reputation(spark, sf, "url"))
    return out.withColumn("max_risk_score", round6(F.col("max_risk_score")))


_BL = f"SELECT lower({_origin_path('url')}) AS key FROM pages WHERE page_id % 10 = 0 UNION SELECT {s.host('url')} FROM pages WHERE page_id % 7 = 0"


@query("blocklist_hits", s.sql(f"SELECT id, CAST(pos AS INT) AS pos, url, CAST(lower({_origin_path('url')}) IN (SELECT key FROM b) OR {s.host('url')} IN (SELECT key FROM b) AS INT) AS listed FROM email_urls", "email_urls", b=_BL))
def blocklist_hits(spark, sf):
    out = J.blocklist_hits(fx.email_urls(spark, sf), fx.blocklist(spark, sf))
    return out.select("id", "pos", "url", F.coalesce("listed", F.lit(0)).alias("listed"))


@query("mails_without_listed_urls", s.sql(f"SELECT id FROM emails WHERE id NOT IN (SELECT id FROM email_urls WHERE lower({_origin_path('url')}) IN (SELECT key FROM b) OR {s.host('url')} IN (SELECT key FROM b))", "email_urls", b=_BL))
def mails_without_listed_urls(spark, sf):
    hits = J.blocklist_hits(fx.email_urls(spark, sf), fx.blocklist(spark, sf)).filter("listed = 1")
    return fx.emails(spark, sf, text=False).select("id").join(hits.select("id"), "id", "left_anti")


@query("cached_reputation_as_of", s.sql("""
SELECT id, CAST(pos AS INT) AS pos, CASE WHEN seen IS NULL THEN 'miss' WHEN ok THEN 'hit' ELSE 'expired' END AS cache, CASE WHEN ok THEN mal END AS malicious FROM (
 SELECT *, seen + CASE WHEN st = 'completed' THEN INTERVAL 24 HOURS ELSE INTERVAL 1 HOUR END >= ts AS ok FROM (
  SELECT q.id, q.pos, q.ts, max(r.observed_at) AS seen, arg_max(r.status, r.observed_at) AS st, arg_max(r.malicious, r.observed_at) AS mal
  FROM q LEFT JOIN reputation r ON r.kind = 'url' AND r.key = lower(q.url) AND r.observed_at <= q.ts GROUP BY ALL))""",
    "email_urls", "reputation", q="SELECT u.id, u.pos, u.url, e.ts FROM email_urls u JOIN emails e ON e.id = u.id"))
def cached_reputation_as_of(spark, sf):
    asked = fx.emails(spark, sf, urls=True, ts=True, text=False).select("id", "ts", F.posexplode("urls").alias("pos", "url"))
    return J.cached_as_of(asked, fx.reputation(spark, sf, "url")).drop("url")
