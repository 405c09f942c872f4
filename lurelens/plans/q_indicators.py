"""Indicator, header and forensic queries with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.text import round6
from lurelens.operators import indicators as I
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.q_links import _class
from lurelens.plans.registry import query

_ADDR = f"list_distinct(list_transform(regexp_extract_all(body, {s.lit(rules.ADDRESS_PATTERN)}), lambda a: lower(a)))"
_P1, _P2 = "CAST(split_part(ip, '.', 1) AS INT)", "CAST(split_part(ip, '.', 2) AS INT)"
_PRIV = f"({_P1} IN (10, 127) OR ({_P1} = 172 AND {_P2} BETWEEN 16 AND 31) OR ({_P1} = 192 AND {_P2} = 168))"
_IPS = f"list_filter(list_distinct(regexp_extract_all(body, {s.lit(rules.IPV4_PATTERN)})), lambda ip: NOT {_PRIV})"
_IOC = {"x": f"SELECT id, body, {_ADDR} AS ads, {_IPS} AS ips FROM emails"}
_D = "split_part(a, '@', 2)"


def _n(expr):
    return f"CAST(len({expr}) AS INT)"


@query("ioc_counts", s.sql(f"""SELECT id, {_n('ads')} AS addresses, {_n(f"list_filter(ads, lambda a: {_D} IN {s.in_list(rules.FREEMAIL)})")} AS freemail,
 {_n(f"list_filter(ads, lambda a: {_D} NOT IN {s.in_list(rules.FREEMAIL)})")} AS corporate,
 {_n(f"list_filter(ads, lambda a: {s.any_rx(_D, rules.HOMOGRAPH_PATTERNS)} OR {s.rx(_D, rules.THROWAWAY_PATTERN)})")} AS suspicious_addresses, {_n('ips')} AS public_ips,
 {_n(f"regexp_extract_all(body, {s.lit(rules.IPV6_PATTERN)})")} AS ipv6, {_n(f"regexp_extract_all(body, {s.lit(rules.MAC_PATTERN)})")} AS mac,
 {_n(f"list_distinct(regexp_extract_all(body, {s.lit(rules.PORT_PATTERN)}, 1))")} AS ports, {_n(f"regexp_extract_all(body, {s.lit(rules.DNS_TEXT_PATTERN)})")} AS dns_strings FROM x""", "emails", **_IOC))
def ioc_counts(spark, sf):
    return I.ioc_counts(fx.emails(spark, sf))


_IPC = f"CASE WHEN {_P1} = 127 THEN 'loopback' WHEN {_P1} = 169 AND {_P2} = 254 THEN 'link_local' WHEN {_P1} = 224 THEN 'multicast' WHEN {_P1} = 255 THEN 'broadcast' WHEN {_P1} <= 9 THEN 'class_a_public' WHEN {_P1} BETWEEN 11 AND 126 THEN 'public' WHEN {_P1} IN (172, 10, 192) THEN 'private' ELSE 'public' END"


@query("ioc_rows", s.sql(f"SELECT id, 'address' AS kind, a AS value, {_D} AS class FROM (SELECT id, unnest(ads) AS a FROM x) UNION ALL SELECT id, 'ipv4', ip, {_IPC} FROM (SELECT id, unnest(ips) AS ip FROM x)", "emails", **_IOC))
def ioc_rows(spark, sf):
    return I.ioc_rows(fx.emails(spark, sf))


_CR = {n: s.rx_count("body", p) for n, (p, _, _) in rules.CONTENT_RISK.items()}
_CRV = "SELECT id, " + ", ".join(f"CAST({c} AS INT) AS {n}" for n, c in _CR.items()) + " FROM emails"
_SCORE = " + ".join(f"CASE WHEN {n} > 0 THEN {p} ELSE 0 END" for n, (_, p, _) in rules.CONTENT_RISK.items())
_RED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {n} > 0 THEN {s.lit(rules.CONTENT_RISK[n][2])} END" for n in rules.RED_FLAG_ORDER) + "], lambda v: v IS NOT NULL), '; ')"


@query("content_risk", s.sql(f"SELECT *, CAST(least(100, {_SCORE}) AS INT) AS content_score, {s.ladder(f'({_SCORE})', 'content')} AS content_level, {_RED} AS red_flags FROM c", "emails", c=_CRV))
def content_risk(spark, sf):
    out = I.content_risk(fx.emails(spark, sf))
    return out.select("id", *rules.CONTENT_RISK, "content_score", "content_level", F.array_join("red_flags", "; ").alias("red_flags"))


_SD, _RD = "string_split(from_email, '@')[2]", "string_split(reply_to, '@')[2]"
_HI = {
    "subject_urgency": s.flag(s.rx("subject", rules.SUBJECT_URGENT_PATTERN)),
    "subject_executive": s.flag(s.rx("subject", rules.SUBJECT_EXECUTIVE_PATTERN)),
    **{("subject_urgency_words" if n == "urgency" else f"subject_{n}"): f"CAST({s.rx_count('subject', p)} AS INT)" for n, p in rules.SUBJECT_CATEGORIES.items()},
    "sender_homograph": s.flag(s.any_rx(_SD, rules.HOMOGRAPH_PATTERNS)),
    "sender_freemail": s.flag(f"lower({_SD}) IN {s.in_list(rules.FREEMAIL)}"),
    "domain_mismatch_reply_to": s.flag(f"reply_to <> '' AND {_SD} <> {_RD}"),
    "different_reply_to": s.flag("from_email <> coalesce(reply_to, '')"),
    "missingReplyTo": s.flag("coalesce(reply_to, '') = ''"),
    "hiddenReplyTo": s.flag("coalesce(reply_to, '') = ''"),
    "multipleFromAddresses": s.flag("len(string_split(from_email, '@')) > 2"),
    "suspiciousSPF": s.flag(s.rx("body", rules.SPF_FAIL_PATTERN)),
    "suspiciousDKIM": s.flag(s.rx("body", rules.DKIM_FAIL_PATTERN)),
    "suspiciousRET": s.flag(s.rx("body", rules.NULL_RETURN_PATTERN)),
}
_HIV = "SELECT id, " + ", ".join(f"{c} AS {n}" for n, c in _HI.items()) + " FROM emails"


@query("header_intelligence", s.sql("SELECT * FROM h", "emails", h=_HIV))
def header_intelligence(spark, sf):
    return I.header_intelligence(fx.emails(spark, sf)).select("id", *_HI)


_LV = "CASE WHEN sender_homograph = 1 THEN 'critical' WHEN domain_mismatch_reply_to = 1 THEN 'high' WHEN missingReplyTo = 1 OR hiddenReplyTo = 1 THEN 'medium' ELSE 'low' END"
_IS = "suspiciousSPF + suspiciousDKIM + multipleFromAddresses"


@query("spoofing_risk", s.sql(f"SELECT id, {_LV} AS spoofing_level, CASE {_LV} WHEN 'critical' THEN 95 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 0 END AS spoofing_score, {_IS} AS alignment_issues, greatest(0, 100 - 30 * ({_IS})) AS authentication_score FROM h", "emails", h=_HIV))
def spoofing_risk(spark, sf):
    out = I.spoofing_risk(I.header_intelligence(fx.emails(spark, sf)))
    return out.select("id", "spoofing_level", "spoofing_score", "alignment_issues", "authentication_score")


_SPF = "CASE WHEN contains(upper(coalesce(h_spf, '')), 'PASS') THEN 'PASS' WHEN contains(upper(coalesce(h_spf, '')), 'FAIL') THEN 'FAIL' ELSE 'NONE' END"
_DK = "CASE WHEN coalesce(h_dkim, '') <> '' THEN 'PASS' ELSE 'NONE' END"


@query("auth_status", s.sql(f"SELECT id, spf AS spf_status, dkim AS dkim_status, dm AS dmarc_status, {s.r6('(CAST(spf = $$PASS$$ AS INT) + CAST(dkim = $$PASS$$ AS INT) + CAST(dm = $$PASS$$ AS INT)) / 3e0')} AS auth_score FROM (SELECT *, CASE WHEN spf = 'FAIL' OR dkim = 'NONE' THEN 'FAIL' WHEN spf = 'PASS' AND dkim = 'PASS' THEN 'PASS' ELSE 'NONE' END AS dm FROM (SELECT id, {_SPF} AS spf, {_DK} AS dkim FROM emails))", "emails"))
def auth_status(spark, sf):
    out = I.auth_status(fx.emails(spark, sf, text=False))
    return out.select("id", "spf_status", "dkim_status", "dmarc_status", round6(F.col("auth_score")).alias("auth_score"))


_MERGED = {
    "found": f"SELECT id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT id, regexp_extract_all(body, {s.lit(rules.URL_EXTRACT['plain'])}) AS l FROM emails)",
    "allu": f"SELECT id, raw, pos, {_class('raw')} AS kind FROM found UNION ALL SELECT id, url, pos + 1000000, 'provided' FROM email_urls",
    "once": f"SELECT id, {s.host('raw')} AS host, arg_min(raw, pos) AS raw, arg_min(kind, pos) AS kind, min(pos) AS pos FROM allu GROUP BY 1, 2",
    "um": f"SELECT e.id, count(CASE WHEN kind = 'shortened' THEN 1 END) AS sh, count(CASE WHEN kind = 'ip_based' THEN 1 END) AS ipb, count(CASE WHEN {s.any_rx('o.raw', rules.SUSPICIOUS_URL_PATTERNS)} THEN 1 END) AS su, count(o.raw) AS n, count(CASE WHEN len(string_split(o.host, '.')) > 2 THEN 1 END) AS deep FROM emails e LEFT JOIN once o ON o.id = e.id GROUP BY e.id",
    "c": _CRV, "h": _HIV,
    "fx": "SELECT h.*, c.* EXCLUDE (id), um.* EXCLUDE (id) FROM h JOIN c ON c.id = h.id JOIN um ON um.id = h.id",
}
_FACTORS = [
    ("sh > 0", "URL_RISK", "medium", "sh || ' shortened URL(s) detected'", 0.15),
    ("ipb > 0", "URL_RISK", "high", "'IP-based URL(s) detected instead of domain names'", 0.25),
    ("su > 0", "URL_RISK", "high", "su || ' suspicious URL pattern(s)'", 0.20),
    ("sender_freemail = 1", "SENDER_RISK", "medium", "'Sender uses free email provider'", 0.10),
    ("sender_homograph = 1", "SENDER_RISK", "critical", "'Homograph/lookalike domain detected'", 0.30),
    ("domain_mismatch_reply_to = 1", "AUTH_RISK", "high", "'Sender domain mismatches Reply-To domain'", 0.20),
    *[(f"{n} = 1", "AUTH_RISK", "high", f"'Missing/suspicious: {n}'", 0.15) for n in I.HEADER_FLAGS],
    ("passwords > 0 OR credit_cards > 0", "CREDENTIAL_RISK", "critical", "'Requests for sensitive credentials detected'", 0.40),
    ("urgency_language > 0", "SOCIAL_ENG_RISK", "high", "'Urgency/pressure tactics detected'", 0.15),
]
_SEV = {"critical": 0, "high": 1, "medium": 2, "low": 3}


@query("risk_factors", s.sql(" UNION ALL ".join(
    f"SELECT id, {_SEV[v]} AS severity_rank, '{c}' AS category, '{v}' AS severity, {t} AS description, {w}::DOUBLE AS weight FROM fx WHERE {k}" for k, c, v, t, w in _FACTORS), "email_urls", **_MERGED))
def risk_factors(spark, sf):
    return I.risk_factors(fx.emails(spark, sf, urls=True), "plain").drop("n")


_BR = ", ".join(f"({i}, '{b}')" for i, b in enumerate(rules.BRAND_WORDS))


@query("forensic_summary", s.sql(f"""SELECT fx.id, CAST(n AS INT) AS domains_count, {_n('x.ips')} AS external_ips, {_n('x.ads')} AS email_addresses, coalesce(b.brands, '') AS brands,
 passwords + credit_cards AS credential_harvesting, urgency_language AS urgent_language, payment_requests, {' + '.join(I.HEADER_FLAGS)} AS authentication_abuse, CAST(deep AS INT) AS subdomain_abuse
FROM fx JOIN x ON x.id = fx.id LEFT JOIN b ON b.id = fx.id""", "email_urls", **_IOC, **_MERGED,
    hb=f"SELECT id, min(pos * 10 + w.k) AS o, w.brand FROM once, (VALUES {_BR}) AS w(k, brand) WHERE contains(host, w.brand) GROUP BY id, w.brand",
    b="SELECT id, string_agg(brand, ',' ORDER BY o) AS brands FROM hb GROUP BY id"))
def forensic_summary(spark, sf):
    return I.forensic_summary(fx.emails(spark, sf, urls=True), "plain")


@query("risk_factors__web")
def risk_factors_web(spark, sf):
    return I.risk_factors(fx.emails(spark, sf, urls=True))
