"""Verdict queries and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.risk import action, ladder
from lurelens.functions.stages import unpacked
from lurelens.functions.text import flag, round6
from lurelens.operators import domains as D
from lurelens.operators import enrichment as J
from lurelens.operators import features as E
from lurelens.operators import verdict as V
from lurelens.plans import fixtures as fx
from lurelens.plans import scoring
from lurelens.plans import sqlparts as s
from lurelens.plans.q_domains import TRUST_VIEWS
from lurelens.plans.q_features import HYBRID_COLS, OPERATIONAL, _OP_TXT, _select
from lurelens.plans.q_links import _FLAGS, _MISMATCH, _links_sql
from lurelens.plans.registry import query

_CUES = f"SELECT id, contains({_OP_TXT}, 'update your account') OR contains({_OP_TXT}, 'verify') AS ask_verify, contains({_OP_TXT}, 'password') OR contains({_OP_TXT}, 'login') AS ask_cred FROM emails"
OP_VIEWS = {"op": OPERATIONAL, "cues": _CUES, "f": "SELECT op.*, cues.ask_verify, cues.ask_cred, 0 AS dns_u, 0 AS dns_s FROM op JOIN cues ON cues.id = op.id"}


def _e(x):
    return f"{float(x)!r}e0"


def _w(variant):
    w = rules.HEURISTIC_WEIGHTS[variant]
    total = f"shortened_url_detected * {_e(w['shortened'])} + domain_mismatch * {_e(w['mismatch'])} + dns_s * {_e(w['sender_dns'])} + dns_u * {_e(w['url_dns'])} + urgency_score / {_e(w['urgency_div'])}"
    if w["sensitive"]:
        total += f" + sensitive_keyword_count * {_e(w['sensitive'])}"
    return f"least(1e0, {total})"


API_P = f"least(1e0, {_w('api')} + CASE WHEN ask_verify THEN 3e-1 ELSE 0e0 END)"
_P = {
    "api": API_P,
    "fusion_rules": f"(CASE WHEN ask_verify THEN 6e-1 ELSE 0e0 END + CASE WHEN ask_cred THEN 3e-1 ELSE 0e0 END) * 4e-1 + {_w('fusion_rules')} * 6e-1",
    "fusion_text": f"least(1e0, ((id * 37) % 101) / 1e2) * 4e-1 + {_w('fusion_text')} * 6e-1",
}


def _features(spark, sf):
    return E.operational_features(fx.emails(spark, sf, urls=True))


for _v in _P:
    def _run(spark, sf, v=_v):
        text = ((F.col("id") * 37) % 101) / F.lit(100.0) if v == "fusion_text" else None
        return _features(spark, sf).select("id", round6(V.heuristic_probability(v, text)).alias("probability"))

    query(f"heuristic_probability__{_v}", s.sql(f"SELECT id, {s.r6(_P[_v])} AS probability FROM f", "email_urls", **OP_VIEWS))(_run)


@query("mails_per_risk_level", s.sql(f"SELECT {s.ladder('p', 'operational')} AS risk_level, count(*) AS mails, {s.r6('avg(p)')} AS avg_probability FROM (SELECT {API_P} AS p FROM f) GROUP BY 1", "email_urls", **OP_VIEWS))
def mails_per_risk_level(spark, sf):
    levels = scoring.heuristic_levels(fx.emails(spark, sf, urls=True))
    return levels.groupBy("risk_level").agg(F.count("*").alias("mails"), round6(F.avg("probability")).alias("avg_probability"))


for _v in ("operational", "late_fusion", "hybrid", "ensemble", "thirds"):
    def _run(spark, sf, v=_v):
        return fx.predictions(spark, sf).select("id", "model", ladder(F.col("probability"), v).alias("risk_level"))

    query(f"risk_ladder__{_v}", s.sql(f"SELECT id, model, {s.ladder('probability', _v)} AS risk_level FROM predictions", "predictions"))(_run)


@query("risk_ladder__pipeline", s.sql(f"SELECT id, model, CASE WHEN probability > 5e-1 THEN {s.ladder('probability', 'pipeline')} ELSE 'LOW' END AS risk_level FROM predictions", "predictions"))
def risk_ladder_pipeline(spark, sf):
    p = F.col("probability")
    return fx.predictions(spark, sf).select("id", "model", F.when(p > 0.5, ladder(p, "pipeline")).otherwise("LOW").alias("risk_level"))


@query("risk_ladder__safety", s.sql(f"SELECT id, model, {s.ladder('floor((1e0 - probability) * 100)', 'safety')} AS risk_level FROM predictions", "predictions"))
def risk_ladder_safety(spark, sf):
    score = V.safety_score(F.col("probability"))
    return fx.predictions(spark, sf).select("id", "model", ladder(score, "safety").alias("risk_level"))


@query("recommended_actions", s.sql(f"SELECT id, model, CASE {s.ladder('probability', 'operational')} WHEN 'CRITICAL' THEN 'BLOCK_AND_REPORT' WHEN 'MEDIUM' THEN 'WARN' ELSE 'ALLOW' END AS recommended_action FROM predictions", "predictions"))
def recommended_actions(spark, sf):
    return fx.predictions(spark, sf).select("id", "model", action(ladder(F.col("probability"), "operational")).alias("recommended_action"))


@query("safety_scores", s.sql("SELECT id, model, CAST(floor((1e0 - probability) * 100) AS INT) AS truncated, CAST(CASE WHEN probability >= 5e-1 THEN greatest(0, round_even((1e0 - probability) * 100, 0)) ELSE least(100, round_even((1e0 - probability) * 100, 0)) END AS INT) AS rounded FROM predictions", "predictions"))
def safety_scores(spark, sf):
    p = F.col("probability")
    conf = F.when(p >= 0.5, p).otherwise(F.lit(1.0) - p)
    return fx.predictions(spark, sf).select("id", "model", V.safety_score(p).alias("truncated"), V.safety_score_rounded(conf, p >= 0.5).alias("rounded"))


_WS = "(CASE WHEN n < 50 THEN 6.5e-1 ELSE 5e-1 END)"
_WT = "(CASE WHEN n < 50 THEN 3.5e-1 ELSE 5e-1 END)"


@query("fusion__balanced", s.sql(f"SELECT e.id, {s.r6(f'(p.probability * {_WT} + {_w("api")} * {_WS}) / ({_WT} + {_WS})')} AS fused FROM f JOIN (SELECT id, len({s.words('body')}) AS n FROM emails) e ON e.id = f.id JOIN predictions p ON p.id = f.id AND p.model = 'alpha'", "email_urls", "predictions", **OP_VIEWS))
def fusion_balanced(spark, sf):
    from lurelens.functions.text import words

    rows = _features(spark, sf)
    alpha = F.least(((F.col("id") * 37) % 101) / F.lit(100.0), F.lit(1.0))
    return rows.select("id", round6(V.balanced_fusion(alpha, V._weighted("api"), F.size(words(F.col("body"))))).alias("fused"))


FLAG_VIEWS = {
    "md": "SELECT DISTINCT id, d, 'url' AS role FROM ud UNION ALL SELECT id, sd, 'sender' FROM m WHERE sd <> ''",
    "ds": "SELECT domain, bool_or(rdtype IN ('A', 'AAAA')) AS resolves FROM dns_records WHERE NOT starts_with(domain, '_dmarc.') GROUP BY domain",
    "fl": "SELECT id, count(*) AS domains, CAST(coalesce(bool_or(NOT resolves AND role = 'url'), false) AS INT) AS dns_u, CAST(coalesce(bool_or(NOT resolves AND role = 'sender'), false) AS INT) AS dns_s, coalesce(list(d ORDER BY d) FILTER (WHERE NOT resolves), []) AS lost FROM md LEFT JOIN ds ON ds.domain = md.d GROUP BY id",
}
_REASONS = """list_filter([
 CASE WHEN dns_s = 1 THEN '⚠️ Sender domain failed DNS resolution. This is a strong indicator of spoofing.' END,
 CASE WHEN dns_u = 1 THEN '⚠️ Extracted URLs point to domains that fail DNS resolution (potentially removed or newly registered).' END,
 CASE WHEN domain_mismatch = 1 THEN '⚠️ Reply-To email differs from Sender email.' END,
 CASE WHEN shortened_url_detected = 1 THEN '🔗 Uses URL shortener to mask final destination.' END,
 CASE WHEN urgency_score > 0 THEN '⏳ Contains language creating false urgency.' END,
 CASE WHEN dns_s = 0 AND dns_u = 0 AND domain_mismatch = 0 AND shortened_url_detected = 0 AND urgency_score <= 0 THEN
  CASE WHEN h >= 5e-1 THEN 'Semantic NLP Model flagged suspicious text patterns.' ELSE 'No structural or semantic threats detected. Email seems safe.' END END], lambda v: v IS NOT NULL)"""
_FULL = {
    **OP_VIEWS, **TRUST_VIEWS, **FLAG_VIEWS,
    "g": "SELECT f.* EXCLUDE (dns_u, dns_s), coalesce(fl.dns_u, 0) AS dns_u, coalesce(fl.dns_s, 0) AS dns_s, coalesce(fl.lost, []) AS lost FROM f LEFT JOIN fl ON fl.id = f.id",
    "v1": f"SELECT g.*, {API_P} AS h, trust.trust_score, trust.n_imp, trust.brands, trust.s_ok, trust.s_cat, trust.warnings FROM g JOIN trust ON trust.id = g.id",
    "v2": "SELECT *, CASE WHEN trust_score > 3e-1 AND n_imp = 0 THEN greatest(0e0, h - least(1.5e-1, trust_score * 2.5e-1)) WHEN n_imp > 0 THEN least(1e0, h + 2e-1) ELSE h END AS p FROM v1",
    "v3": f"SELECT *, n_imp > 0 OR p >= 5e-1 AS phish, CASE WHEN n_imp > 0 THEN 'CRITICAL' ELSE {s.ladder('p', 'operational')} END AS risk_level, list_concat(list_concat({_REASONS}, list_filter([CASE WHEN len(lost) > 0 THEN '⚠️ DNS: ' || len(lost) || ' domain(s) failed resolution: ' || array_to_string(lost[1:3], ', ') END, CASE WHEN n_imp > 0 THEN '⚠️ Brand impersonation detected: ' || brands END, CASE WHEN s_ok AND n_imp = 0 THEN '✅ Sender domain is a verified ' || s_cat || ' domain' END], lambda v: v IS NOT NULL)), list_transform(warnings[1:2], lambda v: '⚠️ ' || v))[1:5] AS reasoning FROM v2",
}


@query("full_verdict", s.sql(f"SELECT id, {s.r6('p')} AS probability, CAST(phish AS INT) AS phishing, {s.r6('CASE WHEN phish THEN p ELSE 1e0 - p END')} AS confidence, CAST(floor((1e0 - p) * 100) AS INT) AS safety_score, risk_level, CASE risk_level WHEN 'CRITICAL' THEN 'BLOCK_AND_REPORT' WHEN 'MEDIUM' THEN 'WARN' ELSE 'ALLOW' END AS recommended_action, array_to_string(reasoning, ' | ') AS reasoning FROM v3", "email_urls", "trusted", "brands", "dns_records", **_FULL))
def full_verdict(spark, sf):
    out = scoring.score_mails(fx.emails(spark, sf, urls=True), J.dns_status(fx.dns_records(spark, sf)))
    return out.select(
        "id", round6(F.col("probability")).alias("probability"), "phishing", round6(F.col("confidence")).alias("confidence"),
        "safety_score", "risk_level", "recommended_action", F.array_join("reasoning", " | ").alias("reasoning"))


_FUSION_REASONS = """list_filter([
 CASE WHEN domain_mismatch = 1 THEN 'Sender domain and Reply-To mismatch detected.' END,
 CASE WHEN shortened_url_detected = 1 THEN 'Email contains shortened URLs often used to obscure malicious links.' END,
 CASE WHEN encoded_url_detected = 1 THEN 'Suspicious IP-based or encoded URL format detected.' END,
 CASE WHEN sensitive_keyword_count > 2 THEN 'High volume of sensitive credential-harvesting keywords.' END,
 CASE WHEN urgency_score > 5 THEN 'Language exhibits extreme urgency, a common social engineering tactic.' END], lambda v: v IS NOT NULL)"""


@query("reasons__fusion", s.sql(f"SELECT id, array_to_string((CASE WHEN len(r) > 0 THEN r WHEN p > 6e-1 THEN ['Semantic NLP Model flagged suspicious text patterns.'] ELSE ['No significant structural or semantic threats detected.'] END)[1:3], ' | ') AS reasoning FROM (SELECT id, {_FUSION_REASONS} AS r, {_P['fusion_rules']} AS p FROM f)", "email_urls", **OP_VIEWS))
def reasons_fusion(spark, sf):
    rows = _features(spark, sf).withColumn("p", V.heuristic_probability("fusion_rules"))
    return rows.select("id", F.array_join(V.reasons_fusion(F.col("p")), " | ").alias("reasoning"))


_ET = "lower(subject || ' ' || from_email || ' ' || body) || ' ' || lower(array_to_string(urls, ' '))"
_PCT = "printf('%.1f', p * 100) || '%'"
_ENS = f"""list_filter([CASE WHEN {s.any_in('t', ['verify', 'confirm', 'urgent', 'immediate'])} THEN 'Contains urgency language (verify, confirm, urgent)' END,
 CASE WHEN {s.any_in('t', ['bit.ly', 'tinyurl', 'short.link'])} THEN 'Contains shortened URLs (common phishing tactic)' END,
 CASE WHEN contains(t, 'click') THEN 'Contains call-to-action (click link)' END,
 CASE WHEN {s.any_in('t', rules.SUSPICIOUS_TLDS['api'])} THEN 'Uses suspicious domain TLD' END,
 CASE WHEN p > 7e-1 THEN 'High phishing probability: ' || {_PCT} END], lambda v: v IS NOT NULL)"""


@query("reasons__ensemble", s.sql(f"SELECT id, array_to_string((CASE WHEN len(r) > 0 THEN r ELSE ['Classified by machine learning model (confidence: ' || {_PCT} || ')'] END)[1:5], ' | ') AS reasoning FROM (SELECT id, p, {_ENS} AS r FROM x)", "email_urls", "predictions", x=f"SELECT e.id, p.probability AS p, {_ET} AS t FROM emails e JOIN predictions p ON p.id = e.id AND p.model = 'alpha'"))
def reasons_ensemble(spark, sf):
    alpha = F.least(((F.col("id") * 37) % 101) / F.lit(100.0), F.lit(1.0))
    rows = fx.emails(spark, sf, urls=True).withColumn("p", alpha)
    return rows.select("id", F.array_join(V.reasons_ensemble(F.col("p")), " | ").alias("reasoning"))


_PSD = "CASE WHEN contains({a}, '@') THEN lower(string_split(regexp_replace({a}, '^[<>]+|[<>]+$', '', 'g'), '@')[2]) ELSE '' END"
_PIPE = {
    "al": _links_sql(("emails", "body"), "id"),
    "ur": "SELECT id, list(r ORDER BY pos, k) AS rs FROM (" + " UNION ALL ".join(
        f"SELECT id, pos, {k} AS k, {t} AS r FROM email_urls WHERE {_FLAGS[n]}" for k, (n, t) in enumerate([
            ("is_shortened", "'Shortened URL detected: ' || url"), ("has_ip_address", "'URL uses IP address instead of domain'"),
            ("has_punycode", "'Punycode/IDN encoding detected in URL'"), ("has_suspicious_tld", "'Suspicious TLD detected in URL'")])) + ") GROUP BY id",
    "ln": f"SELECT id, list('Link mismatch: text=''' || link_text || ''' vs url=''' || href || '''' ORDER BY n) AS ls FROM al WHERE {_MISMATCH['analyzer']} GROUP BY id",
    "x": f"SELECT e.id, lower(body || ' ' || subject) AS t, {_PSD.format(a='from_email')} AS sd, {_PSD.format(a="coalesce(reply_to, '')")} AS rd, ur.rs, ln.ls FROM emails e LEFT JOIN ur ON ur.id = e.id LEFT JOIN ln ON ln.id = e.id",
    "y": f"""SELECT id, list_concat(list_concat(coalesce(rs, []), list_filter([CASE WHEN sd <> '' AND rd <> '' AND sd <> rd THEN 'From domain ' || sd || ' doesn''t match Reply-To domain ' || rd END,
 CASE WHEN {s.any_in('t', ['urgent', 'immediate', 'action required', 'asap'])} THEN 'Urgent language detected' END,
 CASE WHEN {s.any_in('t', ['password', 'verify', 'confirm', 'authenticate', 'login'])} THEN 'Credential solicitation detected' END], lambda v: v IS NOT NULL)), coalesce(ls, [])) AS r FROM x""",
}


@query("reasons__pipeline", s.sql("SELECT id, CASE WHEN len(r) > 0 THEN array_to_string(r, ' | ') ELSE 'Detected as phishing based on text patterns' END AS reasoning FROM y", "email_urls", **_PIPE))
def reasons_pipeline(spark, sf):
    return fx.emails(spark, sf, urls=True).select("id", F.array_join(V.reasons_pipeline(), " | ").alias("reasoning"))


_HYB = """list_filter([CASE WHEN contains(sb, 'urgent') OR contains(sb, 'verify') OR contains(sb, 'confirm') OR contains(sb, 'action required') OR contains(sb, 'click') THEN '⚠️ Contains urgency/verification language (suspicious indicator)' END,
 CASE WHEN listed_urls > 0 AND shortener_urls > 0 THEN '🔗 Contains shortened URLs (bit.ly, tinyurl - suspicious)' END,
 CASE WHEN listed_urls > 0 AND https_urls > 0 THEN '✓ Uses HTTPS (legitimate indicator)' END,
 CASE WHEN has_at = 1 AND short_domain > 0 THEN '⚠️ Uses suspicious domain pattern' END,
 CASE WHEN n < 100 THEN '📝 Very short email body (suspicious)' WHEN n > 1000 THEN '📝 Long email body (more likely legitimate)' END,
 CASE WHEN c > 9e-1 THEN '🤖 Model confidence: ' || printf('%.1f', c * 100) || '%' || ' - High certainty' WHEN c > 5e-1 THEN '🤖 Model confidence: ' || printf('%.1f', c * 100) || '%' END], lambda v: v IS NOT NULL)"""


@query("reasons__hybrid", s.sql(f"SELECT id, CASE WHEN len(r) > 0 THEN array_to_string(r, ' | ') WHEN p > 5e-1 THEN 'Classified as phishing based on semantic analysis' ELSE 'Email appears legitimate' END AS reasoning FROM (SELECT *, {_HYB} AS r FROM x)", "email_urls", "predictions",
    x=f"SELECT e.id, p.probability AS p, CASE WHEN p.probability > 5e-1 THEN p.probability ELSE 1e0 - p.probability END AS c, lower(subject) || lower(body) AS sb, length(body) AS n, {_select(HYBRID_COLS)} FROM emails e JOIN predictions p ON p.id = e.id AND p.model = 'alpha'"))
def reasons_hybrid(spark, sf):
    alpha = F.least(((F.col("id") * 37) % 101) / F.lit(100.0), F.lit(1.0))
    rows = fx.emails(spark, sf, urls=True)
    rows = rows.select("*", *[c.alias(n) for n, c in E.hybrid_features().items()], alpha.alias("p"))
    p = F.col("p")
    conf = F.when(p > 0.5, p).otherwise(F.lit(1.0) - p)
    return rows.select("id", F.array_join(V.reasons_hybrid(conf, p > 0.5), " | ").alias("reasoning"))


_XW = {
    "xe": f"SELECT e.id, p.probability AS p, lower(subject || ' ' || body) AS t, lower(body) AS b, array_to_string(urls, ' ') AS u, len(urls) AS n FROM emails e JOIN predictions p ON p.id = e.id AND p.model = 'alpha'",
    "xr": f"""SELECT id, greatest(p, 1e0 - p) AS c, CASE WHEN contains(t, 'urgent') OR contains(t, 'immediate') THEN 3e-1 ELSE 1e-1 END AS w1,
 CASE WHEN {s.any_in('u', rules.SHORTENERS['forensics'])} THEN 4e-1 ELSE 5e-2 END AS w2, CASE WHEN {s.any_in('b', rules.EXPLAIN_BODY_KEYWORDS)} THEN 2e-1 ELSE 5e-2 END AS w3,
 CASE WHEN n > 2 THEN 1.5e-1 ELSE 3e-2 END AS w4 FROM xe""",
    "xw": f"SELECT id, f.feature, least(9.9e-1, {s.r6('f.w * (c / greatest(w1, w2, w3, w4))')}) AS weight FROM xr, LATERAL (SELECT unnest(['Urgent Language Tone', 'Suspicious URLs', 'Sensitive Keyword Count', 'HTML Link Obfuscation']) AS feature, unnest([w1, w2, w3, w4]) AS w) f",
}


def explanation_rows(spark, sf):
    alpha = F.least(((F.col("id") * 37) % 101) / F.lit(100.0), F.lit(1.0))
    rows = fx.emails(spark, sf, urls=True)
    w = V.explanation_weights(F.greatest(alpha, F.lit(1.0) - alpha))
    rows = rows.withColumn("phishing", flag(alpha > 0.5))
    return unpacked(rows, ["id", "phishing"], w, "rank", "w").select("id", "phishing", "rank", "w.feature", "w.weight")


@query("explanation_weights", s.sql("SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, feature) - 1 AS INT) AS rank, feature, weight FROM xw", "email_urls", "predictions", **_XW))
def explanation_weights(spark, sf):
    return explanation_rows(spark, sf).select("id", "rank", "feature", "weight")


@query("explanation_top_features", s.sql(f"SELECT feature, {s.r6('avg(weight)')} AS mean_weight, count(*) AS mails, arg_min(CASE WHEN p > 5e-1 THEN 'phishing' ELSE 'legitimate' END, xw.id) AS direction FROM xw JOIN xe ON xe.id = xw.id GROUP BY feature ORDER BY mean_weight DESC, feature LIMIT 8", "email_urls", "predictions", **_XW))
def explanation_top_features(spark, sf):
    rows = explanation_rows(spark, sf)
    return rows.groupBy("feature").agg(round6(F.avg("weight")).alias("mean_weight"), F.count("*").alias("mails"),
        F.min_by(F.when(F.col("phishing") == 1, "phishing").otherwise("legitimate"), "id").alias("direction"),
    ).orderBy(F.desc("mean_weight"), "feature").limit(8)
