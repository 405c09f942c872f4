"""Mail feature queries and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import links as L
from lurelens.functions.text import round6
from lurelens.operators import features as E
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.q_domains import _TYPO
from lurelens.plans.q_links import _FLAGS, _HOST, _MISMATCH, _links_sql
from lurelens.plans.registry import query


def rounded(df, skip=()):
    """Doubles rounded to six places, the form both engines agree on."""
    return df.select(*[round6(F.col(n)).alias(n) if t == "double" and n not in skip else F.col(n) for n, t in df.dtypes])


_DEPTH = f"greatest(0, len(string_split({_HOST}, '.')) - 2)"
_DIGIT = f"CASE WHEN length({_HOST}) > 0 THEN length(regexp_replace({_HOST}, '[^0-9]', '', 'g')) / length({_HOST})::DOUBLE ELSE 0e0 END"
_SPECIAL = "CASE WHEN length(url) > 0 THEN length(regexp_replace(url, '[\\p{L}\\p{N}/:.\\-_?=&#@]', '', 'g')) / length(url)::DOUBLE ELSE 0e0 END"
_NAME = {"is_shortened": "has_shortened_url"}
URL_AGG = f"""SELECT e.id, CAST(count(u.url) AS INT) AS url_count, CAST(coalesce(max(length(url)), 0) AS INT) AS max_url_length,
 {s.r6('coalesce(avg(length(url)), 0e0)')} AS avg_url_length, CAST(coalesce(min(length(url)), 0) AS INT) AS min_url_length,
 {s.r6('coalesce(stddev_samp(length(url)), 0e0)')} AS url_length_std_dev, CAST(coalesce(max({_DEPTH}), 0) AS INT) AS subdomain_depth,
 {s.r6(f'coalesce(max({_DIGIT}), 0e0)')} AS max_domain_digit_ratio, {s.r6(f'coalesce(max({_SPECIAL}), 0e0)')} AS max_url_special_ratio,
 {', '.join(f"CAST(coalesce(bool_or({c}), false) AS INT) AS {_NAME.get(n, n)}" for n, c in _FLAGS.items())}
FROM emails e LEFT JOIN email_urls u ON u.id = e.id GROUP BY e.id"""


@query("features__url", s.sql(URL_AGG, "email_urls"))
def features_url(spark, sf):
    return rounded(E.url_features(fx.emails(spark, sf, urls=True, text=False).select("id", "urls"))).drop("urls")


def _dom(a):
    return f"CASE WHEN contains({a}, '@') THEN lower(string_split(regexp_replace({a}, '^[<>]+|[<>]+$', '', 'g'), '@')[2]) ELSE '' END"


_SD = _dom("from_email")


def _differs(h):
    o = _dom(f"coalesce({h}, '')")
    return f"CAST({_SD} <> '' AND {o} <> '' AND {_SD} <> {o} AS INT)"


_DOMAIN_COLS = {
    "from_reply_mismatch": _differs("reply_to"),
    "from_return_mismatch": _differs("h_return"),
    "sender_domain_mismatch": "0",
    "sender_has_phone": f"CAST({s.rx('from_email', rules.SENDER_PHONE_PATTERN)} AS INT)",
    "sender_has_website": "CAST(regexp_matches(from_email, 'https?://') AS INT)",
    "sender_domain_typo": f"(SELECT CAST(({_TYPO}) AS INT) FROM (SELECT {_SD} AS d))",
}


def _select(columns):
    return ", ".join(f"{c} AS {n}" for n, c in columns.items())


@query("features__domain", s.sql(f"SELECT id, {_select(_DOMAIN_COLS)} FROM emails", "emails"))
def features_domain(spark, sf):
    return fx.emails(spark, sf, text=False).select("id", *[c.alias(n) for n, c in E.domain_features().items()])


_COUNT = "CAST(len(list_filter(string_split(coalesce({c}, ''), ','), lambda a: trim(a) <> '')) AS INT)"
_HEADER_COLS = {
    "has_spf": "CAST(h_spf IS NOT NULL AS INT)",
    "has_dkim": "CAST(h_dkim IS NOT NULL AS INT)",
    "has_dmarc": "0",
    "auth_score": s.r6("(CAST(h_spf IS NOT NULL AS INT) + CAST(h_dkim IS NOT NULL AS INT)) / 3e0"),
    "has_link_mismatch": "CAST(e.id IN (SELECT id FROM bad) AS INT)",
    "has_html_form": "CAST(contains(lower(body), '<form') AS INT)",
    "recipient_count": _COUNT.format(c="to_email"),
    "cc_count": _COUNT.format(c="h_cc"),
}
_BAD = {"al": _links_sql(("emails", "body"), "id"), "bad": f"SELECT DISTINCT id FROM al WHERE {_MISMATCH['structural']}"}


@query("features__header", s.sql(f"SELECT id, {_select(_HEADER_COLS)} FROM emails e", "emails", **_BAD))
def features_header(spark, sf):
    return rounded(fx.emails(spark, sf).select("id", *[c.alias(n) for n, c in E.header_features().items()]))


_W = s.words("body")
ENTROPY = """list_sum(list_transform(list_distinct(list_filter(string_split(body, ''), lambda c: c <> '')),
 lambda c: -((length(body) - length(replace(body, c, ''))) / length(body)::DOUBLE) * log2((length(body) - length(replace(body, c, ''))) / length(body)::DOUBLE)))"""
_CONTENT_COLS = {
    "text_length": f"CAST(len({_W}) AS INT)",
    "subject_length": f"CAST(len({s.words('subject')}) AS INT)",
    "sentence_count": "CAST(3 * length(body) - length(replace(body, '.', '')) - length(replace(body, '!', '')) - length(replace(body, '?', '')) AS INT)",
    "avg_word_length": s.r6(f"coalesce(list_sum(list_transform({_W}, lambda w: length(w)))::DOUBLE / nullif(len({_W}), 0), 0e0)"),
    "uppercase_ratio": s.r6("len(regexp_extract_all(body, '\\p{Lu}')) / length(body)::DOUBLE"),
    "entropy_score": s.r6(ENTROPY),
    "attachment_count": "CAST(len(files) AS INT)",
    "has_risky_attachment": f"CAST(len(list_filter(files, lambda f: {s.ends_any('lower(f)', rules.RISKY_EXTENSIONS['used'])})) > 0 AS INT)",
}


@query("features__content", s.sql(f"SELECT id, {_select(_CONTENT_COLS)} FROM emails", "emails"))
def features_content(spark, sf):
    return rounded(fx.emails(spark, sf).select("id", *[c.alias(n) for n, c in E.content_features().items()]))


@query("body_entropy", s.sql(f"SELECT id, {s.r6(ENTROPY)} AS entropy FROM emails", "emails"))
def body_entropy(spark, sf):
    return fx.emails(spark, sf).select("id", round6(E.entropy(F.col("body"))).alias("entropy"))


def _scaled(count, total, per="1e2"):
    return f"least(1e0, ({count}) / greatest(1e0, ({total}) / {per}))"


def _intent(variant, lexicons="full"):
    lex = rules.LEXICONS[lexicons]
    total = f"len({s.words('txt')})"
    cols = {
        "urgency_score": s.hits("txt", lex["urgency"]),
        "credential_score": s.hits("txt", lex["credential"]),
        "action_cta_score": "CAST(contains(lower(body), 'click') AS INT) + CAST(contains(lower(body), 'verify') AS INT)" if variant == "presence" else s.hits("txt", lex["action_cta"]),
        "threat_score": s.hits("txt", lex["threat"]),
        "legitimacy_score": s.hits("txt", rules.LEGITIMACY_SHORT if variant == "presence" else lex["legitimacy"]),
    }
    return {n: s.r6(_scaled(c, total)) for n, c in cols.items()}


_TXT = "SELECT *, lower(body || ' ' || subject) AS txt FROM emails"
for _key, _variant, _lex in (("presence", "presence", "full"), ("counts", "counts", "full"), ("declared", "counts", "declared")):
    def _run(spark, sf, v=_variant, lx=_lex):
        return rounded(E.intent_scores(fx.emails(spark, sf), v, lx).select("id", *E.INTENT_NAMES))

    query(f"intent_scores__{_key}", s.sql(f"SELECT id, {_select(_intent(_variant, _lex))} FROM x", "emails", x=_TXT))(_run)

_SUBJECT_COLS = {
    "subject_length": f"CAST(len({s.words('subject')}) AS INT)",
    "subject_urgency_score": s.r6(_scaled(s.hits("lower(subject)", rules.URGENCY), f"len({s.words('subject')})", "1e1")),
    "subject_has_caps": "CAST(upper(subject) = subject AND lower(subject) <> subject AND length(subject) > 5 AS INT)",
}


@query("features__subject", s.sql(f"SELECT id, {_select(_SUBJECT_COLS)} FROM y", "emails", y="SELECT id, CASE WHEN id % 3 = 0 THEN upper(subject) ELSE subject END AS subject FROM emails"))
def features_subject(spark, sf):
    mails = fx.emails(spark, sf, text=False).withColumn("subject", F.when(F.col("id") % 3 == 0, F.upper("subject")).otherwise(F.col("subject")))
    return rounded(mails.select("id", *[c.alias(n) for n, c in E.subject_features().items()]))


_CONTENT_NAMES = list(_CONTENT_COLS)
_VECTOR = f"""SELECT u.*, {', '.join(n for n in _DOMAIN_COLS)}, {', '.join(_HEADER_COLS)}, {', '.join(_CONTENT_NAMES)}, {', '.join(_intent('presence'))},
 subject_urgency_score, subject_has_caps, {s.r6('text_length / greatest(1, subject_length)::DOUBLE')} AS body_subject_ratio, {s.r6('url_count / greatest(1, text_length)::DOUBLE')} AS url_text_ratio
FROM u JOIN v ON v.id = u.id"""
_V = {**_DOMAIN_COLS, **_HEADER_COLS, **_CONTENT_COLS, **_intent("presence"), **{n: c for n, c in _SUBJECT_COLS.items() if n != "subject_length"}}


@query("structural_vector", s.sql(_VECTOR, "email_urls", u=URL_AGG, **_BAD, x=_TXT, v=f"SELECT id, {_select(_V)} FROM x e"))
def structural_vector(spark, sf):
    mails = fx.emails(spark, sf, urls=True)
    out = E.structural_vector(mails)
    return rounded(out).drop(*[c for c in mails.columns if c != "id"])


_OP_TXT = "lower(subject || ' ' || body)"
_NL = s.netloc("url")
OPERATIONAL = f"""SELECT e.id, CAST(count(u.url) AS INT) AS url_count,
 CAST(coalesce(bool_or({_NL} <> '' AND {_NL} IN {s.in_list(rules.SHORTENERS['operational'])}), false) AS INT) AS shortened_url_detected,
 CAST(coalesce(bool_or({_NL} <> '' AND {s.ends_any(_NL, rules.SUSPICIOUS_TLDS['operational'])}), false) AS INT) AS suspicious_tld_detected,
 CAST(coalesce(bool_or({_NL} <> '' AND (regexp_matches(url, '%[0-9A-Fa-f]{{2}}') OR {s.rx(_NL, L.IPV4_SHAPE)})), false) AS INT) AS encoded_url_detected,
 CAST(coalesce(any_value(from_email) <> '' AND any_value(reply_to) <> '' AND lower(any_value(reply_to)) <> lower(any_value(from_email)), false) AS INT) AS domain_mismatch,
 any_value({s.hits(_OP_TXT, rules.OPERATIONAL_URGENCY)}) * 2e0 AS urgency_score,
 CAST(any_value(contains({_OP_TXT}, '<form') OR contains({_OP_TXT}, 'method="post"')) AS INT) AS html_form_presence,
 CAST(any_value({s.hits(_OP_TXT, rules.OPERATIONAL_SENSITIVE)}) AS INT) AS sensitive_keyword_count
FROM emails e LEFT JOIN email_urls u ON u.id = e.id GROUP BY e.id"""


@query("features__operational", s.sql("SELECT *, 0 AS unresolved_url_domain, 0 AS unresolved_sender_domain FROM o", "email_urls", o=OPERATIONAL))
def features_operational(spark, sf):
    mails = fx.emails(spark, sf, urls=True)
    return E.operational_features(mails).drop(*E.CUES, *[c for c in mails.columns if c != "id"])


_LIST = "CASE WHEN array_to_string(urls, ',') = '' THEN [] ELSE string_split(array_to_string(urls, ','), ',') END"
_HD = "lower(CASE WHEN contains(from_email, '@') THEN string_split(from_email, '@')[2] ELSE '' END)"


def _cnt(cond):
    return f"CAST(len(list_filter({_LIST}, lambda u: {cond})) AS INT)"


HYBRID_COLS = dict(zip(E.HYBRID_NAMES, [
    "CAST(length(subject) AS INT)", s.flag(s.any_in("lower(subject)", rules.HYBRID_SUBJECT_URGENT)),
    s.flag(s.any_in("lower(subject)", rules.HYBRID_SUBJECT_REPLY)), s.flag("contains(from_email, '@')"),
    f"CAST(length({_HD}) AS INT)", s.flag(s.any_in(_HD, rules.HYBRID_SHORT_DOMAIN)), f"CAST(len({_LIST}) AS INT)",
    _cnt(s.any_in("u", rules.HYBRID_SHORT_URL)), _cnt("starts_with(u, 'https')"), _cnt("contains(lower(u), 'click')"),
]))


@query("features__hybrid", s.sql(f"SELECT id, {_select(HYBRID_COLS)} FROM emails", "emails"))
def features_hybrid(spark, sf):
    return fx.emails(spark, sf, urls=True, text=False).select("id", *[c.alias(n) for n, c in E.hybrid_features().items()])
