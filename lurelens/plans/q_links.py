"""URL queries and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import links as L
from lurelens.functions.stages import unpacked
from lurelens.functions.text import flag, round6
from lurelens.operators import features as E
from lurelens.operators import enrichment as J
from lurelens.operators import links as U
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.registry import query


def _extracted(variant):
    def run(spark, sf):
        mails = fx.emails(spark, sf)
        return unpacked(mails, ["id"], U.extract(F.col("body"), variant), "pos", "url")

    return run


_FIRST = "SELECT id, u.url, u.pos FROM emails, LATERAL (SELECT unnest(l) AS url, unnest(range(len(l))) AS pos FROM (SELECT {expr} AS l)) u"
for _v in ("plain", "adapter", "scanner"):
    query(f"url_extract__{_v}", s.sql(
        "SELECT id, url, CAST(pos AS INT) AS pos FROM x", "emails",
        x=_FIRST.format(expr=f"regexp_extract_all(body, {s.lit(rules.URL_EXTRACT[_v])})")))(_extracted(_v))
query("url_extract__loader", s.sql(
    "SELECT id, url, CAST(row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS INT) AS pos FROM (SELECT id, url, min(pos) AS p FROM x GROUP BY id, url)",
    "emails", x=_FIRST.format(expr=f"regexp_extract_all(body, {s.lit(rules.URL_EXTRACT['loader'])})")))(_extracted("loader"))


@query("url_extract__web")
def url_extract_web(spark, sf):
    return U.extract_web(fx.emails(spark, sf), "id", F.col("body"))


_FLAGS = {
    "is_shortened": f"{s.netloc_host('url')} IN {s.in_list(rules.SHORTENERS['analyzer'])}",
    "has_percent_encoding": "contains(url, '%')",
    "has_base64_token": s.rx("url", "[A-Za-z0-9+/]{20,}={0,2}"),
    "has_punycode": "contains(lower(url), 'xn--')",
    "has_ip_address": s.rx(s.netloc_host("url"), L.IPV4_STRICT),
    "has_redirect_pattern": "(len(string_split(url, '://')) - 1 > 1 OR len(string_split(url, '//')) - 1 > 2)",
    "has_suspicious_tld": s.ends_any(s.netloc("url"), rules.SUSPICIOUS_TLDS["analyzer"]),
}


@query("url_flags", s.sql("SELECT id, CAST(pos AS INT) AS pos, url, " + ", ".join(f"{s.flag(c)} AS {n}" for n, c in _FLAGS.items()) + " FROM email_urls", "email_urls"))
def url_flags(spark, sf):
    return U.with_columns(fx.email_urls(spark, sf), U.url_flags(F.col("url")))


_HOST = s.netloc_host("url")
_METRICS = {
    "subdomain_depth": f"CAST(greatest(0, len(string_split({_HOST}, '.')) - 2) AS INT)",
    "digit_ratio": s.r6(f"CASE WHEN length({_HOST}) > 0 THEN length(regexp_replace({_HOST}, '[^0-9]', '', 'g')) / length({_HOST})::DOUBLE ELSE 0e0 END"),
    "special_char_ratio": s.r6("CASE WHEN length(url) > 0 THEN length(regexp_replace(url, '[\\p{L}\\p{N}/:.\\-_?=&#@]', '', 'g')) / length(url)::DOUBLE ELSE 0e0 END"),
    "length": "CAST(length(url) AS INT)",
}


@query("url_metrics", s.sql("SELECT id, CAST(pos AS INT) AS pos, " + ", ".join(f"{c} AS {n}" for n, c in _METRICS.items()) + " FROM email_urls", "email_urls"))
def url_metrics(spark, sf):
    m = U.url_metrics(F.col("url"))
    m = {n: round6(c) if n.endswith("ratio") else c for n, c in m.items()}
    return U.with_columns(fx.email_urls(spark, sf), m).drop("url")


@query("url_query_parameters", s.sql(r"""
SELECT page_id, url, CAST(n AS INT) AS n, split_part(part, '=', 1) AS key, regexp_extract(part, '^[^=]*=(.*)$', 1) AS value FROM (
 SELECT page_id, url, unnest(p) AS part, unnest(range(len(p))) AS n FROM (
  SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')) AS p FROM pages))"""))
def url_query_parameters(spark, sf):
    return U.query_parameters(fx.table(spark, sf, "pages").select("page_id", "url"), "page_id")


def _decode(x):
    for e, c in rules.ENTITIES:
        x = f"replace({x}, {s.lit(e)}, {s.lit(c)})"
    return x


_QUOTES = "^[\"']|[\"']$"


def _links_sql(source, key):
    inner = "regexp_extract(a, '(?is)^<a\\b[^>]*>(.*)</a>$', 1)"
    stripped = f"regexp_replace({inner}, '<[^>]*>', '', 'g')"
    text = f"trim(regexp_replace({_decode(stripped)}, '^\\s+|\\s+$', '', 'g'))"
    href_rx = r"""(?i)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
    bare = f"regexp_replace(regexp_extract(a, {s.lit(href_rx)}, 1), {s.lit(_QUOTES)}, '', 'g')"
    href = _decode(bare)
    return f"""SELECT * FROM (SELECT {key}, CAST(n AS INT) AS n, {text} AS link_text, {href} AS href FROM (
 SELECT {key}, unnest(l) AS a, unnest(range(len(l))) AS n FROM (
  SELECT {key}, regexp_extract_all({source[1]}, '(?is)<a\\b[^>]*>.*?</a>') AS l FROM {source[0]}))) WHERE href <> ''"""


@query("html_links", s.sql("SELECT * FROM l", l=_links_sql(("pages", "html"), "page_id")))
def html_links(spark, sf):
    return U.link_table(fx.table(spark, sf, "pages"), F.col("html"), "page_id")


def _all_links(spark, sf):
    """Anchors of mail bodies and of web pages."""
    pages = fx.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("doc"), F.col("html").alias("h"))
    mails = fx.emails(spark, sf).select(F.concat(F.lit("m"), F.col("id")).alias("doc"), F.col("body").alias("h"))
    return U.link_table(pages.unionByName(mails), F.col("h"), "doc")


_ALL = {"src": "SELECT 'p' || page_id AS doc, html AS h FROM pages UNION ALL SELECT 'm' || id, body FROM emails",
        "l": _links_sql(("src", "h"), "doc")}
_T, _U = "lower(trim(link_text))", "lower(trim(href))"
_MISMATCH = {
    "analyzer": f"{_T} <> {_U} AND NOT contains({_T}, {_U}) AND NOT contains({_T}, {s.netloc('href')}) AND contains({_T}, '.') AND length({_T}) < 50",
    "structural": f"{_T} <> {_U} AND NOT contains({_T}, {_U}) AND contains({_T}, '.') AND length({_T}) < 50 AND length({_T}) > 5",
    "extension": f"starts_with(link_text, 'http') AND NOT contains(link_text, {s.host('href')})",
}


@query("link_text_mismatch", s.sql("SELECT doc, n, " + ", ".join(f"{s.flag(c)} AS mismatch_{v}" for v, c in _MISMATCH.items()) + " FROM l", "emails", **_ALL))
def link_text_mismatch(spark, sf):
    t, h = F.col("link_text"), F.col("href")
    return _all_links(spark, sf).select("doc", "n", *[flag(U.link_mismatch(t, h, v)).alias(f"mismatch_{v}") for v in _MISMATCH])


_SL = f"""{s.host('href')} <> '' AND regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND (
 {s.host('href')} IN {s.in_list(rules.SHORTENERS['extension'])} OR regexp_matches({s.host('href')}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$')
 OR {s.rx('href', rules.SUSPICIOUS_LINK_PATTERN)} OR {s.rx('link_text', rules.SUSPICIOUS_LINK_PATTERN)}
 OR len(string_split({s.host('href')}, '.')) > 4 OR ({_MISMATCH['extension']}))"""


@query("suspicious_links", s.sql(f"SELECT doc, n, href, {s.flag(_SL)} AS is_suspicious FROM l UNION ALL SELECT 'u' || id, CAST(pos AS INT), href, {s.flag(_SL)} FROM (SELECT id, pos, url AS href, url AS link_text FROM email_urls)", "email_urls", **_ALL))
def suspicious_links(spark, sf):
    urls = fx.email_urls(spark, sf).select(F.concat(F.lit("u"), F.col("id")).alias("doc"), F.col("pos").alias("n"), F.col("url").alias("link_text"), F.col("url").alias("href"))
    both = _all_links(spark, sf).unionByName(urls)
    return both.select("doc", "n", "href", flag(U.suspicious_link(F.col("link_text"), F.col("href"))).alias("is_suspicious"))


_TRAIL = r"""[.,;:!?)>\]}'"]+$"""
_BLOCK = " OR ".join(f"(num BETWEEN {lo} AND {hi})" for lo, hi in L.BLOCKED_RANGES)


@query("scannable_urls", s.sql(f"""
SELECT id, CAST(pos AS INT) AS pos, url, host FROM numbered
WHERE host <> '' AND host NOT IN {s.in_list(rules.BLOCKED_HOSTS)} AND NOT (num IS NOT NULL AND ({_BLOCK}))""", "emails",
    raw=f"SELECT id, unnest(l) AS u, unnest(range(len(l))) AS pos FROM (SELECT id, list_concat(urls, regexp_extract_all(body, {s.lit(rules.URL_EXTRACT['scanner'])})) AS l FROM emails)",
    tidy=f"SELECT id, pos, CASE WHEN regexp_matches(v, '(?i)^www\\.') THEN 'https://' || v ELSE v END AS url FROM (SELECT id, pos, regexp_replace(trim(u), {s.lit(_TRAIL)}, '') AS v FROM raw)",
    once=f"SELECT id, min(pos) AS pos, arg_min(url, pos) AS url FROM tidy WHERE regexp_matches(url, '(?i)^https?://') AND {s.host('url')} <> '' GROUP BY id, lower(url)",
    numbered=f"SELECT *, CASE WHEN regexp_matches(host, {s.lit(L.IPV4_STRICT)}) THEN split_part(host,'.',1)::BIGINT*16777216 + split_part(host,'.',2)::BIGINT*65536 + split_part(host,'.',3)::BIGINT*256 + split_part(host,'.',4)::BIGINT END AS num FROM (SELECT *, {s.host('url')} AS host FROM once)"))
def scannable_urls(spark, sf):
    return U.scannable_urls(fx.emails(spark, sf, urls=True), "id")


_WRAPPED = "CASE WHEN id % 4 = 0 THEN 'https://www.google.com/url?sa=t&q=' || replace(replace(url, ':', '%3A'), '/', '%2F') || '&z=1' WHEN id % 4 = 1 THEN 'javascript:go()' WHEN id % 4 = 2 THEN 'https://mail.google.com/x' ELSE url END"


@query("redirect_targets", s.sql("""SELECT DISTINCT id, CASE WHEN q <> '' THEN url_decode(q) ELSE href END AS url FROM (
 SELECT *, regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*:[^?#]*\\?(?:[^#]*&)?q=([^&#]+)', 1) AS q FROM h)
 WHERE NOT starts_with(href, 'javascript:') AND NOT contains(href, 'mail.google.com')""", "email_urls", h=f"SELECT id, {_WRAPPED} AS href FROM email_urls"))
def redirect_targets(spark, sf):
    k = F.col("id") % 4
    u = F.col("url")
    escaped = F.replace(F.replace(u, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
    href = (
        F.when(k == 0, F.concat(F.lit("https://www.google.com/url?sa=t&q="), escaped, F.lit("&z=1")))
        .when(k == 1, "javascript:go()").when(k == 2, "https://mail.google.com/x").otherwise(u)
    )
    return U.unwrap_redirects(fx.email_urls(spark, sf).select("id", href.alias("href")), F.col("href"), "id")


def _origin_path(u):
    full = f"(CASE WHEN regexp_matches({u}, '^https?://') THEN {u} ELSE 'https://' || {u} END)"
    path = f"regexp_extract({full}, '^https?://[^/?#]*(/[^?#]*)', 1)"
    return f"lower(regexp_extract({full}, '^(https?://[^/?#]*)', 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END"


def _class(u):
    return f"CASE WHEN regexp_matches({u}, '^https?://') THEN 'standard' WHEN {s.rx(u, rules.SHORTENER_PATTERNS['web_class'])} THEN 'shortened' WHEN {s.rx(u, L.IPV4_SHAPE)} THEN 'ip_based' WHEN regexp_matches({u}, '%[0-9A-Fa-f]{{2}}') THEN 'encoded' ELSE 'www_format' END"


_BARE = "CASE WHEN id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END"


@query("url_normalized_class", s.sql(f"SELECT id, CAST(pos AS INT) AS pos, {_origin_path('u')} AS normalized, {_class('u')} AS url_class, {s.flag(s.any_rx('u', rules.SUSPICIOUS_URL_PATTERNS))} AS is_suspicious FROM b", "email_urls", b=f"SELECT id, pos, {_BARE} AS u FROM email_urls"))
def url_normalized_class(spark, sf):
    u = F.when(F.col("id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    rows = fx.email_urls(spark, sf).select("id", "pos", u.alias("u"))
    u = F.col("u")
    return rows.select("id", "pos", L.origin_and_path(u).alias("normalized"), L.url_class(u).alias("url_class"), flag(L.suspicious_url(u)).alias("is_suspicious"))


_FD = "split_part(CASE WHEN regexp_extract(url, 'https?://([^/]+)', 1) <> '' THEN lower(regexp_extract(url, 'https?://([^/]+)', 1)) ELSE url END, ':', 1)"
_FHID = f"({s.any_in(_FD, rules.SHORTENERS['forensics'])} OR {s.rx(_FD, L.IPV4_SHAPE)})"
_FKW = s.any_rx("lower(url)", rules.FORENSIC_URL_KEYWORDS)
LATEST_URL_REP = "SELECT key, arg_max(malicious, observed_at) AS malicious, arg_max(suspicious, observed_at) AS suspicious, arg_max(harmless, observed_at) AS harmless, arg_max(undetected, observed_at) AS undetected, arg_max(status, observed_at) AS status FROM reputation WHERE kind = '{kind}' GROUP BY key"


@query("url_risk_ladder", s.sql(f"""
SELECT id, CAST(pos AS INT) AS pos, {_FD} AS domain, {s.flag(s.any_in(_FD, rules.SHORTENERS['forensics']))} AS is_shortened,
 CASE WHEN rr > 5e-1 THEN 'CRITICAL' WHEN {_FHID} THEN 'HIGH' WHEN {_FKW} THEN 'MEDIUM' ELSE 'LOW' END AS risk,
 CASE WHEN rr > 5e-1 THEN 'Reputation service flagged as malicious' WHEN {_FHID} THEN 'Shortened/IP-based URL hides true destination'
  WHEN {_FKW} THEN 'URL contains suspicious keywords (login/verify/account)' ELSE 'No obvious URL red-flags detected' END AS reason
FROM (SELECT e.*, least(1e0, 2e0 * (r.malicious + 5e-1 * r.suspicious) / (r.malicious + r.suspicious + r.harmless + r.undetected)) AS rr
 FROM email_urls e LEFT JOIN r ON r.key = lower(e.url))""", "email_urls", "reputation", r=LATEST_URL_REP.format(kind="url")))
def url_risk_ladder(spark, sf):
    rows = fx.email_urls(spark, sf)
    rep = J.latest_reputation(fx.reputation(spark, sf, "url"))
    scored = J.left_on_key(rows.withColumn("key", F.lower("url")), rep, "key")
    return U.with_columns(scored, U.forensic_risk(F.col("url"), J.reputation_risk())).select("id", "pos", "domain", "is_shortened", "risk", "reason")


@query("urls_by_domain", s.sql(f"SELECT {s.host('url')} AS domain, count(*) AS url_count, CAST(bool_or({s.any_rx('url', rules.SUSPICIOUS_URL_PATTERNS)}) AS INT) AS any_suspicious FROM email_urls GROUP BY 1", "email_urls"))
def urls_by_domain(spark, sf):
    u = F.col("url")
    return U.by_domain(fx.email_urls(spark, sf).select(L.hostname(u).alias("domain"), L.suspicious_url(u).alias("is_suspicious")))


_KINDS = ", ".join(f"CAST(count(CASE WHEN kind = '{k}' THEN 1 END) AS INT) AS {n}" for k, n in (("shortened", "shortened_urls"), ("ip_based", "ip_based"), ("encoded", "encoded")))


@query("merged_url_summary__plain", s.sql(f"""
SELECT e.id, CAST(count(o.raw) AS INT) AS url_count, {_KINDS}, CAST(count(CASE WHEN {s.any_rx('o.raw', rules.SUSPICIOUS_URL_PATTERNS)} THEN 1 END) AS INT) AS suspicious_count
FROM emails e LEFT JOIN once o ON o.id = e.id GROUP BY e.id""", "email_urls",
    found=f"SELECT id, unnest(l) AS raw, unnest(range(len(l))) AS pos, 'found' AS kind FROM (SELECT id, regexp_extract_all(body, {s.lit(rules.URL_EXTRACT['plain'])}) AS l FROM emails)",
    allu=f"SELECT id, raw, pos, {_class('raw')} AS kind FROM found UNION ALL SELECT id, url, pos + 1000000, 'provided' FROM email_urls",
    once=f"SELECT id, {s.host('raw')} AS host, arg_min(raw, pos) AS raw, arg_min(kind, pos) AS kind FROM allu GROUP BY 1, 2"))
def merged_url_summary_plain(spark, sf):
    return U.merged_summary(fx.emails(spark, sf, urls=True), "plain")


@query("merged_url_summary__web")
def merged_url_summary_web(spark, sf):
    return U.merged_summary(fx.emails(spark, sf, urls=True), "web")


@query("url_inventory", s.sql(f"""
SELECT count(*) AS total_urls, count(DISTINCT domain) AS distinct_domains, count(CASE WHEN NOT resolves THEN 1 END) AS unresolved_urls,
 count(CASE WHEN {s.rx('domain', rules.SHORTENER_PATTERNS['inventory'])} OR short_mail THEN 1 END) AS suspicious_urls
FROM (SELECT u.domain, d.resolves, bool_or(u.short) OVER (PARTITION BY u.id) AS short_mail FROM u LEFT JOIN d ON d.domain = u.domain)""", "email_urls", "dns_records",
    u=f"SELECT id, {s.host('url')} AS domain, {s.netloc('url')} IN {s.in_list(rules.SHORTENERS['operational'])} AS short FROM email_urls",
    d="SELECT domain, bool_or(rdtype IN ('A', 'AAAA')) AS resolves FROM dns_records GROUP BY domain"))
def url_inventory(spark, sf):
    mails = fx.emails(spark, sf, urls=True).withColumn("mail_shortened", E.any_url(lambda u: L.netloc(u).isin(rules.SHORTENERS["operational"])))
    urls = mails.select("mail_shortened", F.explode("urls").alias("url")).withColumn("domain", L.hostname(F.col("url")))
    return U.inventory(urls, J.dns_status(fx.dns_records(spark, sf)))
