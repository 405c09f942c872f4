"""Domain queries and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import domains as DF
from lurelens.functions import links as L
from lurelens.functions.text import any_match, blank, flag
from lurelens.operators import domains as D
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.registry import query

# senders with display names and several @ so that the variants disagree
_ADDR = "CASE id % 3 WHEN 0 THEN from_email WHEN 1 THEN '<' || from_email || '>' ELSE 'Desk@HQ <' || from_email || '>' END"


def _addresses(spark, sf):
    sender = F.col("from_email")
    k = F.col("id") % 3
    a = F.when(k == 0, sender).when(k == 1, F.concat(F.lit("<"), sender, F.lit(">"))).otherwise(
        F.concat(F.lit("Desk@HQ <"), sender, F.lit(">")))
    return fx.emails(spark, sf, text=False).select("id", a.alias("address"))


@query("sender_domain_variants", s.sql(f"""
SELECT id, lower(string_split(regexp_replace(a, '^[<>]+|[<>]+$', '', 'g'), '@')[2]) AS domain_first, {s.last_at('a')} AS domain_last, lower(string_split(a, '@')[-1]) AS domain_whole
FROM (SELECT id, {_ADDR} AS a FROM emails)""", "emails"))
def sender_domain_variants(spark, sf):
    a = F.col("address")
    return _addresses(spark, sf).select("id", *[DF.sender_domain(a, v).alias(f"domain_{v}") for v in ("first", "last", "whole")])


ALL_DOMAINS = f"SELECT DISTINCT d FROM (SELECT {s.lenient_host('url')} AS d FROM email_urls UNION ALL SELECT {s.last_at('from_email')} FROM emails UNION ALL SELECT 'accounts.' || {s.last_at('from_email')} FROM emails UNION ALL SELECT {s.last_at('from_email')} || '.gov.uk' FROM emails) WHERE d <> ''"


def corpus_domains(spark, sf):
    """Distinct domains of URLs and senders, with two derived forms per sender."""
    urls = fx.email_urls(spark, sf).select(L.lenient_hostname(F.col("url")).alias("domain"))
    own = DF.sender_domain(blank("from_email"), "last")
    senders = fx.emails(spark, sf, text=False).select(
        F.explode(F.array(own, F.concat(F.lit("accounts."), own), F.concat(own, F.lit(".gov.uk")))).alias("domain"))
    return urls.unionByName(senders).filter("domain <> ''").distinct()


_PREFIX = "CASE WHEN ends_with({d}, '.' || {b}) THEN substr({d}, 1, length({d}) - length({b}) - 1) ELSE '' END"


@query("base_domain", s.sql(f"SELECT d AS domain, {s.base('d', 'analyzer')} AS base_analyzer, {s.base('d', 'trust')} AS base_trust, {_PREFIX.format(d='d', b='(' + s.base('d') + ')')} AS subdomain FROM x", "email_urls", x=ALL_DOMAINS))
def base_domain(spark, sf):
    d = F.col("domain")
    return corpus_domains(spark, sf).select(
        "domain", DF.base_domain(d, "analyzer").alias("base_analyzer"), DF.base_domain(d).alias("base_trust"),
        DF.subdomain_prefix(d, DF.base_domain(d)).alias("subdomain"))


TRUST = f"""SELECT d, b, match_type, match_type IN ('exact', 'subdomain', 'gov_pattern') AS ok,
 CASE WHEN match_type = 'gov_pattern' THEN 'government' ELSE coalesce(category, '') END AS category, known FROM (
 SELECT x.d, x.b, t.category, t.base IS NOT NULL AS known, CASE WHEN t.base IS NOT NULL THEN CASE WHEN pre = '' THEN 'exact'
   WHEN list_contains(t.subs, string_split(pre, '.')[-1]) OR list_contains(t.subs, pre) THEN 'subdomain' ELSE 'unknown_subdomain' END
  WHEN {s.any_rx('x.d', rules.GOVERNMENT_PATTERNS)} THEN 'gov_pattern' ELSE 'none' END AS match_type
 FROM (SELECT d, b, {_PREFIX.format(d='d', b='b')} AS pre FROM (SELECT d, {s.base('d')} AS b FROM x)) x LEFT JOIN trusted t ON t.base = x.b)"""


@query("trusted_domains", s.sql("SELECT d AS domain, b AS base_domain, CAST(ok AS INT) AS trusted, category, match_type FROM t", "email_urls", "trusted", x=ALL_DOMAINS, t=TRUST))
def trusted_domains(spark, sf):
    return corpus_domains(spark, sf).select("domain", DF.trust_match(F.col("domain")).alias("m")).select(
        "domain", "m.base_domain", flag(DF.is_trusted(F.col("m"))).alias("trusted"), DF.category(F.col("m")).alias("category"), "m.match_type")


@query("brand_impersonation", s.sql("SELECT t.d AS domain, b.brand FROM t JOIN brands b ON regexp_matches(t.d, b.pattern) WHERE NOT t.known", "email_urls", "trusted", "brands", x=ALL_DOMAINS, t=TRUST))
def brand_impersonation(spark, sf):
    return D.impersonation_hits(corpus_domains(spark, sf), "domain").select("domain", "brand")


_MORE = f"SELECT DISTINCT b FROM (SELECT {s.base('d', 'analyzer')} AS b FROM x UNION ALL SELECT {s.base("'g' || substr(d, 2)", 'analyzer')} FROM x UNION ALL SELECT replace(replace(t.base, 'l', '1'), 'o', '0') FROM trusted t) WHERE b <> ''"


def _with_typos(spark, sf):
    """Corpus domains plus derived misspellings: swapped first letter, digits in trusted names."""
    own = corpus_domains(spark, sf)
    swapped = own.select(F.concat(F.lit("g"), F.expr("substr(domain, 2)")).alias("domain"))
    names = F.array(*[F.lit(b.replace("l", "1").replace("o", "0")) for b in rules.TRUSTED_DOMAINS])
    return own.unionByName(swapped).unionByName(spark.range(1).select(F.explode(names).alias("domain")))


@query("lookalike_candidates", s.sql("SELECT b AS base, t.base AS brand, CAST(levenshtein(b, t.base) AS INT) AS distance FROM m JOIN trusted t ON b <> t.base AND levenshtein(b, t.base) < 2.00000001e-1 * (length(b) + length(t.base))", "email_urls", "trusted", x=ALL_DOMAINS, m=_MORE.replace("SELECT replace(replace(t.base, 'l', '1'), 'o', '0') FROM trusted t", f"SELECT {s.base('r', 'analyzer')} FROM (SELECT replace(replace(t.base, 'l', '1'), 'o', '0') AS r FROM trusted t)")))
def lookalike_candidates(spark, sf):
    return D.lookalike_candidates(_with_typos(spark, sf), "domain").select("base", "brand", F.levenshtein("base", "brand").alias("distance"))


@query("lookalike_domains")
def lookalike_domains(spark, sf):
    return D.lookalike_domains(_with_typos(spark, sf), "domain")


_PLAIN = "translate(d, '013', 'oie')"
_TYPO = " OR ".join(f"(contains(d, '{c}') AND ({_PLAIN} = '{c}.com' OR starts_with({_PLAIN}, '{c}.')))" for c in rules.TYPO_COMPANIES)


@query("digit_substitution", s.sql(f"SELECT d AS domain, CAST(({_TYPO}) AS INT) AS is_typo FROM x", "email_urls", x=ALL_DOMAINS))
def digit_substitution(spark, sf):
    return corpus_domains(spark, sf).select("domain", D.digit_substitution(F.col("domain")).alias("is_typo"))


CROSS = {
    "m": f"SELECT id, sd, rd, reply_to, {s.base('sd')} AS sb, {s.base('rd')} AS rb FROM (SELECT id, reply_to, {s.last_at('from_email')} AS sd, {s.last_at("coalesce(reply_to, '')")} AS rd FROM emails)",
    "ud": f"SELECT id, pos, d, {s.base('d')} AS b FROM (SELECT id, pos, {s.lenient_host('url')} AS d FROM email_urls) WHERE d <> ''",
    "mm": "SELECT ud.id, string_agg(ud.d, ',' ORDER BY ud.pos) AS mismatched, string_agg(ud.d, ''', ''' ORDER BY ud.pos) AS quoted FROM ud JOIN m ON m.id = ud.id WHERE m.sd <> '' AND ud.b <> m.sb AND ud.b NOT IN (SELECT base FROM trusted) GROUP BY ud.id",
    "c": "SELECT m.*, m.sd <> '' AND m.rd <> '' AND m.sb <> m.rb AS reply_mismatch, mm.mismatched IS NOT NULL AS url_mismatch, coalesce(mm.mismatched, '') AS mismatched, mm.quoted FROM m LEFT JOIN mm ON mm.id = m.id",
}


@query("domain_cross_check", s.sql("SELECT id, sd AS sender_domain, rd AS reply_to_domain, CAST(reply_mismatch AS INT) AS reply_mismatch, CAST(url_mismatch AS INT) AS url_mismatch, mismatched FROM c", "email_urls", "trusted", **CROSS))
def domain_cross_check(spark, sf):
    return D.cross_check(fx.emails(spark, sf, urls=True, text=False)).select(
        "id", "sender_domain", "reply_to_domain", "reply_mismatch", "url_mismatch", F.array_join("mismatched_url_domains", ",").alias("mismatched"))


_STEP = {
    "s1": "CASE WHEN s_ok THEN 4e-1 WHEN s_type = 'unknown_subdomain' THEN 1e-1 ELSE 0e0 END",
    "s2": "CASE WHEN n_imp > 0 THEN greatest(0e0, s1 - 3e-1) ELSE s1 END",
    "s3": "CASE WHEN reply_mismatch THEN greatest(0e0, s2 - 2e-1) ELSE s2 END",
    "s4": "CASE WHEN url_mismatch AND NOT s_ok THEN greatest(0e0, s3 - 1e-1) ELSE s3 END",
    "s5": "CASE WHEN r_ok AND s_ok THEN s4 + 1e-1 ELSE s4 END",
    "s6": "CASE WHEN n_trusted > 0 AND s_ok THEN s5 + 1e-1 ELSE s5 END",
}
TRUST_VIEWS = {
    **CROSS,
    "x": "SELECT DISTINCT d FROM (SELECT d FROM ud UNION ALL SELECT sd FROM m UNION ALL SELECT rd FROM m) WHERE d <> ''",
    "t": TRUST,
    "alld": "SELECT id, -1 AS pos, sd AS d FROM m WHERE sd <> '' UNION ALL SELECT id, pos, d FROM ud",
    "imp": "SELECT a.id, a.pos, b.k, a.d, b.brand FROM alld a JOIN t ON t.d = a.d JOIN brands b ON regexp_matches(a.d, b.pattern) WHERE NOT t.known",
    "impa": "SELECT id, count(*) AS n_imp, string_agg('Brand impersonation detected: ''' || d || ''' mimics ' || brand, ' | ' ORDER BY pos, k) AS imp_text, list('Brand impersonation detected: ''' || d || ''' mimics ' || brand ORDER BY pos, k) AS imp_list, string_agg(DISTINCT brand, ', ' ORDER BY brand) AS brands FROM imp GROUP BY id",
    "ut": "SELECT ud.id, count(*) AS n_trusted FROM ud JOIN t ON t.d = ud.d WHERE t.ok GROUP BY ud.id",
    "j": "SELECT c.*, coalesce(st.ok, false) AS s_ok, coalesce(st.match_type, 'none') AS s_type, coalesce(st.category, '') AS s_cat, coalesce(contains(c.reply_to, '@') AND rt.ok, false) AS r_ok, coalesce(impa.n_imp, 0) AS n_imp, impa.imp_list, impa.brands, coalesce(ut.n_trusted, 0) AS n_trusted FROM c LEFT JOIN t st ON st.d = c.sd LEFT JOIN t rt ON rt.d = c.rd LEFT JOIN impa ON impa.id = c.id LEFT JOIN ut ON ut.id = c.id",
    "score": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _STEP.items()) + " FROM j",
    "trust": """SELECT *, round(greatest(0e0, least(1e0, s6)), 3) AS trust_score,
 list_filter([CASE WHEN s_ok THEN 'Sender domain ''' || sd || ''' is a verified ' || s_cat || ' domain' END,
  CASE WHEN r_ok AND s_ok THEN 'Reply-To domain ''' || rd || ''' is also verified' END,
  CASE WHEN n_trusted > 0 AND s_ok THEN n_trusted || ' URL(s) point to verified domains' END], lambda v: v IS NOT NULL) AS signals,
 list_filter(list_concat(list_concat([CASE WHEN s_type = 'unknown_subdomain' THEN 'Sender uses unrecognized subdomain of trusted domain: ' || sd END], coalesce(imp_list, [])),
  [CASE WHEN reply_mismatch THEN 'Sender domain (' || sd || ') differs from Reply-To (' || rd || ')' END,
   CASE WHEN reply_mismatch AND url_mismatch THEN 'URL domains [''' || quoted || '''] don''t match sender (' || sd || ')' END,
   CASE WHEN r_ok AND NOT s_ok THEN 'Reply-To is trusted (' || rd || ') but sender is not — suspicious' END]), lambda v: v IS NOT NULL) AS warnings
 FROM score""",
}


@query("trust_score", s.sql("SELECT id, trust_score, CAST(n_imp AS INT) AS impersonations, CAST(n_trusted AS INT) AS trusted_urls, array_to_string(signals, ' | ') AS signals, array_to_string(warnings, ' | ') AS warnings FROM trust", "email_urls", "trusted", "brands", **TRUST_VIEWS))
def trust_score(spark, sf):
    out = D.trust_score(fx.emails(spark, sf, urls=True, text=False))
    return out.select(
        "id", "trust_score", F.size("impersonations").alias("impersonations"), "trusted_urls",
        F.array_join("trust_signals", " | ").alias("signals"), F.array_join("trust_warnings", " | ").alias("warnings"))


_DOM = "string_split(from_email, '@')[2]"
_HOMO = s.any_rx(_DOM, rules.HOMOGRAPH_PATTERNS)


@query("address_flags", s.sql(f"SELECT id, CAST({_HOMO} AS INT) AS has_homograph, CAST(lower({_DOM}) IN {s.in_list(rules.FREEMAIL)} AS INT) AS is_freemail, CAST({_HOMO} OR {s.rx(_DOM, rules.THROWAWAY_PATTERN)} AS INT) AS is_suspicious_domain FROM emails", "emails"))
def address_flags(spark, sf):
    return fx.emails(spark, sf, text=False).select("id", *[c.alias(n) for n, c in D.address_flags(F.col("from_email")).items()])


_BRAND_ROWS = ", ".join(f"({i}, '{b}')" for i, b in enumerate(rules.BRAND_WORDS))


@query("brand_mentions", s.sql("SELECT e.id, coalesce(b.brands, '') AS brands FROM emails e LEFT JOIN b ON b.id = e.id", "email_urls",
    h=f"SELECT id, min(pos * 10 + w.k) AS o, w.brand FROM email_urls, (VALUES {_BRAND_ROWS}) AS w(k, brand) WHERE contains({s.host('url')}, w.brand) GROUP BY id, w.brand",
    b="SELECT id, string_agg(brand, ',' ORDER BY o) AS brands FROM h GROUP BY id"))
def brand_mentions(spark, sf):
    hosts = F.transform("urls", L.hostname)
    return fx.emails(spark, sf, urls=True, text=False).select("id", F.array_join(D.brand_mentions(hosts), ",").alias("brands"))
