"""Indicators of compromise, content risk, header intelligence and risk factors. All in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.risk import ladder
from lurelens.functions.stages import unpacked
from lurelens.functions.text import any_match, blank, flag
from lurelens.operators import links as U
from lurelens.operators.domains import address_flags, brand_mentions, web_domain

NO_STRINGS = "array<string>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ip_class(ip: Column) -> Column:
    first, second = (F.get(F.split(ip, r"\."), i).cast("int") for i in (0, 1))
    return (
        F.when(first == 127, "loopback")
        .when((first == 169) & (second == 254), "link_local")
        .when(first == 224, "multicast")
        .when(first == 255, "broadcast")
        .when(first <= 9, "class_a_public")
        .when(first.between(11, 126), "public")
        .when(first.isin(172, 10, 192), "private")
        .otherwise("public")
    )


def is_private_ip(ip: Column) -> Column:
    first, second = (F.get(F.split(ip, r"\."), i).cast("int") for i in (0, 1))
    return (
        first.isin(10, 127)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
    )


def addresses(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, rules.ADDRESS_PATTERN), F.lower))


def public_ips(text: Column) -> Column:
    return F.filter(F.array_distinct(_all(text, rules.IPV4_PATTERN)), lambda ip: ~is_private_ip(ip))


def with_iocs(df: DataFrame) -> DataFrame:
    body = blank("body")
    return df.select("*", addresses(body).alias("found_addresses"), public_ips(body).alias("found_ips"))


def ioc_counts(df: DataFrame) -> DataFrame:
    body = blank("body")

    def freemail(a: Column) -> Column:
        return F.element_at(F.split(a, "@"), 2).isin(rules.FREEMAIL)

    def suspicious(a: Column) -> Column:
        domain = F.element_at(F.split(a, "@"), 2)
        return any_match(domain, rules.HOMOGRAPH_PATTERNS) | domain.rlike(rules.THROWAWAY_PATTERN)

    return with_iocs(df).select(
        "id",
        F.size("found_addresses").alias("addresses"),
        F.size(F.filter("found_addresses", freemail)).alias("freemail"),
        F.size(F.filter("found_addresses", lambda a: ~freemail(a))).alias("corporate"),
        F.size(F.filter("found_addresses", suspicious)).alias("suspicious_addresses"),
        F.size("found_ips").alias("public_ips"),
        F.size(_all(body, rules.IPV6_PATTERN)).alias("ipv6"),
        F.size(_all(body, rules.MAC_PATTERN)).alias("mac"),
        F.size(F.array_distinct(_all(body, rules.PORT_PATTERN, 1))).alias("ports"),
        F.size(_all(body, rules.DNS_TEXT_PATTERN)).alias("dns_strings"),
    )


def ioc_rows(df: DataFrame) -> DataFrame:
    """One row per (mail, indicator): kind, value, class."""
    address = F.transform(
        "found_addresses", lambda a: F.struct(F.lit("address").alias("kind"), a.alias("value"), F.element_at(F.split(a, "@"), 2).alias("class"))
    )
    ip = F.transform("found_ips", lambda i: F.struct(F.lit("ipv4").alias("kind"), i.alias("value"), ip_class(i).alias("class")))
    return unpacked(with_iocs(df), ["id"], F.concat(address, ip), "_n", "x").select("id", "x.*")


# -- content risk -----------------------------------------------------------------
def content_counts() -> dict[str, Column]:
    body = blank("body")
    return {name: F.regexp_count(body, F.lit(pattern)) for name, (pattern, _, _) in rules.CONTENT_RISK.items()}


def content_risk(df: DataFrame) -> DataFrame:
    """Adds six counts, score (capped at 100), level and red flags."""
    rows = df.select("*", *[c.alias(n) for n, c in content_counts().items()])
    score = sum(
        (F.when(F.col(n) > 0, points).otherwise(0) for n, (_, points, _) in rules.CONTENT_RISK.items()), F.lit(0)
    )
    flags = F.filter(
        F.array(*[F.when(F.col(n) > 0, rules.CONTENT_RISK[n][2]) for n in rules.RED_FLAG_ORDER]), lambda x: x.isNotNull()
    )
    return rows.select(
        "*", F.least(score, F.lit(100)).alias("content_score"), ladder(score, "content").alias("content_level"),
        flags.alias("red_flags"),
    )


# -- headers ------------------------------------------------------------------------
HEADER_FLAGS = [
    "missingReplyTo", "hiddenReplyTo", "multipleFromAddresses", "suspiciousSPF", "suspiciousDKIM", "suspiciousRET",
]


def header_intelligence(df: DataFrame) -> DataFrame:
    subject, sender, reply, body = (blank(c) for c in ("subject", "from_email", "reply_to", "body"))
    both = (sender != "") & (reply != "")
    own = address_flags(F.col("from_email"))
    flags = {
        "missingReplyTo": reply == "",
        "hiddenReplyTo": reply == "",
        "multipleFromAddresses": F.length(sender) - F.length(F.replace(sender, F.lit("@"), F.lit(""))) > 1,
        "suspiciousSPF": body.rlike(rules.SPF_FAIL_PATTERN),
        "suspiciousDKIM": body.rlike(rules.DKIM_FAIL_PATTERN),
        "suspiciousRET": body.rlike(rules.NULL_RETURN_PATTERN),
    }
    return df.select(
        "*",
        flag(subject.rlike(rules.SUBJECT_URGENT_PATTERN)).alias("subject_urgency"),
        flag(subject.rlike(rules.SUBJECT_EXECUTIVE_PATTERN)).alias("subject_executive"),
        *[F.regexp_count(subject, F.lit(p)).alias(f"subject_{n}") if n != "urgency" else F.regexp_count(subject, F.lit(p)).alias("subject_urgency_words") for n, p in rules.SUBJECT_CATEGORIES.items()],
        own["has_homograph"].alias("sender_homograph"),
        own["is_freemail"].alias("sender_freemail"),
        flag(both & (web_domain(sender) != web_domain(reply))).alias("domain_mismatch_reply_to"),
        flag(sender != reply).alias("different_reply_to"),
        *[flag(c).alias(n) for n, c in flags.items()],
    )


def spoofing_risk(df: DataFrame) -> DataFrame:
    """Adds spoofing level and score, alignment issues and authentication score."""
    absent = (F.col("missingReplyTo") == 1) | (F.col("hiddenReplyTo") == 1)
    level = (
        F.when(F.col("sender_homograph") == 1, "critical").when(F.col("domain_mismatch_reply_to") == 1, "high")
        .when(absent, "medium").otherwise("low")
    )
    score = F.when(level == "critical", 95).when(level == "high", 75).when(level == "medium", 50).otherwise(0)
    issues = F.col("suspiciousSPF") + F.col("suspiciousDKIM") + F.col("multipleFromAddresses")
    return df.select(
        "*", level.alias("spoofing_level"), score.alias("spoofing_score"), issues.alias("alignment_issues"),
        F.greatest(F.lit(0), F.lit(100) - issues * 30).alias("authentication_score"),
    )


def auth_status(df: DataFrame) -> DataFrame:
    """SPF, DKIM and derived DMARC status with the share that passes."""
    spf_text = F.upper(F.coalesce(F.col("headers").getItem("received-spf"), F.lit("")))
    dkim_text = F.coalesce(F.col("headers").getItem("dkim-signature"), F.lit(""))
    spf = F.when(spf_text.contains("PASS"), "PASS").when(spf_text.contains("FAIL"), "FAIL").otherwise("NONE")
    dkim = F.when(dkim_text != "", "PASS").otherwise("NONE")
    dmarc = (
        F.when((spf == "FAIL") | (dkim == "NONE"), "FAIL").when((spf == "PASS") & (dkim == "PASS"), "PASS").otherwise("NONE")
    )
    return df.select(
        "*", spf.alias("spf_status"), dkim.alias("dkim_status"), dmarc.alias("dmarc_status"),
        ((flag(spf == "PASS") + flag(dkim == "PASS") + flag(dmarc == "PASS")) / F.lit(3.0)).alias("auth_score"),
    )


# -- risk factors and forensics ------------------------------------------------------
def _full(df: DataFrame, variant: str) -> DataFrame:
    rows = U.with_merged(content_risk(header_intelligence(with_iocs(df))), variant)
    return rows.select("*", *[c.alias(f"u_{n}") for n, c in U.merged_counts().items()])


def risk_factors(df: DataFrame, variant: str = "web") -> DataFrame:
    """One row per (mail, factor), ordered critical to low: rank, category, severity, description, weight."""

    def factor(hit: Column, category: str, severity: str, text, weight: float) -> Column:
        rank = {"critical": 0, "high": 1, "medium": 2, "low": 3}[severity]
        body = text if isinstance(text, Column) else F.lit(text)
        return F.when(
            hit,
            F.struct(
                F.lit(rank).alias("severity_rank"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                body.alias("description"), F.lit(weight).alias("weight"),
            ),
        )

    def counted(name: str, text: str) -> Column:
        return F.concat(F.col(name).cast("string"), F.lit(text))

    factors = [
        factor(F.col("u_shortened_urls") > 0, "URL_RISK", "medium", counted("u_shortened_urls", " shortened URL(s) detected"), 0.15),
        factor(F.col("u_ip_based") > 0, "URL_RISK", "high", "IP-based URL(s) detected instead of domain names", 0.25),
        factor(F.col("u_suspicious_count") > 0, "URL_RISK", "high", counted("u_suspicious_count", " suspicious URL pattern(s)"), 0.20),
        factor(F.col("sender_freemail") == 1, "SENDER_RISK", "medium", "Sender uses free email provider", 0.10),
        factor(F.col("sender_homograph") == 1, "SENDER_RISK", "critical", "Homograph/lookalike domain detected", 0.30),
        factor(F.col("domain_mismatch_reply_to") == 1, "AUTH_RISK", "high", "Sender domain mismatches Reply-To domain", 0.20),
        *[factor(F.col(n) == 1, "AUTH_RISK", "high", f"Missing/suspicious: {n}", 0.15) for n in HEADER_FLAGS],
        factor((F.col("passwords") > 0) | (F.col("credit_cards") > 0), "CREDENTIAL_RISK", "critical", "Requests for sensitive credentials detected", 0.40),
        factor(F.col("urgency_language") > 0, "SOCIAL_ENG_RISK", "high", "Urgency/pressure tactics detected", 0.15),
    ]
    found = F.filter(F.array(*factors), lambda x: x.isNotNull())
    numbered = F.transform(found, lambda f, i: F.struct(f.severity_rank.alias("rank"), i.alias("i"), f.alias("f")))
    rows = unpacked(_full(df, variant), ["id"], F.array_sort(numbered), "n", "x")
    return rows.select("id", "n", "x.f.*")


def forensic_summary(df: DataFrame, variant: str = "web") -> DataFrame:
    hosts = F.transform("merged", lambda r: r.host)
    dots = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))
    return _full(df, variant).select(
        "id",
        F.size("merged").alias("domains_count"),
        F.size("found_ips").alias("external_ips"),
        F.size("found_addresses").alias("email_addresses"),
        F.array_join(brand_mentions(hosts), ",").alias("brands"),
        (F.col("passwords") + F.col("credit_cards")).alias("credential_harvesting"),
        F.col("urgency_language").alias("urgent_language"),
        "payment_requests",
        sum((F.col(n) for n in HEADER_FLAGS[1:]), F.col(HEADER_FLAGS[0])).alias("authentication_abuse"),
        F.size(F.filter(hosts, lambda h: dots(h) > 1)).alias("subdomain_abuse"),
    )
