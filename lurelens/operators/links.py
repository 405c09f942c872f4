"""Operators over URLs: one row per (mail, URL), link tables, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import links as L
from lurelens.functions.domains import base_domain
from lurelens.functions.stages import sealed, unpacked
from lurelens.functions.text import any_in, any_match, blank, flag

NO_STRINGS = "array<string>"


# -- extraction ---------------------------------------------------------------
def extract(text: Column, variant: str) -> Column:
    """URLs of a text as an array; the loader variant keeps the first of equal URLs."""
    found = F.regexp_extract_all(blank(text), F.lit(rules.URL_EXTRACT[variant]), F.lit(0))
    return F.array_distinct(found) if variant == "loader" else found


WEB_PATTERNS = [
    r"(?i)https?://(?:[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=]|%[0-9A-Fa-f]{2})+",
    r"(?i)(?<![@\s])(?:www\.)?[a-zA-Z0-9\-._~:/?#@!$&'()*+,;=%]+\.(?:com|org|net|edu|gov|co|uk|de|fr|ru|cn|io|app|dev|shop|online|site|website|click|download|bid|accountupdate|secure|verify|confirm|update)\b",
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b(?::\d+)?(?:/[^\s]*)?\b",
    r"(?i)(?:https?://)?(?:bit\.ly|tinyurl\.com|short\.link|ow\.ly|goo\.gl)/[a-zA-Z0-9]+",
    r"(?i)https?://[^\s]+(?:\?[^\s]*)?",
]


def web_urls(text: Column) -> Column:
    """ARRAY<STRUCT(raw, host)> of the five web patterns in pattern order."""
    found = F.concat(*[F.regexp_extract_all(blank(text), F.lit(p), F.lit(0)) for p in WEB_PATTERNS])
    rows = F.transform(found, lambda u: F.struct(u.alias("raw"), L.hostname(L.web_url(u)).alias("host")))
    return F.filter(rows, lambda r: r.host != "")


def extract_web(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One row per (mail, host): the first URL found for that host."""
    rows = unpacked(df, [id_col], web_urls(text), "pos", "u")
    first = rows.groupBy(id_col, F.col("u.host").alias("host")).agg(F.min_by("u.raw", "pos").alias("raw"))
    raw = F.col("raw")
    return first.select(
        id_col, "host", "raw", L.origin_and_path(raw).alias("url"),
        flag(L.suspicious_url(raw)).alias("is_suspicious"), L.url_class(raw).alias("extraction_method"),
    )


# -- per-URL columns ------------------------------------------------------------
def is_shortened(url: Column, variant: str = "analyzer") -> Column:
    return L.netloc_host(url).isin(rules.SHORTENERS[variant])


def has_ip_host(url: Column) -> Column:
    return L.netloc_host(url).rlike(L.IPV4_STRICT)


def url_flags(url: Column) -> dict[str, Column]:
    return {
        "is_shortened": flag(is_shortened(url)),
        "has_percent_encoding": flag(url.contains("%")),
        "has_base64_token": flag(url.rlike(r"[A-Za-z0-9+/]{20,}={0,2}")),
        "has_punycode": flag(F.lower(url).contains("xn--")),
        "has_ip_address": flag(has_ip_host(url)),
        "has_redirect_pattern": flag(
            (F.regexp_count(url, F.lit("://")) > 1) | (F.regexp_count(url, F.lit("//")) > 2)
        ),
        "has_suspicious_tld": flag(L.ends_with_any(L.netloc(url), rules.SUSPICIOUS_TLDS["analyzer"])),
    }


def url_metrics(url: Column) -> dict[str, Column]:
    host = L.netloc_host(url)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    digits = F.length(F.regexp_replace(host, "[^0-9]", ""))
    special = F.length(F.regexp_replace(url, r"[\p{L}\p{N}/:.\-_?=&#@]", ""))
    return {
        "subdomain_depth": F.greatest(F.lit(0), dots - 1),
        "digit_ratio": F.when(F.length(host) > 0, digits / F.length(host)).otherwise(0.0),
        "special_char_ratio": F.when(F.length(url) > 0, special / F.length(url)).otherwise(0.0),
        "length": F.length(url),
    }


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def query_parameters(df: DataFrame, *keys: str) -> DataFrame:
    """One row per (URL, parameter, value); parameters without a value are dropped."""
    parts = F.filter(
        F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: p.rlike("^[^=]*=.")
    )

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), c)

    return unpacked(df, [*keys, "url"], parts, "n", "part").select(
        *keys, "url", "n",
        decoded(F.regexp_extract("part", "^([^=]*)=", 1)).alias("key"),
        decoded(F.regexp_extract("part", "^[^=]*=(.*)$", 1)).alias("value"),
    )


# -- links in HTML ------------------------------------------------------------
def decode_entities(text: Column) -> Column:
    for entity, char in rules.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def anchors(html: Column) -> Column:
    """ARRAY<STRUCT(link_text, href)> of the anchors that carry an href."""
    found = F.regexp_extract_all(blank(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))

    def one(a: Column) -> Column:
        href = F.regexp_extract(a, r"""(?i)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
        inner = F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)
        text = decode_entities(F.regexp_replace(inner, r"<[^>]*>", ""))
        return F.struct(
            F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("link_text"),
            decode_entities(F.regexp_replace(href, r"""^["']|["']$""", "")).alias("href"),
        )

    return F.transform(found, one)


def link_table(df: DataFrame, html: Column, *keys: str) -> DataFrame:
    """One row per anchor with an href: (keys, n, link_text, href)."""
    rows = unpacked(df, keys, anchors(html), "n", "a")
    return rows.select(*keys, "n", "a.link_text", "a.href").filter(F.col("href") != "")


def link_mismatch(text: Column, href: Column, variant: str) -> Column:
    t, u = F.lower(F.trim(text)), F.lower(F.trim(href))
    if variant == "analyzer":
        exempt = (t == u) | F.contains(t, u) | F.contains(t, L.netloc(href))
        return ~exempt & t.contains(".") & (F.length(t) < 50)
    if variant == "structural":
        exempt = (t == u) | F.contains(t, u)
        return ~exempt & t.contains(".") & (F.length(t) < 50) & (F.length(t) > 5)
    if variant == "extension":
        return F.startswith(text, F.lit("http")) & ~F.contains(text, L.hostname(href))
    raise ValueError(variant)


def suspicious_link(text: Column, href: Column) -> Column:
    host = L.hostname(href)
    absolute = (host != "") & href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return absolute & (
        host.isin(rules.SHORTENERS["extension"])
        | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
        | href.rlike(rules.SUSPICIOUS_LINK_PATTERN)
        | text.rlike(rules.SUSPICIOUS_LINK_PATTERN)
        | (F.size(F.split(host, r"\.")) > 4)
        | link_mismatch(text, href, "extension")
    )


# -- preparation for scanning ---------------------------------------------------
def normalize_for_scan(url: Column) -> Column:
    """NULL when the URL cannot be scanned."""
    tidy = F.regexp_replace(F.trim(url), r"""[.,;:!?)>\]}'"]+$""", "")
    full = F.when(tidy.rlike(r"(?i)^www\."), F.concat(F.lit("https://"), tidy)).otherwise(tidy)
    open_bracket = full.rlike(r"^[^/?#]*//[^/?#]*\[[^\]/?#]*(?:[/?#]|$)")
    usable = full.rlike(r"(?i)^https?://") & (F.regexp_extract(full, L.HOST, 1) != "") & ~open_bracket
    return F.when(usable, full)


def blocked_ipv6(host: Column) -> Column:
    """True for IPv6 hosts outside the public ranges, read from the leading groups."""
    groups = F.split(host, ":")
    lead = F.coalesce(F.conv(F.get(groups, 0), 16, 10).cast("bigint"), F.lit(0))
    second = F.coalesce(F.conv(F.get(groups, 1), 16, 10).cast("bigint"), F.lit(0))
    third = F.coalesce(F.conv(F.get(groups, 2), 16, 10).cast("bigint"), F.lit(0))
    public_exception = (
        host.isin("2001:1::1", "2001:1::2")
        | (second == 0x3)
        | ((second == 0x4) & (third == 0x112))
        | second.between(0x20, 0x3F)
    )
    special = (
        ((lead == 0x2001) & second.between(0, 0x1FF) & ~public_exception)
        | ((lead == 0x2001) & (second == 0xDB8))
        | (lead == 0x2002)
        | ((lead == 0x3FFF) & second.between(0, 0xFFF))
    )
    global_range = lead.between(0x2000, 0x3FFF) | lead.between(0xFEC0, 0xFEFF)
    return F.contains(host, F.lit(":")) & (~global_range | special)


def blocked_host(host: Column) -> Column:
    return (
        (host == "") | host.isin(rules.BLOCKED_HOSTS) | L.blocked_ipv4(host) | blocked_ipv6(host)
    )


def scannable_urls(df: DataFrame, *keys: str) -> DataFrame:
    """Given URLs, then body URLs; first of equal URLs wins; private targets removed."""
    raw = F.concat(F.coalesce("urls", F.array().cast(NO_STRINGS)), extract(F.col("body"), "scanner"))
    rows = unpacked(df, keys, raw, "pos", "raw").select(*keys, "pos", normalize_for_scan(F.col("raw")).alias("url"))
    rows = sealed(rows).filter(F.col("url").isNotNull())
    first = rows.groupBy(*keys, F.lower("url").alias("url_key")).agg(
        F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url")
    )
    hosts = sealed(first.select(*keys, "pos", "url", L.hostname(F.col("url")).alias("host")))
    return hosts.filter(~blocked_host(F.col("host")))


def unwrap_redirects(df: DataFrame, href: Column, *keys: str) -> DataFrame:
    """Targets behind ``?q=`` wrappers; script links and the mail client's own links are skipped."""
    target = F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*:[^?#]*\?(?:[^#]*&)?q=([^&#]+)", 1)
    plain = F.coalesce(F.try_url_decode(target), target)
    return (
        df.filter(~F.startswith(href, F.lit("javascript:")) & ~href.contains("mail.google.com") & (href != ""))
        .select(*keys, F.when(target != "", plain).otherwise(href).alias("url"))
        .distinct()
    )


# -- risk and rollups -----------------------------------------------------------
def forensic_domain(url: Column) -> Column:
    found = F.regexp_extract(url, r"https?://([^/]+)", 1)
    return F.split_part(F.when(found != "", F.lower(found)).otherwise(url), F.lit(":"), F.lit(1))


def forensic_risk(url: Column, reputation_risk: Column) -> dict[str, Column]:
    domain = forensic_domain(url)
    short = any_in(domain, rules.SHORTENERS["forensics"])
    hidden = short | domain.rlike(L.IPV4_SHAPE)
    words = any_match(F.lower(url), rules.FORENSIC_URL_KEYWORDS)
    return {
        "domain": domain,
        "is_shortened": flag(short),
        "risk": F.when(reputation_risk > 0.5, "CRITICAL").when(hidden, "HIGH").when(words, "MEDIUM").otherwise("LOW"),
        "reason": F.when(reputation_risk > 0.5, "Reputation service flagged as malicious")
        .when(hidden, "Shortened/IP-based URL hides true destination")
        .when(words, "URL contains suspicious keywords (login/verify/account)")
        .otherwise("No obvious URL red-flags detected"),
    }


def by_domain(df: DataFrame) -> DataFrame:
    """URLs per domain; counts combine map-side, so a hot domain does not skew the shuffle."""
    return df.groupBy("domain").agg(
        F.count("*").alias("url_count"), flag(F.bool_or("is_suspicious")).alias("any_suspicious")
    )


def merged_urls(variant: str = "web") -> Column:
    """ARRAY<STRUCT(host, raw, kind)>: body URLs and given URLs of a mail, first of each host.

    Given URLs carry class 'provided'. The merge stays inside the row, because the URL list of one
    mail is short: no shuffle.
    """
    if variant == "web":
        found = F.transform(
            web_urls(F.col("body")),
            lambda r: F.struct(r.host.alias("host"), r.raw.alias("raw"), L.url_class(r.raw).alias("kind")),
        )
    else:
        found = F.transform(
            extract(F.col("body"), variant),
            lambda u: F.struct(L.hostname(u).alias("host"), u.alias("raw"), L.url_class(u).alias("kind")),
        )
    given = F.transform(
        F.col("urls"),
        lambda u: F.struct(L.hostname(L.web_url(u)).alias("host"), u.alias("raw"), F.lit("provided").alias("kind")),
    )
    return F.concat(found, given)


def first_per_host(rows: Column) -> Column:
    """``rows`` must be a plain column."""
    return F.filter(rows, lambda r, i: F.array_position(F.transform(rows, lambda x: x.host), r.host) == i + 1)


def with_merged(df: DataFrame, variant: str = "web") -> DataFrame:
    return df.withColumn("_found", merged_urls(variant)).withColumn("merged", first_per_host(F.col("_found"))).drop("_found")


def merged_counts() -> dict[str, Column]:
    def total(test) -> Column:
        return F.size(F.filter("merged", test))

    return {
        "url_count": F.size("merged"),
        "shortened_urls": total(lambda r: r.kind == "shortened"),
        "ip_based": total(lambda r: r.kind == "ip_based"),
        "encoded": total(lambda r: r.kind == "encoded"),
        "suspicious_count": total(lambda r: L.suspicious_url(r.raw)),
    }


def merged_summary(df: DataFrame, variant: str = "web") -> DataFrame:
    return with_merged(df, variant).select("id", *[c.alias(n) for n, c in merged_counts().items()])


def inventory(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """Corpus totals. ``urls``: (url, domain, mail_shortened); ``dns``: (domain, resolves), one row a domain."""
    short = F.col("domain").rlike(rules.SHORTENER_PATTERNS["inventory"]) | (F.col("mail_shortened") == 1)
    # rows fold into one per domain before they meet the snapshot, so a hot domain is one row of the join
    per_domain = urls.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(short).alias("suspicious"))
    joined = per_domain.join(dns, "domain", "left").withColumn("unresolved", F.when(~F.col("resolves"), F.col("n")).otherwise(0))
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_urls"),
        F.count("*").alias("distinct_domains"),
        F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved_urls"),
        F.coalesce(F.sum("suspicious"), F.lit(0)).alias("suspicious_urls"),
    )
