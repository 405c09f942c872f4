"""URL columns. A host is read from the text itself, because the built-in parser
drops hosts holding ``_`` or ``%`` and hides user-info."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.text import any_match

NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)"
IPV4_SHAPE = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
IPV4_STRICT = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, NETLOC, 1))


def netloc_host(url: Column) -> Column:
    """Network location up to the first colon."""
    return F.split_part(netloc(url), F.lit(":"), F.lit(1))


def hostname(url: Column) -> Column:
    """Host without user-info, port and trailing dots; '' when there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), r"\.+$", "")


def lenient_hostname(url: Column) -> Column:
    """Host of a URL that may lack a scheme."""
    clean = F.trim(url)
    return hostname(
        F.when(clean.rlike(r"^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean))
    )


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def suspicious_url(url: Column) -> Column:
    return any_match(url, rules.SUSPICIOUS_URL_PATTERNS)


def url_class(url: Column) -> Column:
    return (
        F.when(url.rlike(r"^https?://"), "standard")
        .when(url.rlike(rules.SHORTENER_PATTERNS["web_class"]), "shortened")
        .when(url.rlike(IPV4_SHAPE), "ip_based")
        .when(url.rlike(r"%[0-9A-Fa-f]{2}"), "encoded")
        .otherwise("www_format")
    )


def web_url(url: Column) -> Column:
    """URL with a scheme, the way the web rules read it."""
    return F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def origin_and_path(url: Column) -> Column:
    """Scheme, host and path only; an empty path reads as '/'."""
    full = web_url(url)
    origin = F.lower(F.regexp_extract(full, r"^(https?://[^/?#]*)", 1))
    path = F.regexp_extract(full, r"^https?://[^/?#]*(/[^?#]*)", 1)
    return F.concat(origin, F.when(path == "", "/").otherwise(path))


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return sum(
        (F.get(parts, i).cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
        F.get(parts, 0).cast("bigint") * F.lit(256**3),
    )


def _number(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


BLOCKED_RANGES = [(_number(lo), _number(hi)) for lo, hi in rules.BLOCKED_IPV4]


def blocked_ipv4(host: Column) -> Column:
    """True for dotted addresses in private, loopback, multicast or reserved ranges. ``host`` should
    be a plain column."""
    table = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in BLOCKED_RANGES])
    return F.when(
        host.rlike(IPV4_STRICT), F.exists(table, lambda r: ipv4_number(host).between(r.lo, r.hi))
    ).otherwise(F.lit(False))
