"""Domain columns: sender domains, registrable base, trust lookup, impersonation.

The trust registry is 39 fixed rows, so it travels inside the expression as a map literal:
no join, no shuffle, and a hot domain costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.text import any_match


def base_pattern(variant: str) -> str:
    return r"([^.]*\.(?:(?:" + "|".join(rules.SECOND_LEVEL[variant]) + r")\.)?[^.]*)$"


def base_domain(domain: Column, variant: str = "trust") -> Column:
    clean = F.regexp_replace(F.lower(domain), r"\.+$", "") if variant == "trust" else domain
    found = F.regexp_extract(clean, base_pattern(variant), 1)
    return F.when(found == "", domain).otherwise(found)


def subdomain_prefix(domain: Column, base: Column) -> Column:
    return F.when(
        F.endswith(domain, F.concat(F.lit("."), base)),
        F.substring(domain, F.lit(1), F.length(domain) - F.length(base) - 1),
    ).otherwise(F.lit(""))


def sender_domain(address: Column, variant: str) -> Column:
    """'' when the address has no @ (except for the 'whole' variant)."""
    has_at = address.contains("@")
    if variant == "first":
        trimmed = F.regexp_replace(address, r"^[<>]+|[<>]+$", "")
        return F.when(has_at, F.lower(F.get(F.split(trimmed, "@"), 1))).otherwise(F.lit(""))
    if variant == "last":
        tail = F.element_at(F.split(address, "@"), -1)
        return F.when(
            has_at, F.lower(F.trim(F.regexp_replace(tail, r"^>+|>+$", "")))
        ).otherwise(F.lit(""))
    if variant == "whole":
        return F.lower(F.element_at(F.split(address, "@"), -1))
    raise ValueError(variant)


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def is_trusted_base(base: Column) -> Column:
    return base.isin(list(rules.TRUSTED_DOMAINS))


def trust_match(domain: Column, base: Column | None = None) -> Column:
    """STRUCT(trusted, base_domain, category, match_type) for a domain.

    Pass ``base`` when it already is a column; ``domain`` must then be lower-case and dot-free at
    its end.
    """
    clean = domain if base is not None else F.regexp_replace(F.lower(domain), r"\.+$", "")
    base = base_domain(clean) if base is None else base
    categories = _map((d, c) for d, (c, _) in rules.TRUSTED_DOMAINS.items())
    # known subdomains as 'base/subdomain' keys: one membership test
    known = [f"{d}/{sub}" for d, (_, subs) in rules.TRUSTED_DOMAINS.items() for sub in subs]
    prefix = subdomain_prefix(clean, base)
    nearest = F.element_at(F.split(prefix, r"\."), -1)
    match_type = (
        F.when(clean == "", "none")
        .when(
            is_trusted_base(base),
            F.when(clean == base, "exact")
            .when(
                F.concat(base, F.lit("/"), nearest).isin(known) | F.concat(base, F.lit("/"), prefix).isin(known),
                "subdomain",
            )
            .otherwise("unknown_subdomain"),
        )
        .when(any_match(clean, rules.GOVERNMENT_PATTERNS), "gov_pattern")
        .otherwise("none")
    )
    return F.struct(
        F.when(clean == "", "").otherwise(base).alias("base_domain"),
        F.coalesce(F.try_element_at(categories, base), F.lit("")).alias("category"),
        match_type.alias("match_type"),
    )


def is_trusted(match: Column) -> Column:
    return match.match_type.isin("exact", "subdomain", "gov_pattern")


def category(match: Column) -> Column:
    return F.when(match.match_type == "gov_pattern", "government").otherwise(match.category)


def impersonated_brands(domain: Column, base: Column | None = None) -> Column:
    """Brands whose look-alike pattern hits a domain that is not itself trusted. With ``base`` given
    the domain must be lower-case."""
    low = F.lower(domain) if base is None else domain
    base = base_domain(low) if base is None else base
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(b).alias("b")) for p, b in rules.IMPERSONATION_PATTERNS])
    hits = F.transform(F.filter(table, lambda x: F.regexp(low, x.p)), lambda x: x.b)
    none = F.array().cast("array<string>")
    return F.when((low == "") | is_trusted_base(base), none).otherwise(hits)
