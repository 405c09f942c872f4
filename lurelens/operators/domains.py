"""Domain operators: sender domains, trust registry, impersonation, cross-checks, trust score."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelens import rules
from lurelens.functions import domains as D
from lurelens.functions import links as L
from lurelens.functions.stages import sealed
from lurelens.functions.text import any_match, blank, flag

LIMIT = 0.80


def impersonation_hits(df: DataFrame, domain: str) -> DataFrame:
    """One row per (row, brand) hit. The 15 patterns are tested inside the row: no nested-loop join."""
    return df.withColumn("brand", F.explode(D.impersonated_brands(F.col(domain))))


def lookalike_candidates(df: DataFrame, domain: str) -> DataFrame:
    """Distinct bases against the trusted bases, kept only where the ratio can exceed the limit.

    With M matching characters of T in total, ratio = 2M/T and edit distance <= T - 2M, so
    ratio > 0.8 implies distance < 0.2 T. The filter therefore loses nothing.
    """
    bases = df.select(D.base_domain(F.col(domain), "analyzer").alias("base")).filter("base <> ''").distinct()
    pairs = bases.withColumn("brand", F.explode(F.array(*[F.lit(b) for b in rules.TRUSTED_DOMAINS])))
    total = F.length("base") + F.length("brand")
    return pairs.filter(
        (F.col("base") != F.col("brand"))
        & (F.levenshtein("base", "brand") < F.lit(1 - LIMIT + 1e-9) * total)
    )


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def matching_ratio(a: str, b: str) -> Column:
    """Matching-block ratio in Arrow batches; only rows past the native filter get here."""
    return F.pandas_udf(_ratios, T.DoubleType())(a, b)


def lookalike_domains(df: DataFrame, domain: str) -> DataFrame:
    scored = lookalike_candidates(df, domain).withColumn("ratio", matching_ratio("base", "brand"))
    return scored.filter(F.col("ratio") > LIMIT)


def digit_substitution(domain: Column) -> Column:
    """The company name must already stand in the raw domain, so 'google.com' is flagged."""
    plain = F.translate(domain, "013", "oie")
    hit = F.lit(False)
    for company in rules.TYPO_COMPANIES:
        hit = hit | (
            domain.contains(company)
            & ((plain == company + ".com") | F.startswith(plain, F.lit(company + ".")))
        )
    return flag(hit)


def url_domains() -> Column:
    return F.filter(F.transform("urls", L.lenient_hostname), lambda d: d != "")


def cross_check(df: DataFrame) -> DataFrame:
    """Adds sender, reply-to and URL domains with their bases and mismatches. Stays inside the row;
    each base is worked out once."""
    names = df.columns
    out = sealed(
        df.select(
            "*",
            D.sender_domain(blank("from_email"), "last").alias("sender_domain"),
            D.sender_domain(blank("reply_to"), "last").alias("reply_to_domain"),
            url_domains().alias("url_domains"),
        ),
        names,
    )
    out = sealed(
        out.select(
            "*",
            D.base_domain(F.col("sender_domain")).alias("sender_base"),
            D.base_domain(F.col("reply_to_domain")).alias("reply_base"),
            F.transform("url_domains", lambda d: F.struct(d.alias("domain"), D.base_domain(d).alias("base"))).alias("hosts"),
        ),
        names,
    )
    sender = F.col("sender_domain") != ""
    mismatched = F.transform(
        F.filter("hosts", lambda h: (h.base != F.col("sender_base")) & ~D.is_trusted_base(h.base)), lambda h: h.domain
    )
    return out.select(
        *names, "sender_domain", "reply_to_domain", "sender_base", "reply_base", "url_domains", "hosts",
        flag(
            sender & (F.col("reply_to_domain") != "") & (F.col("sender_base") != F.col("reply_base"))
        ).alias("reply_mismatch"),
        F.when(sender, mismatched).otherwise(F.array().cast("array<string>")).alias("mismatched_url_domains"),
    ).withColumn("url_mismatch", flag(F.size("mismatched_url_domains") > 0))


def _kept(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def trust_score(df: DataFrame) -> DataFrame:
    """Trust in [0, 1] with signals and warnings. Each step clamps before the next one."""
    def faked(domain: Column, base: Column) -> Column:
        return F.transform(
            D.impersonated_brands(domain, base), lambda b: F.struct(domain.alias("domain"), b.alias("brand"))
        )

    out = sealed(
        cross_check(df).select(
            "*",
            D.trust_match(F.col("sender_domain"), F.col("sender_base")).alias("sender_trust"),
            D.trust_match(F.col("reply_to_domain"), F.col("reply_base")).alias("reply_trust"),
            F.size(F.filter("hosts", lambda h: D.is_trusted(D.trust_match(h.domain, h.base)))).alias("trusted_urls"),
            F.concat(
                faked(F.col("sender_domain"), F.col("sender_base")),
                F.flatten(F.transform("hosts", lambda h: faked(h.domain, h.base))),
            ).alias("impersonations"),
        ).drop("hosts"),
        df.columns,
    )
    trusted = D.is_trusted(F.col("sender_trust"))
    match_type = F.col("sender_trust.match_type")
    has_reply = F.col("reply_to").contains("@")
    reply_trusted = F.coalesce(has_reply, F.lit(False)) & D.is_trusted(F.col("reply_trust"))
    zero = F.lit(0.0)

    def minus(step: Column, condition: Column, amount: float) -> Column:
        """Takes the amount off and clamps at 0; each step names the one before only once."""
        return F.greatest(zero, step - F.when(condition, amount).otherwise(zero))

    step = F.when(trusted, 0.4).when(match_type == "unknown_subdomain", 0.1).otherwise(zero)
    step = minus(step, F.size("impersonations") > 0, 0.3)
    step = minus(step, F.col("reply_mismatch") == 1, 0.2)
    step = minus(step, (F.col("url_mismatch") == 1) & ~trusted, 0.1)
    step = step + F.when(reply_trusted & trusted, 0.1).otherwise(zero)
    step = step + F.when((F.col("trusted_urls") > 0) & trusted, 0.1).otherwise(zero)
    sender, reply = F.col("sender_domain"), F.col("reply_to_domain")
    cross_warnings = _kept(
        F.format_string("Sender domain (%s) differs from Reply-To (%s)", sender, reply),
        F.when(
            F.col("url_mismatch") == 1,
            F.concat(
                F.lit("URL domains ['"), F.array_join("mismatched_url_domains", "', '"),
                F.lit("'] don't match sender ("), sender, F.lit(")"),
            ),
        ),
    )
    none = F.array().cast("array<string>")
    return out.select(
        "*",
        F.round(F.greatest(zero, F.least(F.lit(1.0), step)), 3).alias("trust_score"),
        _kept(
            F.when(trusted, F.format_string("Sender domain '%s' is a verified %s domain", sender, D.category(F.col("sender_trust")))),
            F.when(reply_trusted & trusted, F.format_string("Reply-To domain '%s' is also verified", reply)),
            F.when((F.col("trusted_urls") > 0) & trusted, F.format_string("%d URL(s) point to verified domains", F.col("trusted_urls"))),
        ).alias("trust_signals"),
        F.concat(
            _kept(
                F.when(
                    match_type == "unknown_subdomain",
                    F.concat(F.lit("Sender uses unrecognized subdomain of trusted domain: "), sender),
                )
            ),
            F.transform(
                "impersonations",
                lambda i: F.format_string("Brand impersonation detected: '%s' mimics %s", i.domain, i.brand),
            ),
            F.when(F.col("reply_mismatch") == 1, cross_warnings).otherwise(none),
            _kept(
                F.when(
                    reply_trusted & ~trusted,
                    F.format_string("Reply-To is trusted (%s) but sender is not — suspicious", reply),
                )
            ),
        ).alias("trust_warnings"),
    )


def web_domain(address: Column) -> Column:
    """Text between the first and the second @."""
    return F.get(F.split(address, "@"), 1)


def address_flags(address: Column) -> dict[str, Column]:
    domain = web_domain(address)
    homograph = any_match(domain, rules.HOMOGRAPH_PATTERNS)
    return {
        "has_homograph": flag(homograph),
        "is_freemail": flag(F.lower(domain).isin(rules.FREEMAIL)),
        "is_suspicious_domain": flag(homograph | domain.rlike(rules.THROWAWAY_PATTERN)),
    }


def brand_mentions(hosts: Column) -> Column:
    """Brands named in URL hosts, in order of first sight."""
    per_host = F.transform(
        hosts,
        lambda h: F.filter(F.array(*[F.lit(b) for b in rules.BRAND_WORDS]), lambda b: F.contains(h, b)),
    )
    return F.array_distinct(F.flatten(per_host))
