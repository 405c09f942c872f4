"""The operational scoring plan: features, DNS, trust and verdict as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.operators import domains, enrichment, features, verdict

KEPT = ["id", "subject", "from_email", "reply_to", "label", "source", "urls"]


def score_mails(mails: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """One verdict per mail. Text is read once and dropped before the only join."""
    narrow = features.operational_features(mails).drop("body", "headers", "attachments", "to_email")
    if dns is not None:
        flags = enrichment.mail_dns_flags(mails.select("id", "from_email", "urls"), dns).drop("domains")
        narrow = narrow.drop("unresolved_url_domain", "unresolved_sender_domain").join(flags, "id", "left")
        narrow = narrow.fillna(0, ["unresolved_url_domain", "unresolved_sender_domain"])
    return verdict.full_verdict(domains.trust_score(narrow))


def score_stateless(mails: DataFrame) -> DataFrame:
    """The same verdict without snapshot joins: a pure projection, usable on a stream as it is."""
    return score_mails(mails)


def heuristic_levels(mails: DataFrame, variant: str = "api") -> DataFrame:
    from lurelens.functions.risk import ladder

    rows = features.operational_features(mails)
    p = verdict.heuristic_probability(variant)
    return rows.select("id", p.alias("probability")).select(
        "id", "probability", ladder(F.col("probability"), "operational").alias("risk_level")
    )
