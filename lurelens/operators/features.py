"""Mail-level features. Everything is computed inside the row from its own URL array, so mails
without URLs survive and no feature costs a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import links as L
from lurelens.functions.domains import sender_domain
from lurelens.functions.text import (
    any_in, blank, entropy, flag, keyword_hits, lexicon_hits, lowered, words,
)
from lurelens.operators import links as U
from lurelens.operators.domains import digit_substitution


def any_url(test: Callable[[Column], Column]) -> Column:
    return flag(F.exists("urls", test))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def url_features(df: DataFrame) -> DataFrame:
    """Adds the 15 URL features."""
    rows = df.withColumn(
        "_u",
        F.transform(
            "urls",
            lambda u: F.struct(
                *[c.alias(n) for n, c in U.url_metrics(u).items()],
                *[c.alias(n) for n, c in U.url_flags(u).items()],
            ),
        ),
    )
    n = F.size("_u")
    mean = _total(F.col("_u.length")) / n
    variance = _total(F.transform(F.col("_u.length"), lambda x: (x - mean) * (x - mean))) / (n - 1)

    def top(field: str, empty) -> Column:
        return F.coalesce(F.array_max(F.col(f"_u.{field}")), F.lit(empty))

    names = {
        "has_shortened_url": "is_shortened", "has_percent_encoding": "has_percent_encoding",
        "has_base64_token": "has_base64_token", "has_punycode": "has_punycode",
        "has_ip_address": "has_ip_address", "has_redirect_pattern": "has_redirect_pattern",
        "has_suspicious_tld": "has_suspicious_tld",
    }
    return rows.select(
        *df.columns,
        n.alias("url_count"),
        top("length", 0).alias("max_url_length"),
        F.when(n > 0, mean).otherwise(0.0).alias("avg_url_length"),
        F.coalesce(F.array_min(F.col("_u.length")), F.lit(0)).alias("min_url_length"),
        F.when(n > 1, F.sqrt(variance)).otherwise(0.0).alias("url_length_std_dev"),
        top("subdomain_depth", 0).alias("subdomain_depth"),
        top("digit_ratio", 0.0).alias("max_domain_digit_ratio"),
        top("special_char_ratio", 0.0).alias("max_url_special_ratio"),
        *[top(source, 0).alias(name) for name, source in names.items()],
    )


def header(name: str) -> Column:
    return F.coalesce(F.col("headers").getItem(name), F.lit(""))


def domain_features() -> dict[str, Column]:
    """The computed domain features; DNS and age columns come from snapshot joins."""
    sender = sender_domain(blank("from_email"), "first")

    def differs(other: Column) -> Column:
        domain = sender_domain(other, "first")
        return flag((sender != "") & (domain != "") & (sender != domain))

    return {
        "from_reply_mismatch": differs(header("reply-to")),
        "from_return_mismatch": differs(header("return-path")),
        "sender_domain_mismatch": F.lit(0),
        "sender_has_phone": flag(F.col("from_email").rlike(rules.SENDER_PHONE_PATTERN)),
        "sender_has_website": flag(F.col("from_email").rlike("https?://")),
        "sender_domain_typo": digit_substitution(sender),
    }


def address_count(text: Column) -> Column:
    return F.size(F.filter(F.split(blank(text), ","), lambda a: F.trim(a) != ""))


def header_features() -> dict[str, Column]:
    raw = F.lower(
        F.array_join(
            F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)), ", "
        )
    )
    spf = flag(raw.contains("spf"))
    dkim = flag(raw.contains("dkim-signature"))
    dmarc = flag(raw.contains("authentication-results") | raw.contains("dmarc"))
    return {
        "has_spf": spf,
        "has_dkim": dkim,
        "has_dmarc": dmarc,
        "auth_score": (spf + dkim + dmarc) / F.lit(3.0),
        "has_link_mismatch": flag(
            F.exists(
                U.anchors(F.col("body")),
                lambda a: (a.href != "") & U.link_mismatch(a.link_text, a.href, "structural"),
            )
        ),
        "has_html_form": flag(F.lower(blank("body")).contains("<form")),
        "recipient_count": address_count(F.col("to_email")),
        "cc_count": address_count(header("cc")),
    }


def content_features(extensions: str = "used") -> dict[str, Column]:
    body = blank("body")
    parts = words(body)
    count = F.size(parts)
    letters = F.length(F.regexp_replace(body, r"\s+", ""))
    marks = sum(
        (F.length(body) - F.length(F.replace(body, F.lit(m), F.lit(""))) for m in "!?"),
        F.length(body) - F.length(F.replace(body, F.lit("."), F.lit(""))),
    )
    return {
        "text_length": count,
        "subject_length": F.size(words(blank("subject"))),
        "sentence_count": marks,
        "avg_word_length": F.when(count > 0, letters / count).otherwise(0.0),
        "uppercase_ratio": F.when(
            F.length(body) > 0, F.regexp_count(body, F.lit(r"\p{Lu}")) / F.length(body)
        ).otherwise(0.0),
        "entropy_score": entropy(body),
        "attachment_count": F.size("attachments"),
        "has_risky_attachment": flag(
            F.exists(
                "attachments",
                lambda a: L.ends_with_any(F.lower(a.filename), rules.RISKY_EXTENSIONS[extensions]),
            )
        ),
    }


def _scaled(count: Column, total: Column, per: float = 100) -> Column:
    return F.least(F.lit(1.0), count / F.greatest(F.lit(1.0), total / F.lit(float(per))))


INTENT_NAMES = ["urgency_score", "credential_score", "action_cta_score", "threat_score", "legitimacy_score"]


def intent_scores(df: DataFrame, variant: str, lexicons: str = "full") -> DataFrame:
    """Adds scores normalised by hundred words. 'presence' counts two CTA words once each and uses
    its own short legitimacy list; 'counts' uses full lexicons throughout."""
    lex = rules.LEXICONS[lexicons]
    # the lowered text is a column of its own, so it is built once per mail
    rows = df.withColumn("_lt", lowered("body", "subject")).withColumn("_lw", F.size(words(F.col("_lt"))))
    text, total = F.col("_lt"), F.col("_lw")
    lists = [lex["urgency"], lex["credential"], lex["threat"], rules.LEGITIMACY_SHORT if variant == "presence" else lex["legitimacy"]]
    # all lexicons are counted in one crossing of the text
    rows = rows.withColumn("_hits", lexicon_hits(text, *lists, *([] if variant == "presence" else [lex["action_cta"]])))
    urgency, credential, threat, legit, cta = (F.col("_hits")[i] for i in range(5))
    if variant == "presence":
        body = F.lower(blank("body"))
        cta = flag(body.contains(rules.CTA_PRESENCE[0])) + flag(body.contains(rules.CTA_PRESENCE[1]))
    counts = [urgency, credential, cta, threat, legit]
    return rows.select(
        *df.columns,
        *[F.when(total > 0, _scaled(c, total)).otherwise(0.0).alias(n) for n, c in zip(INTENT_NAMES, counts)],
    )


def subject_features() -> dict[str, Column]:
    subject = blank("subject")
    count = F.size(words(subject))
    hits = keyword_hits(F.lower(subject), rules.URGENCY)  # subjects are short
    caps = (F.upper(subject) == subject) & (F.lower(subject) != subject) & (F.length(subject) > 5)
    return {
        "subject_length": count,
        "subject_urgency_score": _scaled(hits, count, 10),
        "subject_has_caps": flag(caps),
    }


def structural_vector(df: DataFrame, ratios: bool = True) -> DataFrame:
    """The merged vector: URL, domain, header, content and 'presence' intent features.

    The constants of the declared vector (age, reputation, record checks) are left to the joins
    of ``operators.enrichment``. ``ratios`` adds the two derived columns of the combined form.
    """
    base = intent_scores(url_features(df), "presence")
    added = {
        **domain_features(), **header_features(), **content_features(),
        "subject_urgency_score": subject_features()["subject_urgency_score"],
        "subject_has_caps": subject_features()["subject_has_caps"],
    }
    out = base.select("*", *[c.alias(n) for n, c in added.items()])
    if not ratios:
        return out
    length = F.col("text_length")
    return out.select(
        "*",
        (length / F.greatest(F.lit(1), F.col("subject_length"))).alias("body_subject_ratio"),
        (F.col("url_count") / F.greatest(F.lit(1), length)).alias("url_text_ratio"),
    )


CUES = ["asks_to_verify", "asks_credentials"]


def operational_features(df: DataFrame) -> DataFrame:
    """Adds the ten operational features and two text cues of the heuristics, so that nothing after
    this step needs the text. DNS flags are taken from the input when it has them (see
    ``enrichment.mail_dns_flags``) and are 0 otherwise."""
    rows = df.withColumn("_lt", lowered("subject", "body"))
    text = F.col("_lt")
    rows = rows.withColumn("_hits", lexicon_hits(text, rules.OPERATIONAL_URGENCY, rules.OPERATIONAL_SENSITIVE))

    def with_host(test: Callable[[Column, Column], Column]) -> Column:
        return any_url(lambda u: (L.netloc(u) != "") & test(u, L.netloc(u)))

    sender, reply = blank("from_email"), blank("reply_to")
    added = {
        "url_count": F.size("urls"),
        "shortened_url_detected": with_host(lambda u, h: h.isin(rules.SHORTENERS["operational"])),
        "suspicious_tld_detected": with_host(lambda u, h: L.ends_with_any(h, rules.SUSPICIOUS_TLDS["operational"])),
        "encoded_url_detected": with_host(lambda u, h: u.rlike("%[0-9A-Fa-f]{2}") | h.rlike(L.IPV4_SHAPE)),
        "domain_mismatch": flag((sender != "") & (reply != "") & (F.lower(reply) != F.lower(sender))),
        "urgency_score": F.col("_hits")[0] * F.lit(2.0),
        "html_form_presence": flag(text.contains("<form") | text.contains('method="post"')),
        "sensitive_keyword_count": F.col("_hits")[1],
        "asks_to_verify": flag(any_in(text, ["update your account", "verify"])),
        "asks_credentials": flag(any_in(text, ["password", "login"])),
    }
    for name in ("unresolved_url_domain", "unresolved_sender_domain"):
        if name not in df.columns:
            added[name] = F.lit(0)
    return rows.select(*df.columns, *[c.alias(n) for n, c in added.items()])


HYBRID_NAMES = [
    "subject_chars", "subject_urgent", "subject_reply", "has_at", "domain_chars", "short_domain",
    "listed_urls", "shortener_urls", "https_urls", "click_urls",
]


def hybrid_features() -> dict[str, Column]:
    subject, sender = F.lower(blank("subject")), blank("from_email")
    domain = F.lower(F.coalesce(F.get(F.split(sender, "@"), 1), F.lit("")))
    joined = F.array_join("urls", ",")
    listed = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(listed, test))

    values = [
        F.length(blank("subject")),
        flag(any_in(subject, rules.HYBRID_SUBJECT_URGENT)),
        flag(any_in(subject, rules.HYBRID_SUBJECT_REPLY)),
        flag(sender.contains("@")),
        F.length(domain),
        flag(any_in(domain, rules.HYBRID_SHORT_DOMAIN)),
        F.size(listed),
        count(lambda u: any_in(u, rules.HYBRID_SHORT_URL)),
        count(lambda u: F.startswith(u, F.lit("https"))),
        count(lambda u: F.lower(u).contains("click")),
    ]
    return dict(zip(HYBRID_NAMES, values))
