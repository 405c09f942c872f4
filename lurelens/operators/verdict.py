"""Scores, levels, trust adjustment and ordered reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import domains as D
from lurelens.functions.risk import action, ladder
from lurelens.functions.stages import sealed
from lurelens.functions.text import any_in, blank, flag, lowered, round6

NO_STRINGS = "array<string>"
WARN = "⚠️ "


def _weighted(variant: str) -> Column:
    w = rules.HEURISTIC_WEIGHTS[variant]
    total = (
        F.col("shortened_url_detected") * F.lit(w["shortened"])
        + F.col("domain_mismatch") * F.lit(w["mismatch"])
        + F.col("unresolved_sender_domain") * F.lit(w["sender_dns"])
        + F.col("unresolved_url_domain") * F.lit(w["url_dns"])
        + F.col("urgency_score") / F.lit(w["urgency_div"])
    )
    if w["sensitive"]:
        total = total + F.col("sensitive_keyword_count") * F.lit(w["sensitive"])
    return F.least(F.lit(1.0), total)


def heuristic_probability(variant: str, text_probability: Column | None = None) -> Column:
    """Probability from the operational features; ``fusion_text`` needs a text model's score."""
    verify = F.col("asks_to_verify") == 1
    if variant == "api":
        return F.least(F.lit(1.0), _weighted("api") + F.when(verify, 0.3).otherwise(0.0))
    if variant == "fusion_rules":
        words = F.when(verify, 0.6).otherwise(0.0) + F.when(F.col("asks_credentials") == 1, 0.3).otherwise(0.0)
        return late_fusion(words, _weighted(variant))
    if variant == "fusion_text":
        return late_fusion(F.greatest(F.lit(0.0), F.least(F.lit(1.0), text_probability)), _weighted(variant))
    raise ValueError(variant)


def late_fusion(text: Column, structural: Column) -> Column:
    return text * F.lit(0.4) + structural * F.lit(0.6)


def balanced_fusion(text: Column, structural: Column, tokens: Column) -> Column:
    """Equal weights; mails under 50 tokens lean on structure (1.3 against 0.7), renormalised."""
    short = tokens < 50
    ws = F.when(short, 0.5 * 1.3).otherwise(0.5)
    wt = F.when(short, 0.5 * 0.7).otherwise(0.5)
    return (text * wt + structural * ws) / (wt + ws)


def safety_score(probability: Column) -> Column:
    return F.floor((F.lit(1.0) - probability) * 100).cast("int")


def safety_score_rounded(confidence: Column, is_phishing: Column) -> Column:
    """Half-even rounding; measured from the confidence in the verdict."""
    return F.when(
        is_phishing, F.greatest(F.lit(0.0), F.bround((F.lit(1.0) - confidence) * 100, 0))
    ).otherwise(F.least(F.lit(100.0), F.bround(confidence * 100, 0))).cast("int")


def _kept(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _or_default(reasons: Column, default: Column) -> Column:
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(default))


def reasons_api(phishing: Column) -> Column:
    found = _kept(
        F.when(F.col("unresolved_sender_domain") == 1, WARN + "Sender domain failed DNS resolution. This is a strong indicator of spoofing."),
        F.when(F.col("unresolved_url_domain") == 1, WARN + "Extracted URLs point to domains that fail DNS resolution (potentially removed or newly registered)."),
        F.when(F.col("domain_mismatch") == 1, WARN + "Reply-To email differs from Sender email."),
        F.when(F.col("shortened_url_detected") == 1, "🔗 Uses URL shortener to mask final destination."),
        F.when(F.col("urgency_score") > 0, "⏳ Contains language creating false urgency."),
    )
    return _or_default(
        found,
        F.when(phishing, "Semantic NLP Model flagged suspicious text patterns.").otherwise(
            "No structural or semantic threats detected. Email seems safe."
        ),
    )


def reasons_fusion(probability: Column) -> Column:
    found = _kept(
        F.when(F.col("unresolved_sender_domain") == 1, "Sender domain failed active DNS verification (Likely Spoofed Header)."),
        F.when(F.col("unresolved_url_domain") == 1, "Email contains links to dead or actively blocked domains (High Risk)."),
        F.when(F.col("domain_mismatch") == 1, "Sender domain and Reply-To mismatch detected."),
        F.when(F.col("shortened_url_detected") == 1, "Email contains shortened URLs often used to obscure malicious links."),
        F.when(F.col("encoded_url_detected") == 1, "Suspicious IP-based or encoded URL format detected."),
        F.when(F.col("sensitive_keyword_count") > 2, "High volume of sensitive credential-harvesting keywords."),
        F.when(F.col("urgency_score") > 5, "Language exhibits extreme urgency, a common social engineering tactic."),
    )
    default = F.when(probability > 0.6, "Semantic NLP Model flagged suspicious text patterns.").otherwise(
        "No significant structural or semantic threats detected."
    )
    return F.slice(_or_default(found, default), 1, 3)


def reasons_ensemble(probability: Column) -> Column:
    text = lowered("subject", "from_email", "body")
    text = F.concat(text, F.lit(" "), F.lower(F.array_join("urls", " ")))
    percent = F.concat(F.format_string("%.1f", probability * 100), F.lit("%"))
    found = _kept(
        F.when(any_in(text, ["verify", "confirm", "urgent", "immediate"]), "Contains urgency language (verify, confirm, urgent)"),
        F.when(any_in(text, ["bit.ly", "tinyurl", "short.link"]), "Contains shortened URLs (common phishing tactic)"),
        F.when(text.contains("click"), "Contains call-to-action (click link)"),
        F.when(any_in(text, rules.SUSPICIOUS_TLDS["api"]), "Uses suspicious domain TLD"),
        F.when(probability > 0.7, F.concat(F.lit("High phishing probability: "), percent)),
    )
    default = F.concat(F.lit("Classified by machine learning model (confidence: "), percent, F.lit(")"))
    return F.slice(_or_default(found, default), 1, 5)


def reasons_pipeline() -> Column:
    """Reasons of the batch path, from URLs in order, then headers, text and anchors."""
    from lurelens.functions.domains import sender_domain
    from lurelens.operators import links as U
    from lurelens.operators.features import header

    text = lowered("body", "subject")
    sender = sender_domain(blank("from_email"), "first")
    reply = sender_domain(header("reply-to"), "first")

    def per_url(u: Column) -> Column:
        f = U.url_flags(u)
        return _kept(
            F.when(f["is_shortened"] == 1, F.concat(F.lit("Shortened URL detected: "), u)),
            F.when(f["has_ip_address"] == 1, "URL uses IP address instead of domain"),
            F.when(f["has_punycode"] == 1, "Punycode/IDN encoding detected in URL"),
            F.when(f["has_suspicious_tld"] == 1, "Suspicious TLD detected in URL"),
        )

    wrong = F.filter(
        U.anchors(F.col("body")),
        lambda a: (a.href != "") & U.link_mismatch(a.link_text, a.href, "analyzer"),
    )
    found = F.concat(
        F.flatten(F.transform("urls", per_url)),
        _kept(
            F.when(
                (sender != "") & (reply != "") & (sender != reply),
                F.format_string("From domain %s doesn't match Reply-To domain %s", sender, reply),
            ),
            F.when(any_in(text, ["urgent", "immediate", "action required", "asap"]), "Urgent language detected"),
            F.when(any_in(text, ["password", "verify", "confirm", "authenticate", "login"]), "Credential solicitation detected"),
        ),
        F.transform(wrong, lambda a: F.format_string("Link mismatch: text='%s' vs url='%s'", a.link_text, a.href)),
    )
    return _or_default(found, F.lit("Detected as phishing based on text patterns"))


def reasons_hybrid(confidence: Column, phishing: Column) -> Column:
    """Needs the hybrid feature columns."""
    subject_body = F.concat(F.lower(blank("subject")), F.lower(blank("body")))
    size = F.length(blank("body"))
    percent = F.concat(F.format_string("%.1f", confidence * 100), F.lit("%"))
    found = _kept(
        F.when(any_in(subject_body, ["urgent", "verify", "confirm", "action required", "click"]), WARN + "Contains urgency/verification language (suspicious indicator)"),
        F.when((F.col("listed_urls") > 0) & (F.col("shortener_urls") > 0), "🔗 Contains shortened URLs (bit.ly, tinyurl - suspicious)"),
        F.when((F.col("listed_urls") > 0) & (F.col("https_urls") > 0), "✓ Uses HTTPS (legitimate indicator)"),
        F.when(blank("from_email").contains("@") & (F.col("short_domain") > 0), WARN + "Uses suspicious domain pattern"),
        F.when(size < 100, "📝 Very short email body (suspicious)").when(size > 1000, "📝 Long email body (more likely legitimate)"),
        F.when(confidence > 0.9, F.concat(F.lit("🤖 Model confidence: "), percent, F.lit(" - High certainty")))
        .when(confidence > 0.5, F.concat(F.lit("🤖 Model confidence: "), percent)),
    )
    return _or_default(
        found, F.when(phishing, "Classified as phishing based on semantic analysis").otherwise("Email appears legitimate")
    )


def full_verdict(df: DataFrame) -> DataFrame:
    """Probability, trust adjustment, level, action, safety score and reasons.

    Input: operational features plus the columns of ``domains.trust_score``; an
    ``unresolved_domains`` array is used when present. Order is semantic: the trust bonus comes
    first, then the impersonation penalty, each on the result of the step before.
    """
    if "unresolved_domains" not in df.columns:
        df = df.withColumn("unresolved_domains", F.array().cast(NO_STRINGS))
    lost = F.coalesce("unresolved_domains", F.array().cast(NO_STRINGS))
    faked = F.size("impersonations") > 0
    rows = df.withColumn("heuristic", heuristic_probability("api"))
    h = F.col("heuristic")
    bonus = (F.col("trust_score") > 0.3) & ~faked
    relief = F.when(bonus, F.least(F.lit(0.15), F.col("trust_score") * F.lit(0.25))).otherwise(0.0)
    raised = F.greatest(F.lit(0.0), h - relief) + F.when(faked, 0.2).otherwise(0.0)
    rows = sealed(rows.withColumn("probability", F.least(F.lit(1.0), raised)), [c for c in ("id",) if c in df.columns])
    p = F.col("probability")
    phishing = faked | (p >= 0.5)
    level = F.when(faked, "CRITICAL").otherwise(ladder(p, "operational"))
    brands = F.array_join(F.array_sort(F.array_distinct(F.col("impersonations.brand"))), ", ")
    reasons = F.concat(
        reasons_api(h >= 0.5),
        _kept(
            F.when(
                F.size(lost) > 0,
                F.format_string(WARN + "DNS: %d domain(s) failed resolution: %s", F.size(lost), F.array_join(F.slice(lost, 1, 3), ", ")),
            ),
            F.when(faked, F.concat(F.lit(WARN + "Brand impersonation detected: "), brands)),
            F.when(
                D.is_trusted(F.col("sender_trust")) & ~faked,
                F.format_string("✅ Sender domain is a verified %s domain", D.category(F.col("sender_trust"))),
            ),
        ),
        F.transform(F.slice("trust_warnings", 1, 2), lambda w: F.concat(F.lit(WARN), w)),
    )
    return rows.select(
        "*",
        flag(phishing).alias("phishing"),
        F.when(faked | phishing, p).otherwise(F.lit(1.0) - p).alias("confidence"),
        safety_score(p).alias("safety_score"),
        level.alias("risk_level"),
        F.slice(reasons, 1, 5).alias("reasoning"),
    ).withColumn("recommended_action", action(F.col("risk_level")))


def explanation_weights(confidence: Column) -> Column:
    """Evidence-based weights per mail, largest first: ARRAY<STRUCT(feature, weight)>."""
    text, body = lowered("subject", "body"), F.lower(blank("body"))
    shortened = F.exists("urls", lambda u: any_in(u, rules.SHORTENERS["forensics"]))
    raw = [
        ("Urgent Language Tone", F.when(any_in(text, ["urgent", "immediate"]), 0.30).otherwise(0.10)),
        ("Suspicious URLs", F.when(shortened, 0.40).otherwise(0.05)),
        ("Sensitive Keyword Count", F.when(any_in(body, rules.EXPLAIN_BODY_KEYWORDS), 0.20).otherwise(0.05)),
        ("HTML Link Obfuscation", F.when(F.size("urls") > 2, 0.15).otherwise(0.03)),
    ]
    scale = confidence / F.greatest(*[w for _, w in raw])
    rows = F.array(
        *[F.struct((-F.least(round6(w * scale), F.lit(0.99))).alias("key"), F.lit(n).alias("feature")) for n, w in raw]
    )
    return F.transform(F.array_sort(rows), lambda r: F.struct(r.feature.alias("feature"), (-r.key).alias("weight")))
