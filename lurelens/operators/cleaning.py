"""Text cleaning, tokens, label and quality columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelens import rules
from lurelens.functions.text import blank, tokens
from lurelens.operators.links import decode_entities

HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!doctype[^>]*>"


def strip_html(text: Column) -> Column:
    """Text of HTML: hidden parts and tags out, entities decoded. Stays in the JVM."""
    return decode_entities(F.regexp_replace(F.regexp_replace(text, HIDDEN, ""), r"<[^>]*>", ""))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _parsed(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return unescape("".join(parser.parts))


def _parsed_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_parsed)


def parse_html(text: Column) -> Column:
    """Parser-grade variant for markup the patterns cannot follow, in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _parsed_batches(batches)

    return F.pandas_udf(run, T.StringType())(text)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, rules.URL_EXTRACT["plain"], "")


def mask_addresses(text: Column) -> Column:
    return F.regexp_replace(text, r"\S+@\S+", "EMAIL")


def mask_phones(text: Column) -> Column:
    return F.regexp_replace(text, rules.PHONE_PATTERN, "PHONE")


def drop_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\b\d+\b", "")


def drop_special(text: Column, keep_basic: bool = True) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9\s.,!?\-]" if keep_basic else r"[^a-zA-Z0-9\s]", "")


def drop_signature(text: Column) -> Column:
    patterns = rules.SIGNATURE_PATTERNS + rules.FOOTER_PATTERNS
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def tidy_whitespace(text: Column) -> Column:
    runs = F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n+", "\n")
    return F.regexp_replace(runs, r"^\s+|\s+$", "")


CLEANING_DEFAULTS = {
    "html": True, "signature": True, "urls": False, "addresses": True, "phones": True,
    "numbers": False, "whitespace": True, "lowercase": True,
}


def clean_body(text: Column, **flags: bool) -> Column:
    """The fixed order of cleaning steps; each can be switched off or on."""
    on = {**CLEANING_DEFAULTS, **flags}
    steps = {
        "html": strip_html, "signature": drop_signature, "urls": strip_urls,
        "addresses": mask_addresses, "phones": mask_phones, "numbers": drop_numbers,
        "whitespace": tidy_whitespace, "lowercase": F.lower,
    }
    return reduce(lambda t, name: steps[name](t) if on[name] else t, steps, blank(text))


def clean_subject(text: Column) -> Column:
    return F.lower(tidy_whitespace(blank(text)))


def word_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    found = tokens(blank(text))
    if not stopwords:
        return found
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


TRAINING_TEXTS = {
    "simple": ["subject", "body", "url_text"],
    "hybrid": ["subject", "body", "from_email"],
    "server": ["subject", "from_email", "body", "url_text"],
}


def training_text(variant: str) -> Column:
    """Joined text; ``url_text`` is the comma- or blank-joined URL list of the caller."""
    return F.concat_ws(" ", *[blank(c) for c in TRAINING_TEXTS[variant]])


def normalize_label(name: Column, policy: str = "default") -> Column:
    """NULL for unknown names."""
    out = None
    for text, value in rules.LABELS[policy].items():
        hit = F.lower(F.trim(name)) == text
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


DOMAIN_FORM = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"


def quality_errors() -> Column:
    """Errors of one mail, in rule order; an empty array passes the gate."""
    subject, body = F.length(blank("subject")), F.length(blank("body"))
    address = blank("from_email")
    return F.filter(
        F.array(
            F.when(subject < 1, "Subject line is required"),
            F.when(body < 10, "Email body must be at least 10 characters"),
            F.when(subject > 500, "Subject line is too long (max 500 chars)"),
            F.when(body > 50000, "Email body is too long (max 50000 chars)"),
            F.when(~address.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "Sender address is not valid"),
            F.when(F.exists("urls", lambda u: ~u.rlike(r"^https?://\S+$")), "URL is not valid"),
        ),
        lambda e: e.isNotNull(),
    )


def split_by_quality(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("errors", quality_errors())
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def pseudonymize(address: Column) -> Column:
    return F.sha2(F.lower(address), 256)


def validate_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: missing share, mean, spread, values beyond three deviations.

    Two passes of one-row aggregates; the statistics row is a scalar broadcast by Spark.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
    )
    bounds = stats.select(F.struct("*").alias("s")).scalar()

    def stat(c: str, kind: str) -> Column:
        return bounds.getField(f"{c}_{kind}")

    return df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns],
        *[
            F.count_if(F.coalesce(F.abs(F.col(c) - stat(c, "mean")) > 3 * stat(c, "std"), F.lit(False))).alias(f"{c}_outliers")
            for c in columns
        ],
        *[F.first(stat(c, k)).alias(f"{c}_{k}") for c in columns for k in ("mean", "std")],
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), F.col("n").alias("rows"),
                        (F.col(f"{c}_missing") / F.col("n")).alias("missing_share"),
                        F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"),
                        F.col(f"{c}_outliers").alias("outliers"),
                    )
                    for c in columns
                ]
            )
        ).alias("r")
    ).select("r.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlation of numeric columns in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("corr")) for a, b in pairs])
        ).alias("r")
    ).select("r.*")


def repair_columns(df: DataFrame, limits: dict[str, tuple[float, float]], defaults: dict[str, float]) -> DataFrame:
    """Fills missing values with a default and caps values to a range."""
    fixed = {
        c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(F.col(c), F.lit(defaults[c]))))
        for c, (lo, hi) in limits.items()
    }
    return df.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns])
