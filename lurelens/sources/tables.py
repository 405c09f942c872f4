"""CSV corpora, their adapters, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.text import blank

UNIFIED = "subject string, from_email string, body string, urls string, label int"


def split_raw(text: Column) -> dict[str, Column]:
    """Subject, sender and body of a raw message. Header lines count anywhere, the last one wins;
    the body is what follows the first blank line, without header-like lines."""
    lines = F.split(text, "\n")

    def last(prefix: str) -> Column:
        hits = F.filter(lines, lambda x: F.startswith(x, F.lit(prefix)))
        value = F.when(F.size(hits) > 0, F.element_at(hits, -1)).otherwise("")
        return F.trim(F.regexp_replace(F.replace(value, F.lit(prefix), F.lit("")), r"^\s+|\s+$", ""))

    is_header = lambda x: F.startswith(x, F.lit("Subject:")) | F.startswith(x, F.lit("From:"))
    rest = F.filter(lines, lambda x: ~is_header(x))
    blanks = F.transform(rest, lambda x: F.regexp_replace(x, r"\s+", "") == "")
    first = F.array_position(blanks, True)
    after = F.when(first > 0, F.slice(rest, (first + 1).cast("int"), F.greatest(F.size(rest), F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    body = F.regexp_replace(F.array_join(after, "\n"), r"^\s+|\s+$", "")
    subject, sender = last("Subject:"), last("From:")
    return {
        "subject": F.when(subject == "", F.substring(text, 1, 100)).otherwise(subject),
        "from_email": F.when(sender == "", "unknown@email.com").otherwise(sender),
        "body": F.when(body == "", text).otherwise(body),
    }


def adapt_raw(df: DataFrame, text: Column, label: Column, *keys: str) -> DataFrame:
    """Raw-message rows to the unified training form."""
    urls = F.regexp_extract_all(text, F.lit(rules.URL_EXTRACT["adapter"]), F.lit(0))
    return df.select(
        *keys, *[c.alias(n) for n, c in split_raw(text).items()],
        F.array_join(urls, ",").alias("urls"), label.cast("int").alias("label"),
    )


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, message) CSV; every mail is legitimate."""
    rows = _csv(spark, path, "file string, message string")
    return adapt_raw(rows, blank("message"), F.lit(0))


def read_raw_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, target) CSV."""
    rows = _csv(spark, path, "text string, target int")
    return adapt_raw(rows, blank("text"), F.coalesce("target", F.lit(0)))


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, UNIFIED)


def read_labelled_urls(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "url string, label int, category string")


def combine(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def class_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "label").agg(F.count("*").alias("rows"))


# -- writers ---------------------------------------------------------------------
def write_mails(df: DataFrame, path: str, form: str = "jsonl", mode: str = "overwrite") -> None:
    """JSON lines or Parquet; JSON uses the outer names ``from`` and ``to``."""
    if form == "parquet":
        df.write.mode(mode).parquet(path)
    elif form in ("json", "jsonl"):
        named = {"from_email": "from", "to_email": "to"}
        out = df.select(*[F.col(c).alias(named.get(c, c)) for c in df.columns])
        out.write.mode(mode).json(path)
    else:
        raise ValueError(f"unsupported format: {form}")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Training sets and metric tables. Blanks at the ends of a value stay."""
    form = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**form).csv(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
