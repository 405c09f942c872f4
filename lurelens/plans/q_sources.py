"""Sources and sinks: folders and files are derived from the tables, written to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions import links as L
from lurelens.functions.text import round6
from lurelens.operators import enrichment as J
from lurelens.plans import fixtures as fx
from lurelens.plans import scoring
from lurelens.plans import sqlparts as s
from lurelens.plans.q_links import _origin_path
from lurelens.plans.q_streaming import _SCORED
from lurelens.plans.q_text import _SPLIT, _raw
from lurelens.plans.registry import query
from lurelens.session import work_folder
from lurelens.sources import folders as D
from lurelens.sources import mail as M
from lurelens.sources import tables as T

_URLS = f"regexp_extract_all(body, {s.lit(rules.URL_EXTRACT['loader'])})"


@query("eml_folder_mails", s.sql(f"""SELECT '<' || id || '@list.example>' AS message_id, subject, from_email, to_email, coalesce(reply_to, '') AS reply_to, md5(body) AS body_digest,
 CAST(len(list_distinct({_URLS})) AS INT) AS url_count, array_to_string(files, ',') AS files, CAST(CASE id % 7 WHEN 0 THEN 2048 WHEN 1 THEN 1536 ELSE 0 END AS BIGINT) AS file_bytes FROM emails""", "emails"))
def eml_folder_mails(spark, sf):
    """One .eml file per mail; those with attachments hold their text in a nested part."""
    mails = fx.emails(spark, sf).withColumn("id", F.concat(F.lit("<"), F.col("id"), F.lit("@list.example>")))
    path = f"{work_folder(spark)}/eml"
    D.write_folder(mails.select("id", "subject", "from_email", "to_email", "reply_to", "body", "attachments"), path)
    good, _ = D.read_folder(spark, path)
    sizes = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["size"])
    return good.select(
        F.col("id").alias("message_id"), "subject", "from_email", "to_email", "reply_to", F.md5("body").alias("body_digest"), F.size("urls").alias("url_count"),
        F.array_join(F.transform("attachments", lambda a: a.filename), ",").alias("files"), sizes.alias("file_bytes"))


@query("json_file_mails", s.sql("SELECT CAST(id AS VARCHAR) AS id, subject, from_email, to_email, coalesce(reply_to, '') AS reply_to, md5(body) AS body_digest, array_to_string(urls, ' ') AS urls, 'json' AS source, label FROM emails", "emails"))
def json_file_mails(spark, sf):
    mails = fx.emails(spark, sf, urls=True).withColumn("id", F.col("id").cast("string"))
    path = f"{work_folder(spark)}/json"
    D.write_folder(mails.select("id", "subject", "from_email", "to_email", "reply_to", "body", "urls", "label"), path, "json")
    good, _ = M.read_json_files(spark, path)
    return good.select("id", "subject", "from_email", "to_email", "reply_to", F.md5("body").alias("body_digest"), F.array_join("urls", " ").alias("urls"), "source", "label")


@query("raw_csv_mails", s.sql("SELECT subject, from_email, md5(body) AS body_digest, urls, CAST(0 AS INT) AS label FROM un", "emails", **_SPLIT))
def raw_csv_mails(spark, sf):
    path = f"{work_folder(spark)}/raw"
    T.write_csv(_raw(spark, sf).select(F.concat(F.lit("inbox/"), F.col("id")).alias("file"), F.col("raw").alias("message")), path)
    return T.read_raw_messages(spark, path).select("subject", "from_email", F.md5("body").alias("body_digest"), "urls", "label")


@query("raw_csv_labelled", s.sql("SELECT subject, from_email, md5(body) AS body_digest, urls, CASE WHEN id % 5 = 0 THEN 0 ELSE label END AS label FROM un", "emails", **_SPLIT))
def raw_csv_labelled(spark, sf):
    """Every fifth row has no target and counts as legitimate."""
    path = f"{work_folder(spark)}/labelled"
    T.write_csv(_raw(spark, sf).select(F.col("raw").alias("text"), F.when(F.col("id") % 5 != 0, F.col("label")).alias("target")), path)
    return T.read_raw_labelled(spark, path).select("subject", "from_email", F.md5("body").alias("body_digest"), "urls", "label")


@query("unified_csv_mails", s.sql("SELECT subject, from_email, md5(body) AS body_digest, CAST(len(urls) AS INT) AS url_count, array_to_string(urls, ',') AS urls, label FROM emails", "emails"))
def unified_csv_mails(spark, sf):
    path = f"{work_folder(spark)}/unified"
    T.write_csv(fx.emails(spark, sf, urls=True).select("subject", "from_email", "body", F.array_join("urls", ",").alias("urls"), "label"), path)
    listed = F.coalesce("urls", F.lit(""))
    count = F.when(listed == "", 0).otherwise(F.size(F.split(listed, ",")))
    return T.read_unified(spark, path).select("subject", "from_email", F.md5("body").alias("body_digest"), count.alias("url_count"), listed.alias("urls"), "label")


@query("labelled_urls_joined", s.sql(f"SELECT u.id, CAST(u.pos AS INT) AS pos, u.url, coalesce(b.category, 'unlisted') AS category FROM email_urls u LEFT JOIN b ON b.key = lower({_origin_path('u.url')})", "email_urls",
    b=f"SELECT lower({_origin_path('url')}) AS key, min(CASE page_id % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'mail' ELSE 'shop' END) AS category FROM pages WHERE page_id % 2 = 1 GROUP BY 1"))
def labelled_urls_joined(spark, sf):
    """A labelled URL corpus as a category per URL of the mails; label 1 marks phishing."""
    path, k = f"{work_folder(spark)}/urls", F.col("page_id")
    kinds = F.when(k % 3 == 0, "bank").when(k % 3 == 1, "mail").otherwise("shop")
    T.write_csv(fx.table(spark, sf, "pages").select("url", (k % 2).cast("int").alias("label"), kinds.alias("category")), path)
    bad = T.read_labelled_urls(spark, path).filter("label = 1")
    listed = bad.groupBy(F.lower(L.origin_and_path(F.col("url"))).alias("key")).agg(F.min("category").alias("category"))
    urls = fx.email_urls(spark, sf).withColumn("key", F.lower(L.origin_and_path(F.col("url"))))
    return J.left_on_key(urls, listed, "key").select("id", "pos", "url", F.coalesce("category", F.lit("unlisted")).alias("category"))


@query("ingested_verdicts", s.sql("SELECT CAST(id AS VARCHAR) AS id, probability, risk_level FROM v3", "email_urls", "trusted", "brands", **_SCORED))
def ingested_verdicts(spark, sf):
    """Mails written as JSON lines, read, scored, and the predictions written and read."""
    folder = work_folder(spark)
    mails = fx.emails(spark, sf, urls=True).withColumn("id", F.col("id").cast("string"))
    T.write_mails(mails.drop("source"), f"{folder}/mails")
    good, _ = M.read_json_lines(spark, f"{folder}/mails")
    T.write_predictions(scoring.score_stateless(good).select("id", round6(F.col("probability")).alias("probability"), "risk_level"), f"{folder}/predictions")
    return spark.read.schema("id string, probability double, risk_level string").json(f"{folder}/predictions")
