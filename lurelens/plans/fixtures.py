"""The derived views every query starts from (recipe: FIXTURES.md).

The test tables hold invented prose, so mails are documents overlaid with 20 template mails. The
template side is 20 fixed rows and travels as a literal array: no join. Only the parts a query
asks for are joined, so unused sides are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.functions.stages import unpacked

TEMPLATE_FIELDS = ["subject", "from_email", "reply_to", "snippet", "url", "label"]
# FIXED VALUES: the 15 sample mails and 5 test mails
TEMPLATES = [
    ("Verify Your Account", "noreply@bankscam.ru", None, "Dear Customer, please verify your account by clicking the link below. Your account has been flagged for security review. Click here to confirm your identity.", "https://bit.ly/verify123", 1),
    ("Meeting Tomorrow at 3PM", "john.smith@company.com", None, "Hi Team, Let's meet tomorrow at 3 PM to discuss the Q1 project status. Conference room B is reserved. See you then!", "https://company.com/calendar", 0),
    ("URGENT: Confirm Identity", "noreply@paypal-verify.com", None, "Your PayPal account security alert. We detected unusual activity. Please verify your identity immediately by clicking below to avoid account suspension.", "https://paypa1-verify.com/confirm", 1),
    ("Project Update", "manager@company.com", None, "Team, here's the latest status update on our current projects. Performance is on track. Please review the attached document.", "https://company.com/docs/project", 0),
    ("Prize Winner Notification", "admin@lottery-fake.com", None, "Congratulations! You have won 1 million dollars in our annual lottery. Claim your prize by clicking the link and entering your details now!", "https://lottery-win-claim.ru/prize", 1),
    ("Password Reset Required", "security@twitter-check.com", None, "Your Twitter account password needs to be reset immediately for security purposes. Click here to reset your password now.", "https://twitterverify-secure.com/reset", 1),
    ("Team Lunch This Friday", "events@company.com", None, "Hi everyone, we're having a team lunch this Friday at 12 PM at the downtown restaurant. Please RSVP in the team chat.", "https://company.com/events", 0),
    ("Your Shipment Arrived", "delivery@amazon-confirm.uk", None, "Your Amazon order has arrived! Track your package using the link below. If you didn't place this order, verify your account immediately.", "https://amazn-track-delivery.com/order", 1),
    ("Monthly Expense Report", "finance@company.com", None, "Please submit your monthly expense reports by end of business Friday. Use the expense portal link to upload your receipts.", "https://company.com/expense-portal", 0),
    ("Limited Time Offer", "sales@store-deals.com", None, "Flash sale! 90% off everything today only. Hurry up before stocks run out. Click the link to shop now!", "https://store-deals-sale.net/flash", 1),
    ("Vacation Request Approval", "hr@company.com", None, "Your vacation request has been approved. Please confirm the dates and let HR know if you need anything else for your time off.", "https://company.com/hr-portal", 0),
    ("Confirm Bank Account", "noreply@citibank-verify.ru", None, "Citibank Security: unusual login detected. Confirm your bank account details now to protect your funds from unauthorized access.", "https://citibank-secure-verify.com/login", 1),
    ("New Project Assignment", "projects@company.com", None, "You have been assigned to a new project starting next month. Details and team information are in the attached file.", "https://company.com/projects", 0),
    ("Click Here Quick Money", "marketing@quickcash-now.ru", None, "Easy Money! Get $5000 instantly. No credit check needed. Apply now to get approved within 1 hour!", "https://quickcash-instant-loan.ru/apply", 1),
    ("Office Relocation Notice", "admin@company.com", None, "Our office is relocating next month. The new address and parking information are in the attached document. Questions? Ask your manager.", "https://company.com/relocation", 0),
    ("URGENT: Verify Your Account NOW — Action Required", "noreply@secure-verify.xyz", "support@paypal-secure.top", "Your account has been suspended due to suspicious activity.\n\nClick here immediately to confirm your identity and password to restore access.\nThis is urgent — you have 24 hours.\"\n\nEmail: support@secure-verify.xyz\nPassword: [ENTER PASSWORD HERE]\n\nUpdate your banking info: https://bit.ly/verify-account-secure", "https://bit.ly/verify-account-secure", 1),
    ("Your PayPal account needs immediate verification", "noreply@paypal-secure.xyz", "support@paypal-verify.top", "Click here now to verify your identity and update your payment method.\nVerify Account: https://bit.ly/paypal-verify\nYour account will be suspended in 24 hours if not verified.", "https://bit.ly/paypal-verify", 1),
    ("Urgent: Update your Amazon payment information", "security@amazon-alerts.club", "noreply@amazon-alerts.link", "Your Amazon account has suspicious activity.\nConfirm password: ______\nCredit card: ______\nhttps://192.168.1.100/amazon/verify\nAuthentication-Results: spf=softfail dkim=none\nCall +1 (555) 123-4567 or 555-123-4567. www.amazon-help.example/form?q=1.", "https://192.168.1.100/amazon/verify", 1),
    ("RE: Infrastructure access", "User@Company.COM", "user@company.com", "<form action=\"/login\" method=\"post\"><a href=\"https://files.example.net/path\">portal.example.com</a> &amp; <b>more</b></form>\nContact ops@mail.example.org or billing@gmail.com host 8.8.8.8 and 10.0.0.5 and 224.0.0.9 mac 00:1A:2B:3C:4D:5E via gw.example:8443 SPF: v=spf1 -all\npassword: enter, card 4111 1111 1111 1111, security question, click to pay\n-- \nkind regards\nSent from my phone", "https://example.com/path%2Fadmin%3Fpass%3D123", 0),
    ("Order Confirmation #12345", "orders@amazon.com", "orders@amazon.com", "Thank you for your order!\nOrder ID: 12345\nTotal: $99.99\nTrack your order: https://amazon.com/orders/12345", "https://amazon.com/orders/12345", 0),
]
EXTRA_URLS = ["https://192.168.1.1/admin", "https://suspicious-domain.xyz"]  # of template 15
TEMPLATE_COUNT = len(TEMPLATES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Uses all cores when a small file gives fewer tasks than there are cores. Scans of real size
    have more splits than cores and pass through unchanged, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _template(field: str) -> Column:
    position = TEMPLATE_FIELDS.index(field)
    values = F.array(*[F.lit(row[position]) for row in TEMPLATES])
    return F.element_at(values, (F.col("doc_id") % TEMPLATE_COUNT + 1).cast("int"))


def emails(
    spark: SparkSession, sf_dir: str, urls: bool = False, ts: bool = False, text: bool = True,
    documents: DataFrame | None = None,
) -> DataFrame:
    """One mail per document. ``urls`` joins page URLs, ``ts`` joins event times; ``documents`` may
    be a stream of that table."""
    docs = documents if documents is not None else table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", *(["text"] if text else []))
    if text and not docs.isStreaming:
        docs = spread(docs, "doc_id")
    d = F.col("doc_id")
    out = docs.select(
        "doc_id",
        d.alias("id"),
        *[_template(f).alias(f) for f in ("subject", "from_email", "reply_to", "label")],
        *([F.concat(_template("snippet"), F.lit("\n"), F.col("text")).alias("body")] if text else []),
        "source",
        F.when(d % 4 == 0, "team@company.com, ops@company.com").otherwise("user@company.com").alias("to_email"),
        F.map_filter(
            F.create_map(
                F.lit("received-spf"),
                F.when(d % 3 == 0, "pass (sender permitted)").when(d % 3 == 1, "fail (not permitted)"),
                F.lit("dkim-signature"), F.when(d % 2 == 0, "v=1; a=rsa-sha256"),
                F.lit("reply-to"), _template("reply_to"),
                F.lit("return-path"), F.when(d % 6 == 0, "<bounce@mailer.example.net>"),
                F.lit("cc"), F.when(d % 5 == 0, "a@company.com, b@company.com, "),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        F.when(
            d % 7 == 0,
            F.array(F.struct(F.lit("Invoice.ZIP").alias("filename"), F.lit("application/zip").alias("content_type"), F.lit(2048).cast("bigint").alias("size"))),
        ).when(
            d % 7 == 1,
            F.array(
                F.struct(F.lit("notes.pdf").alias("filename"), F.lit("application/pdf").alias("content_type"), F.lit(512).cast("bigint").alias("size")),
                F.struct(F.lit("photo.png").alias("filename"), F.lit("image/png").alias("content_type"), F.lit(1024).cast("bigint").alias("size")),
            ),
        ).otherwise(F.array().cast("array<struct<filename:string,content_type:string,size:bigint>>")).alias("attachments"),
    )
    if urls:
        pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
        total = pages.agg(F.count("*").alias("n")).scalar()
        out = out.withColumn("_page", F.when(d % 3 != 0, d % total))
        out = out.join(pages, F.col("_page") == F.col("page_id"), "left")
        first = F.concat(
            F.array(_template("url")),
            F.when(d % TEMPLATE_COUNT == 15, F.array(*[F.lit(u) for u in EXTRA_URLS])).otherwise(F.array().cast("array<string>")),
        )
        out = out.withColumn(
            "urls",
            F.when(d % 11 == 0, F.array().cast("array<string>"))
            .when(F.col("page_url").isNotNull(), F.concat(first, F.array("page_url")))
            .otherwise(first),
        ).drop("_page", "page_id", "page_url")
    if ts:
        times = table(spark, sf_dir, "events").select(F.col("event_id"), "ts")
        out = out.join(times, out.doc_id == times.event_id, "left").drop("event_id")
    return out.drop("doc_id")


def email_urls(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """One row per (mail, url position); mails without URLs give no row."""
    return unpacked(emails(spark, sf_dir, urls=True, text="body" in carry), ["id", *carry], F.col("urls"), "pos", "url")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labels per labelled document: quality, toxic, template."""
    rows = table(spark, sf_dir, "labels")
    position = TEMPLATE_FIELDS.index("label")
    own = F.element_at(
        F.array(*[F.lit(r[position]) for r in TEMPLATES]), (F.col("doc_id") % TEMPLATE_COUNT + 1).cast("int")
    )
    return rows.select(
        F.col("doc_id").alias("id"), F.explode(F.array(F.col("quality"), F.col("toxic"), own)).alias("label")
    )


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scan_id"), "event_id", "ts", scan_status().alias("status"), "value"
    )


def scan_status() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "queued")
        .when(kind.isin("view", "click"), "running")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic models; ties in the score occur on purpose."""
    docs = emails(spark, sf_dir, text=False).select("id", "label", "source")
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), (((F.col("id") * c) % 101) / F.lit(100.0)).alias("probability"))
            for m, c in (("alpha", 37), ("beta", 53), ("gamma", 71))
        ]
    )
    # ids are spread over 0..100, so the score is cut to [0, 1]
    return docs.select("id", "label", "source", F.explode(models).alias("m")).select(
        "id", "label", "source", "m.model", F.least(F.col("m.probability"), F.lit(1.0)).alias("probability")
    )


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts of page URLs and template URLs with a small number each."""
    from lurelens.functions.links import hostname

    pages = table(spark, sf_dir, "pages").select(
        hostname(F.col("url")).alias("domain"), F.col("page_id").alias("m")
    )
    return pages.unionByName(_template_hosts(spark, sf_dir)).groupBy("domain").agg(F.min("m").alias("m"))


def _template_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lurelens.functions.links import hostname

    urls = [(row[4], i) for i, row in enumerate(TEMPLATES)]
    literal = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(i).cast("bigint").alias("m")) for u, i in urls])
    return spark.range(1).select(F.explode(literal).alias("x")).select(
        hostname(F.col("x.u")).alias("domain"), F.col("x.m").alias("m")
    )


OBSERVED = "2024-01-01 12:00:00"


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot: A, NS, MX, TXT unless (m + k) % 5 = 0; a _dmarc TXT for even m."""
    m = F.col("m")
    values = {
        "A": F.concat(F.lit("198.51.100."), (m % 250).cast("string")),
        "NS": F.concat(F.lit("ns1."), F.col("domain")),
        "MX": F.concat(F.lit("mx1."), F.col("domain")),
        "TXT": F.when(m % 3 == 0, "site-check=1").otherwise("v=spf1 include:mail -all"),
    }
    none = F.lit(None).cast("struct<domain:string,rdtype:string,value:string>")
    rows = [
        F.when(
            (m + k) % 5 != 0,
            F.struct(F.col("domain").alias("domain"), F.lit(t).alias("rdtype"), v.alias("value")),
        ).otherwise(none)
        for k, (t, v) in enumerate(values.items())
    ]
    rows.append(
        F.when(
            m % 2 == 0,
            F.struct(
                F.concat(F.lit("_dmarc."), F.col("domain")).alias("domain"), F.lit("TXT").alias("rdtype"),
                F.lit("v=DMARC1; p=none").alias("value"),
            ),
        ).otherwise(none)
    )
    return (
        url_hosts(spark, sf_dir)
        .select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
        .select("r.*", F.lit(OBSERVED).cast("timestamp_ntz").alias("observed_at"))
    )


def reputation(spark: SparkSession, sf_dir: str, kind: str = "domain") -> DataFrame:
    """Two observations per key, one hour apart; the later one has one more malicious vote."""
    if kind == "domain":
        keys = url_hosts(spark, sf_dir).select(F.col("domain").alias("key"), "m")
    else:
        pages = table(spark, sf_dir, "pages").select(F.lower("url").alias("key"), F.col("page_id").alias("m"))
        keys = pages.groupBy("key").agg(F.min("m").alias("m"))
    m = F.col("m")
    first = F.lit(OBSERVED).cast("timestamp_ntz") + F.make_dt_interval(mins=(m % 600).cast("int"))
    status = F.when(m % 9 == 0, "queued").when(m % 9 == 1, "rate_limited").otherwise("completed")
    return keys.select(
        "key", "m", status.alias("status"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), first.alias("_first"),
    ).select(
        "key",
        ((m % 7) + F.col("step")).alias("malicious"),
        (m % 5).alias("suspicious"),
        F.lit(60).cast("bigint").alias("harmless"),
        F.lit(10).cast("bigint").alias("undetected"),
        "status",
        (F.col("_first") + F.make_dt_interval(hours=F.col("step"))).alias("observed_at"),
    )


def dns_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup outcome per host."""
    m = F.col("m")
    status = (
        F.when(m % 5 != 0, "resolved").when(m % 15 == 5, "timeout").when(m % 15 == 10, "error").otherwise("unresolved")
    )
    return url_hosts(spark, sf_dir).select("domain", status.alias("dns_status"))


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed keys: every tenth page URL (normalised) and the hosts of every seventh page."""
    from lurelens.functions import links as L

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = pages.filter("page_id % 10 = 0").select(F.lower(L.origin_and_path(F.col("url"))).alias("key"))
    host = pages.filter("page_id % 7 = 0").select(L.hostname(F.col("url")).alias("key"))
    return url.unionByName(host).distinct()
