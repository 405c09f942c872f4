"""Source, cleaning and quality queries with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.text import flag, round6
from lurelens.operators import cleaning as C
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.registry import query
from lurelens.sources import mail as M
from lurelens.sources import tables as T


def _decode(x):
    for e, c in rules.ENTITIES:
        x = f"replace({x}, {s.lit(e)}, {s.lit(c)})"
    return x


def _strip_html(x):
    return _decode(f"regexp_replace(regexp_replace({x}, {s.lit(C.HIDDEN)}, '', 'g'), '<[^>]*>', '', 'g')")


@query("html_text", s.sql(f"SELECT page_id, {_strip_html('html')} AS plain FROM pages"))
def html_text(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", C.strip_html(F.col("html")).alias("plain"))


@query("html_text__parser")
def html_text_parser(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", C.parse_html(F.col("html")).alias("plain"))


_MASKS = {
    "no_urls": f"regexp_replace(body, {s.lit(rules.URL_EXTRACT['plain'])}, '', 'g')",
    "masked_addresses": "regexp_replace(body, '\\S+@\\S+', 'EMAIL', 'g')",
    "masked_phones": f"regexp_replace(body, {s.lit(rules.PHONE_PATTERN)}, 'PHONE', 'g')",
    "no_numbers": "regexp_replace(body, '\\b\\d+\\b', '', 'g')",
    "no_special": "regexp_replace(body, '[^a-zA-Z0-9\\s.,!?\\-]', '', 'g')",
}


@query("text_masks", s.sql("SELECT id, " + ", ".join(f"md5({c}) AS {n}" for n, c in _MASKS.items()) + " FROM emails", "emails"))
def text_masks(spark, sf):
    b = F.col("body")
    cols = {"no_urls": C.strip_urls(b), "masked_addresses": C.mask_addresses(b), "masked_phones": C.mask_phones(b), "no_numbers": C.drop_numbers(b), "no_special": C.drop_special(b)}
    return fx.emails(spark, sf).select("id", *[F.md5(c).alias(n) for n, c in cols.items()])


def _signature(x):
    """The footer lookahead has no twin in this dialect; the end mark is matched and put back."""
    for p in rules.SIGNATURE_PATTERNS + rules.FOOTER_PATTERNS[:2]:
        x = f"regexp_replace({x}, {s.lit(p)}, '', 'g')"
    return f"regexp_replace({x}, '(?is)(Disclaimer|Copyright|Confidential):.*?(\\n\\n|\\z)', '\\2', 'g')"


def _tidy(x):
    return f"regexp_replace(regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("without_signature", s.sql(f"SELECT id, md5(t) AS digest, CAST(length(t) AS INT) AS chars FROM (SELECT id, {_signature('body')} AS t FROM emails)", "emails"))
def without_signature(spark, sf):
    t = fx.emails(spark, sf).select("id", C.drop_signature(F.col("body")).alias("t"))
    return t.select("id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


_CLEAN_STEPS = _signature(_strip_html("body"))
_CLEAN = f"lower({_tidy(f'''regexp_replace(regexp_replace(x1, '\\S+@\\S+', 'EMAIL', 'g'), {s.lit(rules.PHONE_PATTERN)}, 'PHONE', 'g')''')})"
_CLEAN_ALL = f"lower({_tidy(f'''regexp_replace(regexp_replace(regexp_replace(regexp_replace(x1, {s.lit(rules.URL_EXTRACT['plain'])}, '', 'g'), '\\S+@\\S+', 'EMAIL', 'g'), {s.lit(rules.PHONE_PATTERN)}, 'PHONE', 'g'), '\\b\\d+\\b', '', 'g')''')})"


@query("clean_body__default", s.sql(f"SELECT id, {_CLEAN} AS cleaned FROM (SELECT id, {_CLEAN_STEPS} AS x1 FROM emails)", "emails"))
def clean_body_default(spark, sf):
    return fx.emails(spark, sf).select("id", C.clean_body(F.col("body")).alias("cleaned"))


@query("clean_body__strict", s.sql(f"SELECT id, {_CLEAN_ALL} AS cleaned FROM (SELECT id, {_CLEAN_STEPS} AS x1 FROM emails)", "emails"))
def clean_body_strict(spark, sf):
    return fx.emails(spark, sf).select("id", C.clean_body(F.col("body"), urls=True, numbers=True).alias("cleaned"))


@query("clean_subject", s.sql(f"SELECT id, lower({_tidy("'  ' || subject")}) AS cleaned FROM emails", "emails"))
def clean_subject(spark, sf):
    return fx.emails(spark, sf, text=False).select("id", C.clean_subject(F.concat(F.lit("  "), F.col("subject"))).alias("cleaned"))


_TOKENS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]+$'))"


@query("tokens", s.sql(f"SELECT id, CAST(len(l) AS INT) AS token_count, md5(array_to_string(l, ' ')) AS digest FROM (SELECT id, list_filter({_TOKENS.format(t='body')}, lambda w: NOT list_contains({s.arr(rules.STOPWORDS)}, w)) AS l FROM emails)", "emails"))
def tokens(spark, sf):
    rows = fx.emails(spark, sf).select("id", C.word_tokens(F.col("body"), rules.STOPWORDS).alias("l"))
    return rows.select("id", F.size("l").alias("token_count"), F.md5(F.array_join("l", " ")).alias("digest"))


_TT = {
    "simple": "subject || ' ' || body || ' ' || array_to_string(urls, ',')",
    "hybrid": "subject || ' ' || body || ' ' || from_email",
    "server": "subject || ' ' || from_email || ' ' || body || ' ' || array_to_string(urls, ',')",
}


@query("training_texts", s.sql("SELECT id, " + ", ".join(f"md5({c}) AS {n}" for n, c in _TT.items()) + " FROM emails", "email_urls"))
def training_texts(spark, sf):
    rows = fx.emails(spark, sf, urls=True).withColumn("url_text", F.array_join("urls", ","))
    return rows.select("id", *[F.md5(C.training_text(v)).alias(v) for v in _TT])


_NAMES = ["Legitimate", "ham", "PHISHING ", "spam", "phishing_email", "other"]


def _label_sql(policy):
    return "CASE lower(trim(name)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.LABELS[policy].items()) + " END"


@query("labels_normalized", s.sql(f"SELECT doc_id, name, {_label_sql('default')} AS label_default, {_label_sql('spam_is_legitimate')} AS label_spam_legit FROM (SELECT doc_id, {s.arr(_NAMES)}[(doc_id % 6 + 1)::INT] AS name FROM labels)"))
def labels_normalized(spark, sf):
    names = F.array(*[F.lit(n) for n in _NAMES])
    rows = fx.table(spark, sf, "labels").select("doc_id", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("name"))
    n = F.col("name")
    return rows.select("doc_id", "name", C.normalize_label(n).alias("label_default"), C.normalize_label(n, "spam_is_legitimate").alias("label_spam_legit"))


_GATE = """array_to_string(list_filter([CASE WHEN length(subject) < 1 THEN 'Subject line is required' END, CASE WHEN length(body) < 10 THEN 'Email body must be at least 10 characters' END,
 CASE WHEN length(subject) > 500 THEN 'Subject line is too long (max 500 chars)' END, CASE WHEN length(body) > 50000 THEN 'Email body is too long (max 50000 chars)' END,
 CASE WHEN NOT regexp_matches(from_email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'Sender address is not valid' END,
 CASE WHEN len(list_filter(urls, lambda u: NOT regexp_matches(u, '^https?://\\S+$'))) > 0 THEN 'URL is not valid' END], lambda v: v IS NOT NULL), '; ')"""


@query("quality_gate", s.sql(f"SELECT id, {_GATE} AS errors FROM x", "email_urls", x="SELECT id, CASE WHEN id % 13 = 0 THEN '' WHEN id % 13 = 1 THEN repeat(subject, 60) ELSE subject END AS subject, CASE WHEN id % 17 = 0 THEN 'short' WHEN id % 17 = 1 THEN repeat(body, 60) ELSE body END AS body, CASE WHEN id % 19 = 0 THEN 'nobody' ELSE from_email END AS from_email, CASE WHEN id % 23 = 0 THEN list_concat(urls, ['ht!tp://invalid', '']) ELSE urls END AS urls FROM emails"))
def quality_gate(spark, sf):
    k = F.col("id")
    rows = fx.emails(spark, sf, urls=True).select(
        "id",
        F.when(k % 13 == 0, "").when(k % 13 == 1, F.repeat("subject", 60)).otherwise(F.col("subject")).alias("subject"),
        F.when(k % 17 == 0, "short").when(k % 17 == 1, F.repeat("body", 60)).otherwise(F.col("body")).alias("body"),
        F.when(k % 19 == 0, "nobody").otherwise(F.col("from_email")).alias("from_email"),
        F.when(k % 23 == 0, F.concat("urls", F.array(F.lit("ht!tp://invalid"), F.lit("")))).otherwise(F.col("urls")).alias("urls"),
    )
    return rows.select("id", F.array_join(C.quality_errors(), "; ").alias("errors"))


_FT = "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value, CAST(user_id AS DOUBLE) AS user_id, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events"


def _feature_table(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), F.col("user_id").cast("double"), F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("k"))


@query("feature_validation", s.sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, {s.r6(f'(count(*) - count({c})) / count(*)::DOUBLE')} AS missing_share, {s.r6(f'avg({c})')} AS mean, {s.r6(f'stddev_pop({c})')} AS std, count(CASE WHEN abs({c} - (SELECT avg({c}) FROM f)) > 3 * (SELECT stddev_pop({c}) FROM f) THEN 1 END) AS outliers FROM f" for c in ("value", "user_id", "k")), f=_FT))
def feature_validation(spark, sf):
    out = C.validate_table(_feature_table(spark, sf), ["value", "user_id", "k"])
    return out.select("feature", "rows", *[round6(F.col(c)).alias(c) for c in ("missing_share", "mean", "std")], "outliers")


@query("feature_correlation", s.sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {s.r6(f'corr({a}, {b})')} AS corr FROM f" for a, b in (("value", "user_id"), ("value", "k"), ("user_id", "k"))), f=_FT))
def feature_correlation(spark, sf):
    return C.correlations(_feature_table(spark, sf), ["value", "user_id", "k"]).withColumn("corr", round6(F.col("corr")))


@query("feature_repair", s.sql("SELECT event_id, greatest(1e0, least(2e1, coalesce(value, 5e0))) AS value, user_id, k FROM f", f=_FT))
def feature_repair(spark, sf):
    return C.repair_columns(_feature_table(spark, sf), {"value": (1.0, 20.0)}, {"value": 5.0})


@query("pseudonyms", s.sql("SELECT id, sha256(lower(from_email)) AS sender FROM emails", "emails"))
def pseudonyms(spark, sf):
    return fx.emails(spark, sf, text=False).select("id", C.pseudonymize(F.col("from_email")).alias("sender"))


# -- sources over message text derived from the tables -----------------------------
_RAW = """CASE id % 4 WHEN 0 THEN 'Subject: old' || chr(10) || 'From: ' || from_email || chr(10) || 'X: 1' || chr(10) || chr(10) || body || chr(10) || 'Subject: ' || subject
 WHEN 1 THEN 'From: ' || from_email || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body WHEN 2 THEN body ELSE 'Subject: ' || subject || chr(10) || 'no blank line' END"""


def _raw(spark, sf):
    k, nl = F.col("id") % 4, F.lit("\n")
    subj, frm = F.concat(F.lit("Subject: "), F.col("subject")), F.concat(F.lit("From: "), F.col("from_email"))
    raw = (
        F.when(k == 0, F.concat(F.lit("Subject: old"), nl, frm, nl, F.lit("X: 1"), nl, nl, F.col("body"), nl, subj))
        .when(k == 1, F.concat(frm, nl, subj, nl, nl, F.col("body"))).when(k == 2, F.col("body"))
        .otherwise(F.concat(subj, nl, F.lit("no blank line")))
    )
    return fx.emails(spark, sf).select("id", "label", raw.alias("raw"))


_SPLIT = {
    "r": f"SELECT id, label, {_RAW} AS raw FROM emails",
    "li": "SELECT id, label, raw, string_split(raw, chr(10)) AS ls FROM r",
    "pt": "SELECT id, label, raw, list_filter(ls, lambda x: starts_with(x, 'Subject:')) AS su, list_filter(ls, lambda x: starts_with(x, 'From:')) AS fr, list_filter(ls, lambda x: NOT starts_with(x, 'Subject:') AND NOT starts_with(x, 'From:')) AS rest FROM li",
    "bo": "SELECT *, list_position(list_transform(rest, lambda x: regexp_replace(x, '\\s+', '', 'g') = ''), true) AS b FROM pt",
    "fi": "SELECT id, label, raw, coalesce(trim(replace(su[-1], 'Subject:', '')), '') AS subject, coalesce(trim(replace(fr[-1], 'From:', '')), '') AS sender, CASE WHEN b > 0 THEN regexp_replace(array_to_string(rest[b + 1:], chr(10)), '^\\s+|\\s+$', '', 'g') ELSE '' END AS body FROM bo",
    "un": f"SELECT id, CASE WHEN subject = '' THEN substr(raw, 1, 100) ELSE subject END AS subject, CASE WHEN sender = '' THEN 'unknown@email.com' ELSE sender END AS from_email, CASE WHEN body = '' THEN raw ELSE body END AS body, array_to_string(regexp_extract_all(raw, {s.lit(rules.URL_EXTRACT['adapter'])}), ',') AS urls, label FROM fi",
}


@query("raw_message_fields", s.sql("SELECT id, subject, from_email, md5(body) AS body_digest, urls, label FROM un", "emails", **_SPLIT))
def raw_message_fields(spark, sf):
    out = T.adapt_raw(_raw(spark, sf), F.col("raw"), F.col("label"), "id")
    return out.select("id", "subject", "from_email", F.md5("body").alias("body_digest"), "urls", "label")


@query("combined_class_counts", s.sql("SELECT origin, label, count(*) AS rows FROM (SELECT 'adapted' AS origin, label FROM un UNION ALL SELECT 'mails', label FROM emails) GROUP BY ALL", "emails", **_SPLIT))
def combined_class_counts(spark, sf):
    adapted = T.adapt_raw(_raw(spark, sf), F.col("raw"), F.col("label"), "id").withColumn("origin", F.lit("adapted"))
    own = fx.emails(spark, sf, text=False).withColumn("origin", F.lit("mails"))
    return T.class_counts(T.combine(adapted, own), "origin")


@query("json_line_mails", s.sql("SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 9 = 0 THEN '' ELSE subject END AS subject, from_email, 'json' AS source, CASE WHEN id % 5 <> 0 THEN label END AS label FROM emails WHERE id % 8 <> 0", "emails"))
def json_line_mails(spark, sf):
    k = F.col("id")
    line = F.to_json(F.struct(
        k.cast("string").alias("id"), F.when(k % 9 != 0, F.col("subject")).alias("subject"), F.col("from_email").alias("from"),
        F.when(k % 5 != 0, F.col("label")).alias("label")))
    lines = fx.emails(spark, sf, text=False).select(F.when(k % 8 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value"))
    good, _ = M.split_bad(M.parse_json_lines(lines, "value"))
    return good.select("id", "subject", "from_email", "source", "label")


@query("json_line_quarantine", s.sql("SELECT count(*) AS bad_lines FROM emails WHERE id % 8 = 0", "emails"))
def json_line_quarantine(spark, sf):
    k = F.col("id")
    line = F.to_json(F.struct(k.cast("string").alias("id"), "subject"))
    lines = fx.emails(spark, sf, text=False).select(F.when(k % 8 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value"))
    _, bad = M.split_bad(M.parse_json_lines(lines, "value"))
    return bad.agg(F.count("*").alias("bad_lines"))


_MSG_URL = f"regexp_extract_all(body, {s.lit(rules.URL_EXTRACT['loader'])})"


@query("mime_messages", s.sql(f"""SELECT '<' || id || '@list.example>' AS message_id, regexp_replace(subject, '—', '-') AS subject, from_email, to_email, CASE WHEN id % 3 = 2 THEN '' ELSE md5(regexp_replace(body, '\\n+$', '')) END AS body_digest,
 CASE WHEN id % 3 = 2 THEN 0 ELSE CAST(len(list_distinct({_MSG_URL})) AS INT) END AS url_count, CASE WHEN id % 3 = 1 THEN 'data.bin' ELSE '' END AS files FROM emails""", "emails"))
def mime_messages(spark, sf):
    """Builds plain, multipart and HTML-only messages from the mails, then decodes them."""
    k, nl = F.col("id") % 3, F.lit("\n")
    head = F.concat(
        F.lit("From: "), F.col("from_email"), F.lit("\nTo: "), F.col("to_email"),
        F.lit("\nSubject: =?utf-8?B?"), F.base64(F.encode(F.regexp_replace("subject", "—", "-"), "UTF-8")), F.lit("?=\nMessage-ID: <"), F.col("id"), F.lit("@list.example>\nMIME-Version: 1.0\n"))
    code = F.regexp_replace(F.base64(F.encode("body", "UTF-8")), r"\s", "")
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), code)
    part = F.lit("\n--b1\n")
    multi = F.concat(F.lit('Content-Type: multipart/mixed; boundary="b1"\n'), part, plain, part, F.lit('Content-Type: application/octet-stream\nContent-Disposition: attachment; filename="data.bin"\n\nxyz\n--b1--\n'))
    html = F.concat(F.lit('Content-Type: multipart/alternative; boundary="b1"\n'), part, F.lit("Content-Type: text/html\n\n<p>only</p>\n--b1--\n"))
    raw = F.concat(head, F.when(k == 0, plain).when(k == 1, multi).otherwise(html))
    good, _ = M.split_bad(M.parse_mime(fx.emails(spark, sf).select(raw.alias("content")), "content"))
    digest = F.when(F.col("body") == "", "").otherwise(F.md5(F.regexp_replace("body", r"\n+\z", "")))
    return good.select(
        F.col("id").alias("message_id"), "subject", "from_email", "to_email", digest.alias("body_digest"), F.size("urls").alias("url_count"),
        F.array_join(F.transform("attachments", lambda a: a.filename), ",").alias("files"))
