"""Report, history, split and evaluation queries with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.risk import ladder
from lurelens.functions.text import flag, round6
from lurelens.operators import analytics as A
from lurelens.operators import cleaning as C
from lurelens.operators import evaluation as V
from lurelens.operators import neardup as N
from lurelens.operators import splits as S
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.q_features import rounded
from lurelens.plans.registry import query
from lurelens.session import work_folder

_VERDICTS = f"SELECT id, model, label, source, CAST(probability > 5e-1 AS INT) AS phishing, greatest(probability, 1e0 - probability) AS confidence, {s.ladder('probability', 'ensemble')} AS risk_level FROM predictions"


def verdicts(spark, sf):
    p = F.col("probability")
    return fx.predictions(spark, sf).select(
        "id", "model", "label", "source", flag(p > 0.5).alias("phishing"), F.greatest(p, F.lit(1.0) - p).alias("confidence"),
        ladder(p, "ensemble").alias("risk_level"))


_BASE = "count(*) AS total, count(CASE WHEN phishing = 1 THEN 1 END) AS phishing, count(CASE WHEN phishing = 0 THEN 1 END) AS legitimate"
_RATIO = f"{s.r6('count(CASE WHEN phishing = 1 THEN 1 END) / count(*)::DOUBLE')} AS phishing_ratio, {s.r6('avg(confidence)')} AS avg_confidence"


@query("batch_statistics", s.sql(f"SELECT model, {_BASE}, {_RATIO} FROM v GROUP BY model", "predictions", v=_VERDICTS))
def batch_statistics(spark, sf):
    return rounded(A.batch_statistics(verdicts(spark, sf), "model"))


@query("prediction_report", s.sql(f"SELECT {_BASE}, {_RATIO}, {s.r6('min(confidence)')} AS min_confidence, {s.r6('max(confidence)')} AS max_confidence, {s.r6('stddev_pop(confidence)')} AS std_confidence FROM v", "predictions", v=_VERDICTS))
def prediction_report(spark, sf):
    return rounded(A.prediction_report(verdicts(spark, sf)))


@query("dashboard_tiles", s.sql("SELECT count(*) AS total, count(CASE WHEN phishing = 1 THEN 1 END) AS phishing, count(CASE WHEN risk_level = 'MEDIUM' THEN 1 END) AS suspicious, count(CASE WHEN risk_level = 'LOW' THEN 1 END) AS safe FROM v", "predictions", v=_VERDICTS))
def dashboard_tiles(spark, sf):
    return A.dashboard_tiles(verdicts(spark, sf))


@query("class_distribution", s.sql(f"SELECT source, label, count(*) AS rows, {s.r6('count(*) / (SELECT count(*) FROM emails)::DOUBLE')} AS share FROM emails GROUP BY source, label", "emails"))
def class_distribution(spark, sf):
    return rounded(A.class_distribution(fx.emails(spark, sf, text=False), "source", "label"))


_TOK = "SELECT id, len(l) AS token_count, list_distinct(l) AS l, len(urls) AS nu FROM (SELECT id, urls, list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]+$')) AS l FROM emails)"


@query("corpus_statistics", s.sql(f"""SELECT count(*) AS mails, {s.r6('avg(token_count)')} AS avg_length, {s.r6('quantile_cont(token_count, 0.5)')} AS median_length, CAST(min(token_count) AS INT) AS min_length, CAST(max(token_count) AS INT) AS max_length,
 {s.r6('count(CASE WHEN token_count < 50 THEN 1 END) / count(*)::DOUBLE')} AS short_share, {s.r6('count(CASE WHEN token_count > 2000 THEN 1 END) / count(*)::DOUBLE')} AS long_share, {s.r6('avg(nu)')} AS avg_urls, {s.r6('count(CASE WHEN nu > 0 THEN 1 END) / count(*)::DOUBLE')} AS with_urls_share FROM t""", "emails", t=_TOK))
def corpus_statistics(spark, sf):
    rows = fx.emails(spark, sf, urls=True).select("urls", F.size(C.word_tokens(F.col("body"))).alias("token_count"))
    return rounded(A.corpus_statistics(rows))


@query("vocabulary_size", s.sql("SELECT count(*) AS vocabulary, CAST(sum(df) AS BIGINT) AS postings FROM (SELECT term, count(*) AS df FROM (SELECT unnest(l) AS term FROM t) GROUP BY term)", "emails", t=_TOK))
def vocabulary_size(spark, sf):
    return A.vocabulary_size(fx.emails(spark, sf).select(C.word_tokens(F.col("body")).alias("tokens")))


@query("exact_duplicates", s.sql("SELECT min(id) AS id, count(*) AS copies FROM emails GROUP BY subject, body, from_email", "emails"))
def exact_duplicates(spark, sf):
    return A.exact_duplicates(fx.emails(spark, sf), "subject", "body", "from_email")


@query("deduplicated_documents", s.sql("SELECT doc_id AS id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"))
def deduplicated_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return A.drop_duplicates(docs, "text").select("id")


_NEAR = {
    "wd": "SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS w FROM documents",
    "cn": "SELECT id, word, count(*) AS n FROM (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS word FROM wd) GROUP BY ALL",
    "wt": "SELECT id, word, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM cn",
}


@query("near_duplicates", s.sql("SELECT DISTINCT b.id FROM (SELECT a.id AS first, b.id FROM wt a JOIN wt b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.x * b.x) >= 0.95 - 1e-9) b", **_NEAR))
def near_duplicates(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return N.near_duplicates(docs, work_folder(spark))


@query("majority_labels", s.sql(f"SELECT id, label, {s.r6('n / tot')} AS confidence, CAST(n / tot >= 8.5e-1 AS INT) AS accepted FROM (SELECT id, label, n::DOUBLE AS n, sum(n) OVER (PARTITION BY id)::DOUBLE AS tot, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM (SELECT id, label, count(*) AS n FROM votes GROUP BY id, label)) WHERE rn = 1", "votes"))
def majority_labels(spark, sf):
    return rounded(A.majority_labels(fx.votes(spark, sf)))


@query("history_page", s.sql("SELECT id, subject, ts FROM emails ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 5", "emails"))
def history_page(spark, sf):
    return A.history_page(fx.emails(spark, sf, ts=True, text=False).select("id", "subject", "ts"), 20, 5)


@query("history_recent", s.sql("SELECT id, ts FROM emails WHERE ts >= (SELECT max(ts) FROM emails) - INTERVAL 1 HOUR ORDER BY ts DESC, id DESC LIMIT 500", "emails"))
def history_recent(spark, sf):
    return A.history_page(fx.emails(spark, sf, ts=True, text=False).select("id", "ts"), 500, keep_hours=1)


_HIST = f"SELECT e.id, e.ts, e.subject, e.from_email, v.phishing, v.risk_level FROM emails e JOIN ({_VERDICTS}) v ON v.id = e.id AND v.model = 'alpha'"


def _history(spark, sf):
    p = F.least(((F.col("id") * 37) % 101) / F.lit(100.0), F.lit(1.0))
    rows = fx.emails(spark, sf, ts=True, text=False)
    return rows.select("id", "ts", "subject", "from_email", flag(p > 0.5).alias("phishing"), ladder(p, "ensemble").alias("risk_level"))


@query("history_search", s.sql("SELECT id, subject, from_email, risk_level FROM h WHERE contains(lower(subject), 'verify') OR contains(lower(from_email), 'verify') ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, id LIMIT 50", "predictions", h=_HIST))
def history_search(spark, sf):
    out = A.search_history(_history(spark, sf), "Verify", sort="risk_level", ascending=True, limit=50)
    return out.select("id", "subject", "from_email", "risk_level")


@query("high_risk_alerts", s.sql("SELECT id, risk_level, subject FROM h WHERE risk_level IN ('CRITICAL', 'HIGH')", "predictions", h=_HIST))
def high_risk_alerts(spark, sf):
    return A.high_risk_alerts(_history(spark, sf)).select("id", "risk_level", "subject")


@query("latest_scan_status", s.sql("SELECT scan_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(status, (ts, event_id)) AS status, count(*) AS updates FROM scan_events GROUP BY scan_id", "scan_events"))
def latest_scan_status(spark, sf):
    return A.latest_per_scan(fx.scan_events(spark, sf))


@query("scan_status_counts", s.sql("SELECT scan_id, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, count(CASE WHEN status = 'queued' THEN 1 END) AS queued, count(CASE WHEN status NOT IN ('completed', 'queued') THEN 1 END) AS failed FROM scan_events GROUP BY scan_id", "scan_events"))
def scan_status_counts(spark, sf):
    return A.status_counts(fx.scan_events(spark, sf), "scan_id")


# -- splits ------------------------------------------------------------------------
def _ranks(source="emails"):
    return f"SELECT id, label, from_email, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {source}"


_SPLIT = "CASE WHEN rn <= floor(n * 7e-1) THEN 'train' WHEN rn <= floor(n * 8.5e-1) THEN 'validation' ELSE 'test' END"


def _labelled(spark, sf):
    return fx.emails(spark, sf, text=False).select("id", "label", "from_email")


@query("stratified_split", s.sql(f"SELECT id, label, {_SPLIT} AS split FROM r", "emails", r=_ranks()))
def stratified_split(spark, sf):
    return S.stratified_split(_labelled(spark, sf)).select("id", "label", "split")


@query("stratified_split__80_20", s.sql("SELECT id, label, CASE WHEN rn <= floor(n * 8e-1) THEN 'train' ELSE 'test' END AS split FROM r", "emails", r=_ranks()))
def stratified_split_80_20(spark, sf):
    return S.stratified_split(_labelled(spark, sf), ratios=(("train", 0.8), ("test", 1.0))).select("id", "label", "split")


_SHARE = "('0x' || substr(md5('42:' || lower(from_email)), 1, 4))::INT / 65536e0"
_GROUPED = f"SELECT id, label, from_email, CASE WHEN {_SHARE} < 7e-1 THEN 'train' WHEN {_SHARE} < 8.5e-1 THEN 'validation' ELSE 'test' END AS split FROM emails"


@query("sender_grouped_split", s.sql("SELECT id, split FROM g", "emails", g=_GROUPED))
def sender_grouped_split(spark, sf):
    return _labelled(spark, sf).select("id", S.grouped_split(F.col("from_email")).alias("split"))


@query("split_leakage", s.sql("SELECT count(*) AS leaked_senders FROM (SELECT from_email FROM g GROUP BY 1 HAVING count(DISTINCT split) > 1)", "emails", g=_GROUPED))
def split_leakage(spark, sf):
    rows = _labelled(spark, sf).withColumn("split", S.grouped_split(F.col("from_email")))
    return S.leaked_groups(rows, "from_email").agg(F.count("*").alias("leaked_senders"))


_KEEP = "CASE WHEN label = 1 THEN least(p, floor(q * (3.5e-1 / 6.5e-1))) ELSE least(q, floor(p / (3.5e-1 / 6.5e-1))) END"


@query("sampled_to_ratio", s.sql(f"SELECT id, label FROM r, (SELECT count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label = 0 THEN 1 END) AS q FROM emails) WHERE rn <= {_KEEP}", "emails", r=_ranks()))
def sampled_to_ratio(spark, sf):
    return S.sample_to_ratio(_labelled(spark, sf)).select("id", "label")


# -- evaluation ------------------------------------------------------------------------
_CELLS = "count(CASE WHEN label = 0 AND NOT hit THEN 1 END) AS tn, count(CASE WHEN label = 0 AND hit THEN 1 END) AS fp, count(CASE WHEN label = 1 AND NOT hit THEN 1 END) AS fn, count(CASE WHEN label = 1 AND hit THEN 1 END) AS tp"


def _div(a, b):
    return s.r6(f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0e0)")


_RATES = {
    "accuracy": _div("tp + tn", "tn + fp + fn + tp"), "precision": _div("tp", "tp + fp"), "recall": _div("tp", "tp + fn"),
    "f1": _div("2 * tp", "2 * tp + fp + fn"), "specificity": _div("tn", "tn + fp"), "sensitivity": _div("tp", "tp + fn"),
}
_R = ", ".join(f"{c} AS {n}" for n, c in _RATES.items())


def _auc(source, keys):
    """Area as the share of (positive, negative) pairs in the right order, ties counted half."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    totals = f"(SELECT {keys}, probability, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg FROM {source} GROUP BY ALL)"
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"SELECT {ks}, sum(a.pos * b.neg * CASE WHEN a.probability > b.probability THEN 1e0 WHEN a.probability = b.probability THEN 5e-1 ELSE 0e0 END) / sum(a.pos * b.neg) AS auc FROM {totals} a JOIN {totals} b ON {on} GROUP BY {ks}"


@query("model_metrics", s.sql(f"SELECT c.model, tn, fp, fn, tp, {_R}, {s.r6('auc')} AS roc_auc FROM c JOIN a ON a.model = c.model", "predictions", c=f"SELECT model, {_CELLS} FROM (SELECT *, probability > 5e-1 AS hit FROM predictions) GROUP BY model", a=_auc("predictions", "model")))
def model_metrics(spark, sf):
    return rounded(V.metrics(fx.predictions(spark, sf), "model"))


@query("confusion_matrix", s.sql(f"SELECT source, model, {_CELLS} FROM (SELECT *, probability > 5e-1 AS hit FROM predictions) GROUP BY source, model", "predictions"))
def confusion_matrix(spark, sf):
    return V.confusion(fx.predictions(spark, sf), "source", "model")


def _class_row(name, hit, wrong, missed):
    return f"SELECT model, '{name}' AS class, {_div(hit, f'{hit} + {wrong}')} AS precision, {_div(hit, f'{hit} + {missed}')} AS recall, {_div(f'2 * {hit}', f'2 * {hit} + {wrong} + {missed}')} AS f1, {hit} + {missed} AS support FROM c"


def _raw_div(a, b):
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0e0)"


_SENDER = "concat(id % 31, '.', from_email)"


@query("sender_stratified_split", s.sql("SELECT label, source, count(*) AS rows, 1 AS train_holds, 1 AS validation_holds, 1 AS test_holds, CAST(0 AS BIGINT) AS leaked_senders FROM emails GROUP BY label, source", "emails"))
def sender_stratified_split(spark, sf):
    """Shares of every stratum within two points (or two rows) of the ratios, and no sender on two sides."""
    rows = fx.emails(spark, sf, text=False).withColumn("sender", F.expr(_SENDER)).select("id", "sender", "label", "source")
    parts = S.sender_stratified_split(rows, "sender")
    leaked = S.leaked_groups(parts, "sender").agg(F.count("*").alias("n")).scalar()
    n = F.count("*")

    def holds(name, share):
        return flag(F.abs(F.count_if(F.col("split") == name) - n * share) <= F.greatest(n * 0.02, F.lit(2.0))).alias(f"{name}_holds")

    return parts.groupBy("label", "source").agg(n.alias("rows"), holds("train", 0.7), holds("validation", 0.15), holds("test", 0.15)).withColumn("leaked_senders", leaked)


def _avg_row(name, wa, wb):
    pair = {
        "precision": (_raw_div("tn", "tn + fn"), _raw_div("tp", "tp + fp")), "recall": (_raw_div("tn", "tn + fp"), _raw_div("tp", "tp + fn")),
        "f1": (_raw_div("2 * tn", "2 * tn + fn + fp"), _raw_div("2 * tp", "2 * tp + fp + fn")),
    }
    return f"SELECT model, '{name}' AS class, " + ", ".join(f"{s.r6(f'{a} * {wa} + {b} * {wb}')} AS {n}" for n, (a, b) in pair.items()) + ", tn + fp + fn + tp AS support FROM c"


_ALL = "(tn + fp + fn + tp)"


@query("per_class_report", s.sql(" UNION ALL ".join([
    _class_row("Legitimate", "tn", "fn", "fp"), _class_row("Phishing", "tp", "fp", "fn"), _avg_row("macro avg", "5e-1", "5e-1"),
    _avg_row("weighted avg", f"((tn + fp)::DOUBLE / {_ALL})", f"((tp + fn)::DOUBLE / {_ALL})")]), "predictions", c=f"SELECT model, {_CELLS} FROM (SELECT *, probability > 5e-1 AS hit FROM predictions) GROUP BY model"))
def per_class_report(spark, sf):
    return rounded(V.per_class_report(fx.predictions(spark, sf), "model"))


_FOLDS = "SELECT p.*, CAST((r.rn - 1) % 5 AS INT) AS fold, p.probability > 5e-1 AS hit FROM predictions p JOIN r ON r.id = p.id"
_PER_FOLD = {
    "r": _ranks(), "fo": _FOLDS, "c": f"SELECT model, fold, {_CELLS} FROM fo GROUP BY model, fold", "a": _auc("fo", "model, fold"),
    "pf": "SELECT c.model, c.fold, " + ", ".join(f"{_raw_div(x, y)} AS {n}" for n, (x, y) in {"accuracy": ("tp + tn", "tn + fp + fn + tp"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn")}.items()) + ", auc AS roc_auc FROM c JOIN a ON a.model = c.model AND a.fold = c.fold",
}
_FIVE = ("accuracy", "precision", "recall", "f1", "roc_auc")


@query("cross_validation_summary", s.sql("SELECT model, " + ", ".join(f"{s.r6(f'avg({n})')} AS {n}_mean, {s.r6(f'stddev_pop({n})')} AS {n}_std" for n in _FIVE) + " FROM pf GROUP BY model", "predictions", **_PER_FOLD))
def cross_validation_summary(spark, sf):
    folds = S.stratified_folds(_labelled(spark, sf)).select("id", "fold")
    per_fold = V.metrics(fx.predictions(spark, sf).join(folds, "id"), "model", "fold")
    return rounded(V.fold_summary(per_fold, "model"))


@query("model_comparison", s.sql(f"SELECT c.split, c.model, {_R}, {s.r6('auc')} AS roc_auc FROM c JOIN a ON a.model = c.model AND a.split = c.split", "predictions", r=_ranks(), sp=f"SELECT id, {_SPLIT} AS split FROM r", ps="SELECT p.*, sp.split, probability > 5e-1 AS hit FROM predictions p JOIN sp ON sp.id = p.id WHERE split <> 'train'", c=f"SELECT split, model, {_CELLS} FROM ps GROUP BY split, model", a=_auc("ps", "split, model")))
def model_comparison(spark, sf):
    part = S.stratified_split(_labelled(spark, sf)).filter("split <> 'train'").select("id", "split")
    out = V.metrics(fx.predictions(spark, sf).join(part, "id"), "split", "model")
    return rounded(out.drop("tn", "fp", "fn", "tp"))


@query("error_samples", s.sql("SELECT model, error, CAST(rn AS INT) AS rn, id, label, text_preview FROM (SELECT *, row_number() OVER (PARTITION BY model, error ORDER BY id) AS rn FROM (SELECT p.model, p.id, p.label, substr(e.body, 1, 200) AS text_preview, CASE WHEN probability > 5e-1 AND p.label = 0 THEN 'false_positive' WHEN probability <= 5e-1 AND p.label = 1 THEN 'false_negative' END AS error FROM predictions p JOIN emails e ON e.id = p.id) WHERE error IS NOT NULL) WHERE rn <= 5", "predictions"))
def error_samples(spark, sf):
    text = fx.emails(spark, sf).select("id", F.substring("body", 1, 200).alias("text"))
    # ids of the samples first, previews joined to those few rows only
    few = V.error_samples(fx.predictions(spark, sf).withColumn("text", F.lit("")), "model").drop("text_preview")
    return few.join(text.withColumnRenamed("text", "text_preview"), "id").select("model", "error", "rn", "id", "label", "text_preview")


_POINTS = """SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / p AS tpr, fp / n AS fpr, coalesce(tp / nullif(tp + fp, 0), 1e0) AS precision FROM (
 SELECT model, probability AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (sum(pos) OVER (PARTITION BY model))::DOUBLE AS p, (sum(neg) OVER (PARTITION BY model))::DOUBLE AS n FROM (
  SELECT model, probability, count(CASE WHEN label = 1 THEN 1 END)::DOUBLE AS pos, count(CASE WHEN label = 0 THEN 1 END)::DOUBLE AS neg FROM predictions GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY probability DESC))"""


@query("curve_points", s.sql(f"SELECT model, {s.r6('threshold')} AS threshold, tp, fp, {s.r6('tpr')} AS tpr, {s.r6('fpr')} AS fpr, {s.r6('precision')} AS precision FROM pt", "predictions", pt=_POINTS))
def curve_points(spark, sf):
    return rounded(V.curve_points(fx.predictions(spark, sf), "model").drop("tpr_before", "fpr_before", "precision_before"))


@query("curve_areas", s.sql(f"SELECT model, {s.r6('sum((fpr - f0) * (tpr + t0) / 2)')} AS roc_auc, {s.r6('sum((tpr - t0) * (precision + p0) / 2)')} AS pr_auc FROM (SELECT *, coalesce(lag(fpr) OVER w, 0e0) AS f0, coalesce(lag(tpr) OVER w, 0e0) AS t0, coalesce(lag(precision) OVER w, 1e0) AS p0 FROM pt WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)) GROUP BY model", "predictions", pt=_POINTS))
def curve_areas(spark, sf):
    return rounded(V.curve_areas(fx.predictions(spark, sf), "model"))


@query("ensemble_scores", s.sql(f"SELECT id, {s.r6('avg(probability)')} AS probability, CAST({s.r6('avg(probability)')} > 5e-1 AS INT) AS phishing FROM predictions GROUP BY id", "predictions"))
def ensemble_scores(spark, sf):
    p = round6(F.col("probability"))
    return V.ensemble(fx.predictions(spark, sf)).select("id", p.alias("probability"), flag(p > 0.5).alias("phishing"))


@query("threshold_sweep", s.sql(f"SELECT model, name, threshold::DOUBLE AS threshold, tn, fp, fn, tp, {_R} FROM (SELECT model, name, threshold, {_CELLS} FROM (SELECT p.*, t.*, probability > t.threshold AS hit FROM predictions p, (VALUES ('default', 5e-1), ('precision', 6.5e-1), ('recall', 3.5e-1)) AS t(name, threshold)) GROUP BY ALL)", "predictions"))
def threshold_sweep(spark, sf):
    return rounded(V.threshold_sweep(fx.predictions(spark, sf), "model"), skip=("threshold",))


@query("short_mail_evaluation", s.sql(f"SELECT model, slice, {_R} FROM (SELECT model, CASE WHEN w < 50 THEN 'short' ELSE 'long' END AS slice, {_CELLS} FROM (SELECT p.model, p.label, probability > 5e-1 AS hit, len({s.words('e.body')}) AS w FROM predictions p JOIN emails e ON e.id = p.id) GROUP BY ALL)", "predictions"))
def short_mail_evaluation(spark, sf):
    from lurelens.functions.text import words

    sizes = fx.emails(spark, sf).select("id", F.when(F.size(words(F.col("body"))) < 50, "short").otherwise("long").alias("slice"))
    cells = V.confusion(fx.predictions(spark, sf).join(sizes, "id"), "model", "slice")
    return rounded(cells.select("model", "slice", *[c.alias(n) for n, c in V.rates().items()]))
