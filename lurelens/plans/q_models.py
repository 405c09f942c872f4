"""Vector and model queries. Fitted models have no SQL twin; their exact parts do."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens import rules
from lurelens.functions.text import flag, round6
from lurelens.operators import cleaning as C
from lurelens.operators import evaluation as V
from lurelens.operators import features as E
from lurelens.operators import models as M
from lurelens.operators import splits as S
from lurelens.operators import validation as X
from lurelens.operators import vectorize as T
from lurelens.operators import vectorstore as K
from lurelens.plans import fixtures as fx
from lurelens.plans import sqlparts as s
from lurelens.plans.q_features import rounded
from lurelens.plans.registry import query
from lurelens.session import saved, work_folder

_WORDS = f"list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT list_contains({s.arr(rules.STOPWORDS)}, w))"
TFIDF = {
    "wd": f"SELECT id, label, {_WORDS} AS w FROM emails",
    "tr": "SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd",
    "cn": "SELECT id, term, count(*) AS tf FROM tr GROUP BY id, term",
    "vo": "SELECT term, count(*) AS df, sum(tf) AS total FROM cn GROUP BY term HAVING count(*) >= 2 AND count(*) <= 9.5e-1 * (SELECT count(*) FROM emails) ORDER BY total DESC, term LIMIT 5000",
    "rw": "SELECT cn.id, cn.term, (1 + ln(tf::DOUBLE)) * (ln(((SELECT count(*) FROM emails) + 1)::DOUBLE / (df + 1)) + 1) AS raw FROM cn JOIN vo ON vo.term = cn.term",
    "wt": "SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM rw",
}


def _weights(spark, sf):
    return T.tfidf(fx.emails(spark, sf), "body", rules.STOPWORDS)


@query("tfidf_vocabulary", s.sql("SELECT term, df, CAST(total AS BIGINT) AS tf FROM vo", "emails", **TFIDF))
def tfidf_vocabulary(spark, sf):
    mails = fx.emails(spark, sf)
    docs = T.word_arrays(mails, F.col("body"), rules.STOPWORDS)
    return T.vocabulary(docs, T.row_count(mails)).select("term", "df", "tf")


@query("tfidf_weights", s.sql(f"SELECT id, term, {s.r6('weight')} AS weight FROM wt", "emails", **TFIDF))
def tfidf_weights(spark, sf):
    return rounded(_weights(spark, sf))


_CO = {**TFIDF, "co": "SELECT wt.term, sum(CASE WHEN e.label = 1 THEN weight ELSE 0e0 END) / (SELECT count(*) FROM emails WHERE label = 1) - sum(CASE WHEN e.label = 0 THEN weight ELSE 0e0 END) / (SELECT count(*) FROM emails WHERE label = 0) AS coefficient FROM wt JOIN emails e ON e.id = wt.id GROUP BY wt.term"}


@query("term_contributions", s.sql("SELECT id, CAST(rank AS INT) AS rank, term, floor(contribution * 1e6 + 5e-1) / 1e6 AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, term) AS rank FROM (SELECT wt.id, wt.term, round(weight * coefficient, 9) AS contribution FROM wt JOIN co ON co.term = wt.term)) WHERE rank <= 5", "emails", **_CO))
def term_contributions(spark, sf):
    weighted = saved(_weights(spark, sf), work_folder(spark), "weights")
    labels = fx.emails(spark, sf, text=False).select("id", "label")
    return rounded(T.term_contributions(weighted, T.class_contrast(weighted, labels)))


@query("scaled_features", s.sql(f"SELECT event_id, {s.r6('(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)')} AS value_std, {s.r6('(value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events)')} AS value_unit FROM events"))
def scaled_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    e = fx.table(spark, sf, "events").select("event_id", "value")
    std = M.scaled(e, ["value"]).withColumn("value_std", vector_to_array("features")[0]).drop("features")
    unit = M.scaled(std, ["value"], "minmax").withColumn("value_unit", vector_to_array("features")[0])
    return rounded(unit.select("event_id", "value_std", "value_unit"))


@query("mail_embeddings", s.sql(f"SELECT d.doc_id AS id, CAST(v.vec_id IS NOT NULL AS INT) AS found, {s.r6('coalesce(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE)), 0e0)')} AS total, CAST(coalesce(len(v.embedding), 64) AS INT) AS dims FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id"))
def mail_embeddings(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit(1).alias("found"))
    rows = M.with_embeddings(fx.emails(spark, sf, text=False).select("id"), vectors, 64).join(vectors.select("id", "found"), "id", "left")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("id", F.coalesce("found", F.lit(0)).alias("found"), round6(total).alias("total"), F.size("embedding").alias("dims"))


def _training(spark, sf):
    mails = fx.emails(spark, sf, urls=True).withColumn("url_text", F.array_join("urls", ","))
    rows = mails.select("id", "label", F.lower(C.training_text("simple")).alias("text"))
    split = S.stratified_split(fx.emails(spark, sf, text=False).select("id", "label"), ratios=(("train", 0.8), ("test", 1.0)))
    return rows.join(split.select("id", "split"), "id")


def _fit_and_score(spark, sf, classifier):
    rows = _training(spark, sf)
    train = rows.filter("split = 'train'").drop("split")
    model = M.fit_text_model(train, classifier(train), max_df=0.9)
    return M.scored(model, rows.filter("split = 'test'")).select("id", "label", round6(F.col("probability")).alias("probability"))


@query("model_scores__logistic")
def model_scores_logistic(spark, sf):
    return _fit_and_score(spark, sf, lambda train: M.logistic(total_weight=float(train.count())))


@query("model_scores__forest")
def model_scores_forest(spark, sf):
    return _fit_and_score(spark, sf, lambda train: M.forest())


@query("model_scores__hybrid")
def model_scores_hybrid(spark, sf):
    mails = fx.emails(spark, sf, urls=True, text=False)
    rows = mails.select("id", "label", *[c.alias(n) for n, c in E.hybrid_features().items()])
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = M.with_embeddings(rows, vectors, 64)
    split = S.stratified_split(mails.select("id", "label")).select("id", "split")
    rows = rows.join(split, "id").withColumn("is_validation", F.col("split") == "validation")
    model = M.fit_hybrid(rows.filter("split <> 'test'"), E.HYBRID_NAMES)
    from pyspark.ml.functions import array_to_vector

    test = rows.filter("split = 'test'").withColumn("embedding_vector", array_to_vector("embedding"))
    return M.scored(model, test).select("id", "label", round6(F.col("probability")).alias("probability"))


def _folded(spark, sf):
    rows = _training(spark, sf).drop("split")
    folds = S.stratified_folds(fx.emails(spark, sf, text=False).select("id", "label")).select("id", "fold")
    return rows.join(folds, "id")


def _contract(spark, sf, candidates):
    """Counts per candidate and fold from the written scores, errors of the protocol, and the mean F1 beside its recount."""
    rows = _folded(spark, sf)
    scores = X.fold_scores(rows, candidates, work_folder(spark), max_df=0.9)
    grid = X.grid_table(scores)
    wrong = X.wrongly_scored(scores, rows).groupBy("candidate").agg(F.count("*").alias("wrongly_scored"))
    ranked = X.ranked_candidates(grid)
    best = ranked.agg(F.max("f1")).scalar()
    out = grid.join(wrong, "candidate", "left").join(ranked.withColumnRenamed("f1", "mean_f1"), "candidate")
    hits, calls = F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return out.select(
        "candidate", "fold", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"), (F.col("tp") + F.col("fn")).alias("positives"),
        F.coalesce("wrongly_scored", F.lit(0)).cast("bigint").alias("wrongly_scored"), flag(F.abs(F.col("f1") - F.coalesce(2 * hits / F.nullif(calls, F.lit(0)), F.lit(0.0))) < 1e-12).alias("f1_holds"),
        flag((F.col("rank") > 1) | (F.col("mean_f1") == best)).alias("winner_is_best"), (F.lit(len(candidates))).cast("bigint").alias("candidates"),
    )


def _contract_sql(names):
    rows = ", ".join(f"({s.lit(n)})" for n in names)
    return s.sql(
        f"SELECT c.candidate, fo.fold, fo.rows, fo.positives, CAST(0 AS BIGINT) AS wrongly_scored, 1 AS f1_holds, 1 AS winner_is_best, CAST({len(names)} AS BIGINT) AS candidates FROM fo, (VALUES {rows}) AS c(candidate)",
        "emails", r=_RANKS, fo="SELECT CAST((r.rn - 1) % 5 AS INT) AS fold, count(*) AS rows, count(CASE WHEN label = 1 THEN 1 END) AS positives FROM r GROUP BY 1")


_RANKS = "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rn FROM emails"


@query("cross_validation__logistic", _contract_sql(["C 1"]))
def cross_validation_logistic(spark, sf):
    """Five folds, a model fitted on four of them each time."""
    return _contract(spark, sf, X.logistic_grid([1.0]))


@query("grid_search__logistic", _contract_sql([f"C {c:g}" for c in M.LOGISTIC_GRID]))
def grid_search_logistic(spark, sf):
    """The declared grid over five folds; the candidate of rank 1 has the best mean F1 of the written scores."""
    return _contract(spark, sf, X.logistic_grid())


@query("model_term_importance")
def model_term_importance(spark, sf):
    train = _training(spark, sf).filter("split = 'train'").drop("split")
    model = M.fit_text_model(train, M.logistic(total_weight=float(train.count())), max_df=0.9)
    return M.importance(model, spark)


@query("stacking_table", s.sql("SELECT id, max(label) AS label, max(CASE WHEN model = 'alpha' THEN probability END) AS alpha, max(CASE WHEN model = 'beta' THEN probability END) AS beta, max(CASE WHEN model = 'gamma' THEN probability END) AS gamma FROM predictions GROUP BY id", "predictions"))
def stacking_table(spark, sf):
    return M.stacking_table(fx.predictions(spark, sf), ["alpha", "beta", "gamma"])


@query("stacked_scores")
def stacked_scores(spark, sf):
    names = ["alpha", "beta", "gamma"]
    table = M.stacking_table(fx.predictions(spark, sf), names)
    return M.out_of_fold_stacking(S.stratified_folds(table), names).select("id", round6(F.col("probability")).alias("probability"))


@query("batch_verdicts")
def batch_verdicts(spark, sf):
    rows = _training(spark, sf)
    train = rows.filter("split = 'train'").drop("split")
    model = M.fit_text_model(train, M.logistic(total_weight=float(train.count())), max_df=0.9)
    return M.batch_verdicts(model, rows.drop("split"))


_DISTINCT = "SELECT count(DISTINCT subject) AS s, (SELECT count(*) FROM (SELECT subject FROM emails UNION SELECT body FROM emails)) AS b, count(*) AS n FROM emails"


@query("encoder_cache_runs", s.sql("SELECT run, CAST(texts AS BIGINT) AS texts, CAST(encoded AS BIGINT) AS encoded, CAST(vectors AS BIGINT) AS vectors FROM (SELECT 1 AS run, n AS texts, s AS encoded, s AS vectors FROM di UNION ALL SELECT 2, 2 * n, b - s, b FROM di UNION ALL SELECT 3, 2 * n, 0, b FROM di)", "emails", di=_DISTINCT))
def encoder_cache_runs(spark, sf):
    """Three runs over one store: subjects, subjects with bodies, and the same again."""
    mails = fx.emails(spark, sf)
    store = K.VectorStore(spark, work_folder(spark), "hashed-words-32", K.hashed_words)
    subjects = mails.select("id", F.col("subject").alias("text"))
    everything = subjects.unionByName(mails.select("id", F.col("body").alias("text")))
    out = None
    for run, texts in enumerate((subjects, everything, everything), 1):
        counts = texts.agg(F.lit(run).alias("run"), F.count("*").alias("texts"), F.lit(store.add(texts, "text")).cast("bigint").alias("encoded"))
        stored = saved(counts.withColumn("vectors", store.vectors().agg(F.count("*").alias("n")).scalar()), work_folder(spark), "counts")
        out = stored if out is None else out.unionByName(stored)
    return out
