"""Shape, determinism and persistence of the fitted parts."""

import pytest
from pyspark.sql import functions as F

from lurelens.operators import evaluation as V
from lurelens.operators import models as M
from lurelens.operators import splits as S
from lurelens.operators import validation as X
from lurelens.operators import vectorize as T
from lurelens.operators import vectorstore as K

TEXTS = [
    "verify your account password now", "urgent verify account click here", "confirm password and login now", "click to verify your login",
    "meeting tomorrow at noon with team", "project status update for the team", "lunch on friday with the team", "team meeting notes and project plan",
]


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, TEXTS[i % 8] + f" item{i % 3}", int(i % 8 < 4)) for i in range(48)]
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_text_model_separates_and_repeats(spark, train, tmp_path):
    def fit():
        return M.fit_text_model(train, M.logistic(total_weight=48.0, iterations=50), stopwords=[])

    first = {r.id: r.probability for r in M.scored(fit(), train).collect()}
    model = fit()
    second = {r.id: r.probability for r in M.scored(model, train).collect()}
    assert first.keys() == second.keys() and all(abs(first[i] - second[i]) < 1e-9 for i in first)
    labels = {r.id: r.label for r in train.collect()}
    assert all((p > 0.5) == bool(labels[i]) for i, p in first.items())
    M.save(model, str(tmp_path / "m"))
    again = {r.id: r.probability for r in M.scored(M.load(str(tmp_path / "m")), train).collect()}
    assert all(abs(again[i] - second[i]) < 1e-9 for i in second)
    top = M.importance(model, spark, 5).collect()
    assert len(top) == 5 and abs(top[0].importance) >= abs(top[-1].importance)
    assert set(M.batch_verdicts(model, train).columns) == {"id", "verdict", "confidence", "risk_level"}


def test_forest_scores_are_probabilities(train):
    forest = M.fit_text_model(train, M.forest(trees=5, depth=4), stopwords=[])
    assert M.scored(forest, train).filter("probability < 0 OR probability > 1").count() == 0


def test_folds_are_fitted_without_their_own_rows(spark, train, tmp_path):
    """A word that only one fold holds is no term of the models that score that fold."""
    rows = S.stratified_folds(train, 3).withColumn("text", F.concat("text", F.lit(" only"), F.translate(F.col("fold").cast("string"), "012", "abc")))
    fitted = {}

    def spy(total):
        real = M.logistic(1.0, total, 50)
        fit = real.fit

        def noted(table):
            fitted[id(real)] = table.count()
            return fit(table)

        real.fit = noted
        return real

    scores = X.fold_scores(rows, {"C 1": spy, "small": lambda total: M.logistic(0.001, total, 50)}, str(tmp_path), stopwords=[])
    assert scores.count() == 2 * 48 and X.wrongly_scored(scores, rows).count() == 0
    assert sorted(fitted.values()) == [48 - n for n in sorted((r["count"] for r in rows.groupBy("fold").count().collect()), reverse=True)]
    grid = X.grid_table(scores)
    plain = {}
    for r in scores.collect():
        cell = plain.setdefault((r.candidate, r.fold), [0, 0, 0, 0])
        cell[2 * r.label + (r.probability > 0.5)] += 1
    assert {(r.candidate, r.fold): [r.tn, r.fp, r.fn, r.tp] for r in grid.collect()} == plain
    ranked = {r["rank"]: r for r in X.ranked_candidates(grid).collect()}
    assert sorted(ranked) == [1, 2] and ranked[1].f1 >= ranked[2].f1
    moved = scores.withColumn("fold", F.when(F.col("id") == 3, (F.col("fold") + 1) % 3).otherwise(F.col("fold")))
    assert X.wrongly_scored(moved, rows).count() == 2 and X.wrongly_scored(scores.unionByName(scores.filter("id = 4")), rows).count() == 2
    assert X.summary(scores).count() == 2


def test_forest_grid_runs(spark, train, tmp_path):
    rows = S.stratified_folds(train, 2)
    grid = X.forest_grid(trees=(3, 5), depths=(2,), leaves=(1, 2))
    ranked = X.ranked_candidates(X.grid_table(X.fold_scores(rows, grid, str(tmp_path), stopwords=[]))).collect()
    assert len(X.forest_grid()) == 27 and sorted(r["rank"] for r in ranked) == [1, 2, 3, 4]
    best = next(r.candidate for r in ranked if r["rank"] == 1)
    assert M.scored(X.refitted(rows, grid, best, stopwords=[]), train).count() == 48


def test_splits_are_disjoint_and_stratified(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    out = S.stratified_split(df)
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 525, (0, "validation"): 112, (0, "test"): 113, (1, "train"): 175, (1, "validation"): 37, (1, "test"): 38}
    kept = {r.label: r["count"] for r in S.sample_to_ratio(df).groupBy("label").count().collect()}
    assert kept == {0: 464, 1: 250}


def test_senders_stay_whole_and_strata_keep_their_shares(spark):
    """A sender with a third of all rows, senders of one row, missing ones, and case."""
    sender = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "Hot@x.y").otherwise("hot@X.y")).when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 700))
    df = spark.range(6000).select("id", sender.alias("sender"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("int").alias("label"), F.when(F.col("id") % 7 < 2, "web").otherwise("mail").alias("source"))
    out = S.sender_stratified_split(df, "sender")
    assert S.leaked_groups(out.withColumn("low", F.lower("sender")), "low").filter("low IS NOT NULL").count() == 0
    for r in out.groupBy("label", "source").agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == p).alias(p) for p in ("train", "validation", "test")]).collect():
        assert all(abs(r[p] / r.n - share) <= 0.02 for p, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))
    again = S.sender_stratified_split(df.repartition(7), "sender")
    assert out.exceptAll(again).count() == 0
    assert S.sender_stratified_split(df.filter("false"), "sender").count() == 0


def test_auc_matches_pairs(spark):
    rows = [(i, "m", (i * 7) % 3 % 2, ((i * 13) % 10) / 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, model string, label int, probability double")
    pos = [p for _, _, y, p in rows if y]
    neg = [p for _, _, y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(V.metrics(df, "model").first().roc_auc - want) < 1e-12
    assert abs(V.curve_areas(df, "model").first().roc_auc - want) < 1e-12


def test_tfidf_rows_have_unit_norm(train):
    w = T.tfidf(train, "text", [], max_df=0.9)
    for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect():
        assert abs(r.n - 1) < 1e-9


def test_encoder_sees_each_text_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    out = {r.id: r.embedding for r in M.encode_texts(df, "text", lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert out == {1: [1.0], 2: [2.0], 3: [1.0], 4: [0.0]}


def test_vectors_are_kept_between_runs(spark, tmp_path):
    """Only unseen texts reach the encoder; a new session of the store and a doubled part change nothing."""
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id int, text string").withColumn("embedding_of", F.lit("x"))
    lengths = lambda texts: [[float(len(t))] for t in texts]
    first = K.VectorStore(spark, str(tmp_path), "lengths", lengths)
    assert (first.add(df, "text"), first.add(df, "text")) == (3, 0)
    fails = lambda texts: 1 / 0 if texts else []
    again = K.VectorStore(spark, str(tmp_path), "lengths", fails)
    assert {r.id: r.embedding for r in again.encode(df, "text").collect()} == {1: [1.0], 2: [2.0], 3: [1.0], 4: [0.0], 5: [0.0]}
    more = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(6, "cccc")], "id int, text string").withColumn("embedding_of", F.lit("y")))
    assert first.add(more, "text") == 1 and first.add(df.limit(0), "text") == 0
    spark.read.parquet(f"{tmp_path}/lengths").limit(2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lengths")
    out = first.encode(more, "text")
    assert out.count() == 6 and out.columns == [*df.columns, "embedding"]
    norms = [sum(float(x) ** 2 for x in v) for v in K.hashed_words(["a b c", "", "naïve 漢字"])]
    assert [round(n, 5) for n in norms] == [1, 0, 1]


def test_encoder_spreads_a_hot_text(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = M.encode_texts(df, "text", lambda texts: [[float(len(t))] for t in texts])
    assert out.filter(F.col("embedding")[0] == F.length("text")).count() == 4000


def test_hybrid_and_scalers(spark):
    rows = [(i, [float(i % 2), 1.0], float(i), i % 2, i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, n double, label int, is_validation boolean")
    model = M.fit_hybrid(df, ["n"], trees=3, depth=2)
    from pyspark.ml.functions import array_to_vector

    out = M.scored(model, df.withColumn("embedding_vector", array_to_vector("embedding")))
    assert out.filter("probability BETWEEN 0 AND 1").count() == 40
    assert M.scaled(df, ["n"], "minmax").count() == 40


def test_queries_use_the_declared_settings(spark, sf, monkeypatch):
    from lurelens.plans import q_models

    seen = []
    own = q_models.M.fit_text_model, q_models.M.hybrid_stages

    class Seen(Exception):
        pass

    def stop(*args, **kwargs):
        seen.append((args, kwargs))
        raise Seen

    monkeypatch.setattr(q_models.M, "fit_text_model", stop)
    monkeypatch.setattr(q_models.M, "hybrid_stages", stop)
    for query in (q_models.model_scores_forest, q_models.model_scores_hybrid):
        with pytest.raises(Seen):
            query(spark, sf)
    forest = seen[0][0][1]
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 20)
    gbt = own[1](*seen[1][0], **seen[1][1])[-1]
    assert (gbt.getMaxIter(), gbt.getMaxDepth()) == (200, 8)


def test_stacking_scores_no_row_it_was_fitted_on(spark):
    rows = [(i, int(i % 3 == 0), (i * 7 % 10) / 10, (i * 3 % 10) / 10, i % 4) for i in range(40)]

    def score(flipped):
        table = spark.createDataFrame([(i, 1 - y if i == flipped else y, a, b, f) for i, y, a, b, f in rows], "id long, label int, a double, b double, fold int")
        return {r.id: r.probability for r in M.out_of_fold_stacking(table, ["a", "b"]).collect()}

    plain, other = score(None), score(8)
    assert len(plain) == 40 and plain[8] == pytest.approx(other[8], abs=1e-9) and plain[9] != pytest.approx(other[9], abs=1e-9)


def test_vocabulary_of_a_fit_equals_the_vectorizers_own(spark, train):
    """Counted in Spark instead of by the vectorizer's fit, which keeps every row's terms as objects; ties go by term."""
    from pyspark.ml import Pipeline

    steps = M.text_stages(features=30, max_df=0.9)
    own = Pipeline(stages=steps[:5]).fit(train).transform(train)
    words = M.words_of(train, "text", steps)
    vectorizer = M.fitted_vocabulary(steps[4], T.term_counts(words.select(F.col("kept").alias("words"))), train)
    counts = {r.term: (r.tf, r.df) for r in T.term_counts(words.select(F.col("kept").alias("words"))).collect()}
    terms = [t for r in own.select("terms").collect() for t in r.terms]
    assert {t: n for t, (n, _) in counts.items()} == {t: terms.count(t) for t in set(terms)}
    order = sorted((t for t, (_, n) in counts.items() if 2 <= n <= 0.9 * 48), key=lambda t: (-counts[t][0], t))[:30]
    assert vectorizer.vocabulary == order
    with pytest.raises(ValueError):
        M.fit_text_model(spark.createDataFrame([(1, "one thing", 1), (2, "another matter", 0)], "id long, text string, label int"), M.logistic(), stopwords=[])


def test_folds_count_terms_once_and_fit_as_alone(spark, train, tmp_path):
    """One table of counts serves all folds, nothing is cached, and scores are those of a fit on the other folds by themselves."""
    rows = S.stratified_folds(train, 3).withColumn("text", F.concat("text", F.lit(" only"), F.translate(F.col("fold").cast("string"), "012", "abc")))
    cached = []

    def candidate(total):
        real = M.logistic(1.0, total, 50)
        fit = real.fit

        def noted(table):
            cached.append(table.storageLevel.useMemory or table.storageLevel.useDisk)
            return fit(table)

        real.fit = noted
        return real

    scores = X.fold_scores(rows, {"C 1": candidate}, str(tmp_path), stopwords=[])
    assert cached == [False] * 3
    terms = spark.read.parquet(str(tmp_path / "terms"))
    words = M.words_of(rows, "text", M.text_stages(stopwords=[]))
    for i in range(3):
        want = {r.term: (r.tf, r.df) for r in T.term_counts(words.filter(F.col("fold") != i).select(F.col("kept").alias("words"))).collect() if r.df >= 2}
        got = {r.term: (r.tf, r.df) for r in terms.select("term", *[(F.col(n) - F.col(f"{n}_{i}")).alias(n) for n in ("tf", "df")]).collect() if r.df >= 2}
        assert got == want
        others = rows.filter(F.col("fold") != i)
        model = M.fit_text_model(others, M.logistic(1.0, float(others.count()), 50), stopwords=[])
        alone = {r.id: r.probability for r in M.scored(model, rows.filter(F.col("fold") == i)).collect()}
        here = {r.id: r.probability for r in scores.filter(F.col("fold") == i).collect()}
        assert here.keys() == alone.keys() and all(abs(here[k] - alone[k]) < 1e-4 for k in alone)
