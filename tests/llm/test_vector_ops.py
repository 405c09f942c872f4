"""Whitening, mixing and hard negatives against plain numpy and Python, with odd rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.llm import mixing, negatives, queries, whitening
from lurelens.llm.common import shared_folder

ODD = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 3), (903, [float("inf"), 0.0, 0.0])]


def spread(n, d, seed=1):
    dice = np.random.default_rng(seed)
    mixed = dice.normal(size=(d, d)) * np.linspace(0.05, 1.5, d)
    return [(i, [float(x) for x in dice.normal(size=d) @ mixed]) for i in range(n)]


def plain_whitening(vectors, k):
    """x, fit list, covariance, eigenvalues and components by numpy's symmetric solver."""
    width = max((len(v) for v in vectors), default=0)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors], np.int64).reshape(-1, width)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    v = centred.T @ centred / len(fit)
    values, columns = np.linalg.eigh(v)
    return x, fit, v, values[::-1][:k], columns[:, ::-1][:, :k]


def test_whitening_equals_a_plain_solver(spark):
    rows = spread(400, 20) + [(i, None) for i in (500, 501)] + ODD
    rows += [(600 + i, rows[3][1]) for i in range(150)] + [(None, rows[4][1]), (3, rows[3][1]), (700, [0.5] * 7), (701, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("x", F.lit(1)).repartition(5)
    got = whitening.whiten(df, shared_folder(spark), 16).collect()
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, fit, v, values, columns = plain_whitening([v for _, v in used], 16)
    n, sums = len(fit), fit.sum(axis=0)
    assert len(got) == 16 * len(used) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    seen = defaultdict(list)
    for r in got:
        seen[r.vec_id, r.deviation].append(r)
    signs = {}
    for (vec_id, _), row in zip(used, x):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        mine = sorted(seen[vec_id, deviation], key=lambda r: r.component)
        want = (row - sums / n) @ columns / np.sqrt(values)
        copies = len(mine) // 16
        assert [r.component for r in mine] == [c for c in range(1, 17) for _ in range(copies)]
        for r in mine:
            c = r.component - 1
            if abs(want[c]) > 1e-3:
                sign = math.copysign(1, r.whitened * want[c])
                assert signs.setdefault(c, sign) == sign
            assert abs(abs(r.whitened) - abs(want[c])) < 1e-6
            assert abs(r.explained / (values[c] / np.trace(v)) - 1) < 1e-9


def test_whitening_of_nothing_and_of_flat_data(spark):
    shape = "vec_id long, embedding array<double>"
    for rows in ([], ODD, [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, shape), shared_folder(spark)).count() == 0
    line = [(i, [i / 4, -i / 4, 1.0]) for i in range(50)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(line, shape), shared_folder(spark)).collect()
    assert len(got) == 50 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-9
    big = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], shape)
    assert {r.vec_id: r.deviation for r in whitening.whiten(big, shared_folder(spark)).collect()} == {1: None, 2: None, 3: 3**2 * 64**2}


def test_factor_and_rotations():
    a = np.random.default_rng(3).normal(size=(30, 12)) * np.logspace(0, -6, 12)
    v = a @ a.T
    factor, order = whitening.pivoted_cholesky(v)
    assert factor.shape[1] <= 13 and np.allclose(factor @ factor.T, v[order][:, order], atol=1e-13) and np.allclose(factor, np.tril(factor))
    values, columns = whitening.one_sided_jacobi(factor)
    assert np.allclose(columns.T @ columns, np.eye(len(values)), atol=1e-10) and np.allclose(values[:11], np.linalg.eigvalsh(v)[::-1][:11], rtol=1e-6, atol=1e-13)
    meetings = [frozenset(p) for pairs in whitening.pairings(7) for p in zip(*map(list, pairs))]
    assert len(meetings) == len(set(meetings)) == 21


# mixing


def plain_mix(rows, percent=150, most=2, weights=(3, 1, 2)):
    """Shares by turns of giving and sharing the excess again; documents by key."""
    sizes = [sum(1 for w in _split(text or "") if w) for _, text, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total = {s: sum(z for z, r in zip(sizes, rows) if r[2] == s) for s in sources}
    target, left, still = dict.fromkeys(sources, 0.0), percent * sum(sizes) / 100, set(sources)
    while still and left > 1e-9:
        share = {s: left * weight[s] / sum(weight[t] for t in still) for s in still}
        left = 0.0
        for s in list(still):
            target[s] += share[s]
            if target[s] > most * total[s]:
                left += target[s] - most * total[s]
                target[s] = float(most * total[s])
                still.discard(s)
    return sizes, total, target


def _split(text):
    word = ""
    for ch in text:
        if ch in " \t\n\x0b\x0c\r":
            yield word
            word = ""
        else:
            word += ch
    yield word


def mixed_rows():
    dice = random.Random(5)
    rows = [(i, " ".join(dice.choice(("foo", "bär", "x1", "--", "word")) for _ in range(dice.randrange(1, 60))), dice.choice(("a", "a", "a", "a", "b", "B", "é", None, ""))) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n ", None), (1003, "lone", "single"), (1004, None, "void"), (None, "no id here", "a"), (None, "no id there", "a")]
    return rows + [(7, "twice the same", "a")] * 3 + [(2000, "long " * 300_000, "b")]


def test_mix_equals_a_plain_form(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("key", F.lit(None).cast("int")).withColumn("name", F.lit(1))
    got = mixing.mix(df.repartition(6), shared_folder(spark)).collect()
    sizes, total, target = plain_mix(rows)
    assert sorted((r.doc_id or -1, r.size, r.source_size) for r in got) == sorted((i or -1, z, total[s]) for (i, _, s), z in zip(rows, sizes))
    by_size = {t: s for s, t in total.items()}
    assert len(by_size) == len(total)
    groups = defaultdict(list)
    for r in got:
        source = by_size[r.source_size]
        assert math.isclose(r.target, target[source], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.epochs * r.size <= r.taken
        groups[source].append(r)
    for source, members in groups.items():
        taken = sum(r.taken for r in members)
        assert abs(taken - target[source]) <= 1
        extra = [r.taken - r.epochs * r.size for r in sorted(members, key=lambda r: r.key)]
        whole = [e == r.size for e, r in zip(extra, sorted(members, key=lambda r: r.key)) if r.size]
        assert whole == sorted(whole, reverse=True)  # whole documents first, in key order, one in part at most
        assert sum(0 < e < r.size for e, r in zip(extra, sorted(members, key=lambda r: r.key))) <= 1
    again = mixing.mix(df.repartition(3, "text"), shared_folder(spark)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_prefers_heavier_documents_and_keeps_to_the_method(spark):
    rows = [(i, "word " * 10, "a") for i in range(3000)] + [(i, "w", "b") for i in range(3000, 3100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shared_folder(spark), weights=(1,), percent=50, most=2, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).filter("doc_id < 3000").collect()
    heavy, light = (sum(r.taken for r in got if r.doc_id % 2 == odd) for odd in (0, 1))
    share = sum(r.taken for r in got) / 30000
    # with keys -ln(u)/w, shares p and 1-(1-p)^4 of light and heavy documents lie below one cut
    light_share = next(p / 1000 for p in range(1001) if (p / 1000 + 1 - (1 - p / 1000) ** 4) / 2 >= share)
    assert abs(light / 15000 - light_share) < 0.04 and heavy > 2 * light
    assert mixing.mix(df.filter("false"), shared_folder(spark)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(df.limit(1).withColumn("text", F.lit(None).cast("string")), shared_folder(spark)).collect()] == [(0.0, 0)]


# hard negatives


def plain_negatives(rows, moved, every):
    used = [(i, moved(i, lab), [math.floor(256 * c) for c in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, vector in {(i, lab, tuple(v)) for i, lab, v in used if i % every == 0}:
        others = [(score(vector, v), i, lab) for i, lab, v in used if i != a]
        positives = sorted((-s, i) for s, i, lab in others if lab == label)[:5]
        for p, i in ((-s, i) for s, i in positives):
            fits = sorted((-s, j) for s, j, lab in others if lab != label and 80 * p <= 100 * s <= 100 * p)[:5]
            out += [(a, i, rank, j, p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [6, 70])
def test_hard_negatives_equal_brute_force(spark, width):
    dice = random.Random(width)
    centres = [[dice.gauss(0, 0.3) for _ in range(width)] for _ in range(4)]
    rows = [(i, [c + dice.gauss(0, 0.15) for c in dice.choice(centres)], dice.choice((0, 0, 0, 1, 2, 9))) for i in range(400)]
    rows += [(i, v, 1) for i, v in ODD] + [(904, rows[1][1], None), (None, rows[1][1], 1), (910, [0.0] * width, 0), (920, [], 0), (930, [1.0], 2)]
    rows += [(1000 + i, rows[10][1], dice.choice((0, 1))) for i in range(60)] + [(30, rows[30][1], rows[30][2]), (40, rows[41][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("vector", F.lit("x")).withColumn("code", F.lit(1)).withColumn("cb", F.lit(1)).repartition(4)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, shared_folder(spark), label=moved, anchor_rows=16, block_rows=100).collect()
    want = plain_negatives(rows, lambda i, lab: (lab + 1) % 10 if i % 7 == 0 else lab, 10)
    assert want and sorted(tuple(r)[:6] for r in got) == want
    for nothing in (df.filter("false"), df.filter("vec_id % 10 <> 0"), df.filter("label = 1").withColumn("label", F.lit(None).cast("int"))):
        assert negatives.hard_negatives(nothing, F.col("vec_id") % 10 == 0, shared_folder(spark)).count() == 0


def test_intervals_are_certain_and_narrow():
    dice = np.random.default_rng(2)
    for width in (64, 128):
        turn = negatives.rotation(width)
        assert np.allclose(turn @ turn.T, np.eye(width))
        vectors = np.floor(256 * dice.normal(size=(500, width)) / 8).astype(np.int64)
        vectors[:3] = [[0], [1 << 23], [-(1 << 23)]]
        widths = []
        for levels in (1, 2, 3):
            words, along, rest = negatives.code(vectors, turn, levels)
            for q in (vectors[5], vectors[0], vectors[1]):
                low, high = negatives.Anchor(q, turn).intervals(words, along, rest)
                true = (vectors @ q).astype(float)
                assert (low <= true).all() and (true <= high).all()
            low, high = negatives.Anchor(vectors[5], turn).intervals(words, along, rest)
            widths.append(float((high - low)[3:].mean()))
        assert widths[0] > 1.5 * widths[1] > 2 * widths[2]


def test_few_rows_are_scored(spark, sf):
    """On clustered vectors the intervals leave most of a block unscored."""
    pairs = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    vectors = np.floor(256 * np.stack(pairs.embedding).astype(float)).astype(np.int64)
    turn = negatives.rotation(64)
    words, along, rest = negatives.code(vectors, turn, 3)
    rows = pairs.assign(vector=list(vectors), code=list(words.reshape(len(words), -1).view(np.int64)), along=list(along), rest=rest)
    block = negatives.Block(rows, 64, 3)
    list(negatives.best_positives(block, 0, int(pairs.label[0]), vectors[0], negatives.Anchor(vectors[0], turn), 5))
    assert block.scored < (pairs.label == pairs.label[0]).sum() + 5


def test_queries_match_their_contract(spark, sf):
    white, mix, hard = (queries.QUERIES[q](spark, sf) for q in ("op11_whitening", "op12_mixing", "op13_negatives"))
    assert white.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(mix.dtypes) | {"target": "double", "taken": "bigint", "size": "bigint", "source_size": "bigint"} == dict(mix.dtypes)
    assert hard.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    first = white.first()
    assert first.identity_error < 1e-4 and white.count() == 16 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
