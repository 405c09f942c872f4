"""Search, near-duplicates, language model, toxicity and the pipeline against brute force and held-out accuracy."""

import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lurelens.llm import lm, minhash, queries, topk, toxicity
from lurelens.llm.common import lower_words, shared_folder


def test_top_k_equals_brute_force(spark):
    dice = random.Random(1)
    rows = [(i, [dice.choice((-0.5, 0.25, 0.0, 0.1, dice.random())) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf")]), (500, []), (550, [1.0]), (None, [1.0]), (7, [0.5] * 6), (7, [0.5] * 6), (50, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, 5, block_rows=64, query_rows=4).collect()
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in vectors if i % 50 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q))[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.filter("false"), df, 5).count() == 0 and topk.top_k(df, df.filter("vec_id = 0"), 5).filter("query_id = 0").count() == 0
    long = topk.search_block(pd.DataFrame({"vec_id": [1], "query_row": [0], "vector": [[1 << 40]]}), pd.DataFrame({"vec_id": [2, 3], "vector": [[5], [-5]]}), 1)
    assert long.score.tolist() == [5 << 40]


def brute_components(rows, k):
    sets = []
    for _, text in rows:
        words = lower_words(text or "")
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        lowest[find(i)] = min(doc_id, lowest.get(find(i), doc_id))
    return sorted((doc_id, len(sets[i]), lowest[find(i)], doc_id == lowest[find(i)]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("shared_words", [0, 60])
def test_near_duplicates_equal_brute_force(spark, shared_words):
    """With chains of near copies, and with a passage that all texts share."""
    dice = random.Random(4)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(shared_words)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(dice.randint(30, 90))]
        for _ in range(dice.randint(1, 9)):
            rows.append((1000 - len(rows), " ".join(base + passage)))
            base[dice.randrange(len(base))] = word()
            base[0:dice.choice((0, 0, 1))] = []
    rows += [(2000, None), (2001, ""), (2002, "one Two"), (2003, "ONE  two\n"), (2004, " "), (2005, "é" * 2000), (2006, "a b c d"), (2007, "A b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == brute_components(rows, 4)
    kept = {r[0] for r in brute_components(rows, 5) if r[3]}
    assert {r.doc_id for r in minhash.keep_one(df).collect()} == kept and minhash.keep_one(df).columns == df.columns
    assert minhash.near_duplicates(df.filter("false")).count() == 0
    assert tuple(minhash.near_duplicates(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).first())[2:] == (None, True)


def test_keep_one_tells_rows_apart(spark):
    """Repeated rows shrink to one, another text under the same id stays, missing ids and texts stay, columns may clash."""
    text = " ".join(f"w{i}" for i in range(40))
    near, other = text.replace("w39", "x"), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (2, other), (3, near), (4, other + " more"), (None, text), (None, text), (5, None), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("__gone", "__id", "__tie", "id", "tie", "root")}).repartition(3)
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, text), (2, other), (None, text), (None, text), (5, None), (5, None), (5, "")], key=repr)
    assert minhash.keep_one(df.filter("false")).count() == 0


def test_marks_lose_no_row(spark):
    rows = spark.range(-500, 40_000).withColumn("text", F.lit("t"))
    wanted = rows.filter("id % 7 = 0 OR id < 0").select("id")
    left = minhash.marked(rows, wanted)
    assert left.columns == rows.columns and wanted.join(left, "id", "left_anti").count() == 0 and left.count() < wanted.count() + 100
    assert minhash.marked(rows, wanted.filter("false")).count() == 0


def test_shared_folder_without_a_setting(spark, monkeypatch):
    """Without the setting a local session gets a folder of its own; the session's settings stay as they are."""
    class Bare:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    assert "/llm-" in shared_folder(Bare()) and not hasattr(Bare.conf, "set")


def test_estimate_is_corrected_for_chance(spark):
    dice = random.Random(6)
    a = np.array(sorted({dice.getrandbits(64) for _ in range(1000)}), dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        both = int(1000 * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:both], np.array([dice.getrandbits(64) for _ in range(1000 - both)], dtype=np.uint64)]))
        packed = minhash.bands_and_bits(np.array([minhash.minima(a), minhash.minima(b)]))[1].view(np.int64)
        names = [f"{x}{i}" for x in "ab" for i in range(minhash.WORDS)]
        row = spark.createDataFrame([tuple(map(int, packed.ravel()))], ", ".join(f"{n} long" for n in names))
        equal = minhash.equal_cells([F.col(f"a{i}") for i in range(minhash.WORDS)], [F.col(f"b{i}") for i in range(minhash.WORDS)])
        assert abs(row.select(minhash.estimated(equal)).first()[0] - share) < 0.2


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9001, ""), (9002, "zzqq " * 900)], "doc_id long, text string")).withColumn("h", F.lit(0))
    path, pattern = queries.tokenizer("byte_bpe_50k.tiktoken")
    got = lm.score_documents(docs, path, pattern, shared_folder(spark)).collect()
    texts = [(r.doc_id, lower_words(r.text or "") + [b"\n"]) for r in docs.collect()]
    counts = Counter(w for d, ws in texts if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((d, zlib.crc32(str(d).encode()) % 7 == 2, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in texts)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    model, kept = lm.train(docs, path, pattern)
    subwords, total = lm.Subwords(path, pattern), n + v + 1
    vocabulary = spark.createDataFrame([(lm._hash(w), c) for w, c in counts.items()], "h long, c long")
    by_model, by_counts, by_before = lm.mix_weights(model, subwords, kept, vocabulary, total)
    assert by_model + by_counts + by_before == pytest.approx(1)

    def mixed(words):
        ids = [[subwords.end] if w == lm.END_WORD else subwords.of(w) for w in words]
        by_id = iter(model.log_probabilities(np.array([i for own in ids for i in own]), np.array([sum(map(len, ids))])))
        chances = [sum(next(by_id) for _ in own) for own in ids]
        out, before = 0.0, Counter()
        for i, (w, p) in enumerate(zip(words, chances)):
            rest = by_before * before[w] / max(1, i) + (by_counts * (counts[w] + 1) / total if w in counts else 0)
            out += math.log10(by_model * 10 ** p + rest) if rest or p > -300 else p + math.log10(by_model)
            before[w] += 1
        return out

    for (a, b), (c, d) in zip(sorted((r.doc_id, r.score) for r in got), sorted((d, mixed(ws)) for d, ws in texts)):
        assert a == c and b == pytest.approx(d, abs=0.02, rel=1e-4)


def test_language_model_learns_what_follows_what(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfgklmnprst", k=4)) for _ in range(80)]
    after = {w: rng.sample(words, 3) for w in words}
    rows = []
    for d in range(400):
        own = [rng.choice(words)]
        while len(own) < 60:
            own.append(rng.choice(after[own[-1]]))
        rows.append((d, " ".join(own)))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), *queries.tokenizer("byte_bpe_50k.tiktoken"), shared_folder(spark)).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)  # both are below 0


def test_language_model_gathers_from_all_training_documents(spark):
    path, pattern = queries.tokenizer("byte_bpe_50k.tiktoken")
    rows = [(i, "one two three") for i in range(2000)] + [(2000 + i, "zebra " * 20_000) for i in range(7)]  # past the first 1,200 documents, or over 100,000 characters
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, kept = lm.train(docs, path, pattern)
    subwords = lm.Subwords(path, pattern)
    training = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    assert any("zebra" in t for t in training) and model.n_ids == sum(len(subwords.of(w)) for t in training for w in lower_words(t)) + len(training)
    zebra = subwords.of(b"zebra")[-1]
    unseen = subwords.of(b"quixotic")[-1]
    assert model.cls[zebra] != model.cls[unseen]
    flats = [np.array([i for w in lower_words(t) for i in subwords.of(w)] + [subwords.end]) for t in training]
    listed = lm.AttentionModel(subwords.end + 1, flats)
    assert (listed.cls == model.cls).all() and np.allclose(listed.inside, model.inside)
    assert 0 < len(kept) <= 100 and lm.OVERLAP * 2 >= lm.WINDOW


def test_language_model_goes_on_over_all_ids_and_mixes_by_all_documents_kept(spark, monkeypatch):
    """A rule that the windows of the start hardly show is learnt from the rest; the weights of the mix come from all words kept back, of long documents too."""
    path, pattern = queries.tokenizer("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(lm, "FIT_WINDOWS", 96)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("red blue", "sun moon")) for _ in range(100))) for i in range(3000)] + [(3000 + i, "zebra " * 20_000) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = lm.training_rows(docs, "doc_id", "text")
    went_on = lm.gone_on
    starts = []
    monkeypatch.setattr(lm, "gone_on", lambda model, ids, end: starts.append((dict(model.w), ids.count())) or went_on(model, ids, end))
    model = lm.fitted_model(training, path, pattern, shared_folder(spark))
    kept = training.filter(lm.kept_back())
    assert kept.count() > 100 and kept.filter("length(text) > 100000").count() and starts[0][1] == training.count() - kept.count()
    subwords = lm.Subwords(path, pattern)
    ids = np.array([i for w in "sun moon red blue red blue sun moon red blue".split() for i in subwords.of(w.encode())] + [subwords.end])
    after, going = model.log_probabilities(ids, np.array([len(ids)])).sum(), model.w
    model.w = starts[0][0]
    assert after > model.log_probabilities(ids, np.array([len(ids)])).sum() + 0.5
    model.w = going
    vocabulary = lm.word_counts(docs)
    texts = [r.text for r in kept.collect()]
    assert lm.mix_weights(model, subwords, kept, vocabulary, 1000) == pytest.approx(lm.mix_weights(model, subwords, texts, vocabulary, 1000))


def test_language_model_hands_python_few_rows_at_once(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, fitted = spark.conf.get(key), lm.fitted_model
    monkeypatch.setattr(lm, "fitted_model", lambda *a: seen.append(int(spark.conf.get(key))) or fitted(*a))
    docs = spark.createDataFrame([(i, f"some words number {i % 7}, {i}") for i in range(1200)], "doc_id long, text string").coalesce(1)
    assert lm.score_documents(docs, *queries.tokenizer("byte_bpe_50k.tiktoken"), shared_folder(spark)).count() == 1200
    assert len(seen) == 1 and 0 < seen[0] <= 1000 and spark.conf.get(key) == before


def test_language_model_words_are_those_of_the_library_one_by_one():
    path, pattern = queries.tokenizer("byte_bpe_50k.tiktoken")
    subwords, asked = lm.Subwords(path, pattern), []
    texts = ["", " \n", "A  b\tc\x1cd  x y\u0085 \u0130 É\n", "it's DON'T x\u3000", "\u3000 1,000.5 '' (a) \u2028b\u2028", "word " * 50] * 9 + ["z\x0b\x0cZ \u00a0"]
    words = lm.Words(subwords, 5)
    encode, subwords.encode = subwords.encode, lambda t: asked.append(t) or encode(t)
    got = list(words.runs(pa.array(texts), 10))
    own = [[*lower_words(t), lm.END_WORD] for t in texts]
    ids = [[subwords.end] if w == lm.END_WORD else encode(" " + w.decode()) for ws in own for w in ws]
    assert [at for at, _ in got] == list(range(0, len(texts), 10)) and np.concatenate([s.count for _, s in got]).tolist() == [len(ws) for ws in own]
    assert np.concatenate([s.ids for _, s in got]).tolist() == [i for word in ids for i in word] and np.concatenate([s.sizes for _, s in got]).tolist() == [len(word) for word in ids]
    assert np.concatenate([s.hashes for _, s in got]).tolist() == [lm._hash(w) for ws in own for w in ws]
    assert sum(t.count("word") for t in asked) == 1 and len(asked) < len({w for ws in own for w in ws})


def test_language_model_counts_ids_at_the_pace_of_numpy():
    """A task adds up keys without converting them one by one, which takes some forty times as long."""
    task = []

    class Ids:
        def mapInArrow(self, run, _):
            task.append(run)
            raise InterruptedError

    with pytest.raises(InterruptedError):
        lm.Gathered(Ids(), 999).summed(lambda flat: flat[1:], 1000)
    ids = np.random.default_rng(4).integers(0, 999, 400_000)
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(401) * 1000, pa.int32()), pa.array(ids, pa.int32()))], ["ids"])

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    out = list(task[0](iter([batch])))
    assert {k: c for b in out for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())} == Counter(ids.tolist())
    assert least(lambda: list(task[0](iter([batch])))) < 12 * least(lambda: np.add.at(np.zeros(1000, np.int64), ids, 1))


@pytest.mark.parametrize("large", [1, 60])
def test_language_model_scores_equal_the_plain_formula(large):
    """Also with weights whose exp is beyond single precision."""
    rng = np.random.default_rng(2)
    model = lm.AttentionModel(51, [rng.integers(0, 50, 40) for _ in range(9)])
    model.fit([rng.integers(0, 50, 200) for _ in range(9)], 50, steps=30)
    model.w = {n: (v * (large if n in "cbq" else 1)).astype(np.float32) for n, v in model.w.items()}
    ids = np.append(rng.integers(0, 50, lm.WINDOW - 1), 50)
    w = {n: v.astype(np.float64) for n, v in model.w.items()}
    flat = np.append(50, ids)
    x = w["e"][model.input[flat[:-1]]] + w["p"]
    a = (x @ w["q"]) @ (x @ w["k"]).T / math.sqrt(lm.DIMENSIONS)
    a = np.where(np.tri(len(a)) > 0, a, -np.inf)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    z = (x + a / a.sum(axis=1, keepdims=True) @ (x @ w["v"]) @ w["o"]) @ w["c"] + w["b"]
    goal, top = model.cls[ids], z.max(axis=1)
    logs = z[np.arange(len(ids)), goal] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
    got = model.log_probabilities(ids, np.array([len(ids)]))
    assert got == pytest.approx(logs / math.log(10) + model.inside[model.cls[flat[:-1]], ids], rel=1e-3, abs=1e-3 * large)
    before = {n: v.copy() for n, v in model.w.items()}
    model.fit_windows(iter([flat[None, :lm.WINDOW + 1]]), 1)
    assert all(np.isfinite(v).all() and v.shape == before[n].shape for n, v in model.w.items()) and any((v != before[n]).any() for n, v in model.w.items())


def test_each_id_is_scored_once_whatever_the_batch():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 50, n) for n in (0, 1, 5, 23, 24, 25, 44, 45, 200, 61)]
    model = lm.AttentionModel(51, sequences)
    model.fit(sequences, 50, steps=20)
    together = model.score(sequences, 50)
    alone = [model.score([s], 50, rows=1)[0] for s in sequences]
    assert np.allclose(together, alone, atol=1e-4)
    first = sum(10 ** model.score([np.array([i])], 50)[0] / 10 ** model.score([np.array([i])], 50)[0] for i in range(3))
    assert first == pytest.approx(3)
    shares = np.array([10.0 ** model.inside[0][model.cls == c].astype(np.float64) for c in np.unique(model.cls)], dtype=object)
    assert all(abs(s.sum() - 1) < 1e-3 for s in shares)  # ids of a class share its probability


def test_toxicity_hashes_words_and_their_grams():
    dice = random.Random(3)
    words = sorted({"".join(dice.choice("abcz09éжあ漢🙂") for _ in range(dice.randint(1, 12))).encode() for _ in range(400)} | {b"a", "é".encode(), b"aaaaaaaaaaaa", b"x" * 5000})
    expected = []
    for place, word in enumerate(words):
        marked = f"<{word.decode()}>"
        grams = {marked} | {marked[i:i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)}
        expected += [(place, b) for b in sorted({zlib.crc32(g.encode()) % toxicity.BUCKETS for g in grams})]
    place, bucket = toxicity.word_buckets(words)
    assert list(zip(place.tolist(), bucket.tolist())) == expected
    known = np.zeros(toxicity.BUCKETS, bool)
    known[bucket[::3]] = True
    place, bucket = toxicity.word_buckets(words, known)
    assert list(zip(place.tolist(), bucket.tolist())) == [(p, b) for p, b in expected if known[b]]
    assert [x.tolist() for x in toxicity.word_buckets([])] == [[], []]


def test_toxicity_counts_buckets_in_memory_that_follows_the_words(spark):
    """A task that counts few buckets holds no array over all possible buckets; words forgotten on the way are counted all the same."""
    task = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            task.append(run)
            raise InterruptedError

    with pytest.raises(InterruptedError):
        toxicity.frequent_buckets(Rows(), 2, 1)
    texts, labels = ["Alpha beta beta", "", "alpha été gamma", " ".join(f"w{i}" for i in range(300)), "beta delta"], [1, 0, 0, 0, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * 90), pa.array(labels * 90, pa.int32())], ["text", "label"])
    tracemalloc.start()
    out = list(task[0](iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for text, label in zip(texts, labels):
        words = sorted({w.encode() for w in text.lower().split()})
        for b in set(toxicity.word_buckets(words)[1].tolist()) if words else ():
            want.setdefault(b, [0, 0])[int(label == 1)] += 90
    assert {k: [c, t] for b in out for k, c, t in zip(*[b.column(i).to_pylist() for i in range(3)])} == want and sum(b.num_rows for b in out) == len(want)
    assert peak < 64 << 20
    counts, known = toxicity.Counts(3), toxicity.WordBuckets(2)
    for own in ([5, 1], [1, 1], [9], [0, 5]):
        counts.add(np.array(own))
    assert [x.tolist() for x in counts.merged()] == [[0, 1, 5, 9], [1, 3, 2, 1]]
    for own in ({b"one", b"two"}, {b"two", b"three", b"four"}, {b"one"}):
        known.learn(own)
        assert sorted(known.of(own).tolist()) == sorted(b for w in own for b in toxicity.word_buckets([w])[1].tolist())


def test_toxicity_learns_words_and_inflections(spark):
    dice = random.Random(8)
    word = lambda: "".join(dice.choice(("ba", "ko", "ri", "te", "su", "ma")) for _ in range(dice.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        toxic, lang = i % 6 == 0, ("aa", "bb")[i % 2 if i % 6 else (i // 6) % 2]
        words = [word() for _ in range(dice.randint(5, 60))]
        if toxic:
            for _ in range(2):
                words[dice.randrange(len(words))] = "Grukk!" if lang == "aa" else "vlotz" + word()
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, None), (5001, "", "aa"), (5002, "grukk " * 60_000, "aa")], "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    truth = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, truth)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [(out[i].flagged, y) for i, y in labels if out[i].held_out]
    assert sum(f == bool(y) for f, y in held) / len(held) > 0.97
    assert out[5002].flagged and not out[5001].flagged and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.flagged}
    without = toxicity.train(docs, truth.filter("toxic = 0"))
    assert {r.score for r in toxicity.score_documents(docs, without).collect()} == {0.5}
    assert toxicity.score_documents(docs.filter("false"), model).count() == 0


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch, sent):
    """A toxic word met only outside the rows of the start, and in texts longer than those, is learnt too; thresholds come from all rows held back."""
    monkeypatch.setattr(toxicity, "START_ROWS", 100)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000)
    monkeypatch.setattr(toxicity, "SENT_IDS", sent)
    monkeypatch.setattr(toxicity, "START_CHARS", 400)
    dice = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 3 == 0
        words = ["".join(dice.choice(("ba", "ko", "ri", "te", "su", "ma")) for _ in range(3)) for _ in range(80 if toxic and i % 2 else 20)]
        if toxic:
            words[dice.randrange(len(words))] = "vlotz" if i % 2 else "grukk"
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    table = toxicity.labelled_rows(docs, truth)
    assert table.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3000)) and table.select("shard").distinct().count() == (3 if sent else 4)
    seen = []
    monkeypatch.setattr(toxicity, "best_threshold", lambda low, high, toxic, clean, own=toxicity.best_threshold: seen.append(int(toxic.sum() + clean.sum())) or own(low, high, toxic, clean))
    model = toxicity.train(docs, truth)
    assert seen[-1] == table.filter("held").count() > 400
    held = [(r.flagged, labels[r.doc_id][1]) for r in toxicity.score_documents(docs, model).filter("held_out and doc_id % 2 = 1 or held_out and doc_id % 3 > 0").collect()]
    assert sum(f == bool(y) for f, y in held) / len(held) > 0.97
    again = toxicity.train(docs, truth)
    assert all((again.weights[k] == model.weights[k]).all() for k in model.weights) and again.thresholds == model.thresholds


def test_toxicity_rejects_nothing_it_has_not_learnt(spark):
    rows = [(i, "vile words" if i % 2 else "kind words", "aa") for i in range(40)] + [(100, None, "aa"), (101, "", None), (102, " .\n!", "aa"), (103, "\u6f22", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for truth in (labels.filter("false"), labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.withColumn("doc_id", labels.doc_id + 1000)):
        model = toxicity.train(docs, truth)
        assert toxicity.reject_toxic(docs, model).count() == len(rows)
        assert not any(r.flagged for r in toxicity.score_documents(docs, model).collect())
    model = toxicity.train(docs, labels)
    model.threshold, model.thresholds = 1e-9, {"aa": 1e-9}  # below any score
    assert {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()} == {100, 101, 102}



def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf).collect(), before.schema)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count(), name
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert final.count() == before.count() and "ids" in final.columns
    assert [r.doc_id for r in before.orderBy("doc_id").select("doc_id").collect()] == [r.doc_id for r in final.orderBy("doc_id").select("doc_id").collect()]


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(3)
    for size, changed in ((1, 1), (40, 7), (900, 150), (5000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
        differ = int(np.bitwise_count(minhash.parities(a) ^ minhash.parities(b)).sum())
        assert differ <= len(np.setxor1d(a, b)) and not (minhash.parities(a) ^ minhash.parities(a)).any()
