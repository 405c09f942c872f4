"""License scans by diagonal voting.

All rolling word k-gram hashes of every document are joined to the positions they have in license templates. A hit at
document word p and template word t votes for the diagonal p - t; votes are counted by diagonal, neighbouring diagonals
(a few inserted or missing words) are merged, and a merged span counts if enough of the template's k-grams, compared word
by word, stand in it. Short phrases use k = 2 and must match in full on one diagonal; notices use k = 3.

Words are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Null and empty texts have no
words. Repeated rows get equal results, one row each; rows of one id with different texts are separate documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelens.llm.common import text_of, written

#: Phrases with their labels: every place counts.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Notices with the labels they prove. Published license notices.
NOTICES = (
    ("gpl", "this work is licensed under the gnu general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a notice's k-grams that a span must hold; neighbouring diagonals are this close.
COVERAGE, NEAR = 0.8, 3


def gram_table(spark: SparkSession, templates: list[tuple[int, str]], k: int) -> DataFrame:
    """hash, grams: every place (template, t, words) of a k-gram. One row a hash; as large as the templates, a few hundred rows."""
    rows = []
    for number, text in templates:
        words = re.findall(_WORD, text.lower())
        rows += [(number, t, words[t:t + k]) for t in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, t int, words array<string>")
    key = F.xxhash64(*[F.col("words")[i] for i in range(k)])
    return grams.withColumn("hash", key).groupBy("hash").agg(F.collect_list(F.struct("template", "t", "words")).alias(f"grams{k}"))


def scan_documents(docs: DataFrame, folder: str, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document row."""
    spark = docs.sparkSession
    short = [(i, text) for i, (_, text) in enumerate(phrases)]
    long = [(len(phrases) + i, text) for i, (_, text) in enumerate(notices)]
    grams = {k: sum(max(0, len(re.findall(_WORD, t)) - k + 1) for _, t in part) for k, part in ((2, short), (3, long))}
    names = spark.createDataFrame(
        [(n, label, max(1, len(re.findall(_WORD, t)) - k + 1), n < len(phrases)) for k, part, source in ((2, short, phrases), (3, long, notices)) for (n, t), (label, _) in zip(part, source)],
        "template int, label string, grams int, phrase boolean",
    )
    assert all(grams.values()), "phrases need two words, notices three"

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("tie"), F.regexp_extract_all(text_of(text_col), F.lit(_WORD), F.lit(0)).alias("w"))
    zipped = F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("x"), F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))).alias("y"))
    rows = texts.select("id", "tie", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(zipped).alias("p", "g"))
    word = [F.col("g")[name] for name in ("w", "x", "y")]
    rows = rows.select("id", "tie", "n_words", "p", *[c.alias(f"w{i}") for i, c in enumerate(word)])
    for k, part in ((2, short), (3, long)):
        table = gram_table(spark, part, k).withColumnRenamed("hash", f"h{k}")
        rows = rows.join(F.broadcast(table), F.xxhash64(*[F.lower(F.col(f"w{i}")) for i in range(k)]) == F.col(f"h{k}"), "left")  # templates only
    own = F.array(*[F.translate(F.col(f"w{i}"), _UPPER, _LOWER) for i in range(3)])
    same = lambda k: F.filter(F.coalesce(f"grams{k}", F.array().cast("array<struct<template:int,t:int,words:array<string>>>")), lambda g: g["words"] == F.slice(own, 1, k))
    kept = rows.filter("grams2 IS NOT NULL OR grams3 IS NOT NULL OR coalesce(p, 0) = 0").select(
        "id", "tie", "n_words", "p", F.transform(F.concat(same(2), same(3)), lambda g: F.struct(g["template"].alias("template"), g["t"].alias("t"))).alias("hits"))
    kept = written(kept, folder, "hits")  # one row a document, and those k-grams that stand in a template

    hits = kept.select("id", "tie", "p", F.explode("hits").alias("h")).select("id", "tie", "p", "h.*")
    diagonals = hits.groupBy("id", "tie", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("places"), F.min("p").alias("first"), F.max("p").alias("last"))
    diagonals = diagonals.join(F.broadcast(names), "template")
    base = diagonals.filter("phrase AND size(places) = grams").groupBy("id", "tie").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base"))
    by_place = Window.partitionBy("id", "tie", "template").orderBy("first", "diagonal")
    notices_found = (
        diagonals.filter("NOT phrase")
        .withColumn("new", (F.coalesce(F.abs(F.col("diagonal") - F.lag("diagonal").over(by_place)) > NEAR, F.lit(True)) | (F.col("first") - F.lag("last").over(by_place) > F.col("grams"))).cast("int"))
        .withColumn("span", F.sum("new").over(by_place))
        .groupBy("id", "tie", "template", "label", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"))
        .withColumn("coverage", F.col("votes") / F.col("grams"))
        .groupBy("id", "tie").agg(F.max("coverage").alias("coverage"), F.collect_set(F.when(F.col("coverage") >= COVERAGE, F.col("label"))).alias("more"))
    )
    copies = kept.filter("coalesce(p, 0) = 0").groupBy("id", "tie").agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    out = copies
    for part in (base, notices_found):
        part = part.withColumnsRenamed({"id": "own_id", "tie": "own_tie"})
        out = out.join(part, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie")), "left").drop("own_id", "own_tie")
    none = F.array().cast("array<string>")
    names_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        names_of(F.coalesce("base", none)).alias("base_labels"), names_of(F.concat(F.coalesce("base", none), F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0))).alias("score"))
