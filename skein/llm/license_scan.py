"""License scan by diagonal voting, in DataFrame functions only.

All word k-grams of a text are hashed at every position. Those that occur in a template are joined to its positions,
words and all; a match votes for the diagonal position - template position. Votes are counted by diagonal, neighbouring
diagonals (words put in or left out) are merged, and a merged span counts when enough of the template's k-grams stand on
it. Base phrases are templates as well: with k = 2 and all of their k-grams on one diagonal their words stand there
consecutively, as votes compare words and not hashes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, index_range, let, table, words

#: All but 0-9, A-Z (lower-cased before), a-z and characters beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licenses ask to print them.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software"
    ),
    "apache": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied"
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    ),
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
}

PHRASE_GRAM, NOTICE_GRAM = 2, 4


def template_table(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], notice_gram: int) -> DataFrame:
    """One row per k-gram of each template; a few hundred rows, whatever the corpus."""
    rows = []
    for base, named, k in ((True, list(phrases.items()), PHRASE_GRAM), (False, [(text, label) for label, text in notices.items()], notice_gram)):
        for t, (text, label) in enumerate(named):
            w = text.split()
            rows += [(k, " ".join(w[i : i + k]), t if base else 1000 + t, label, i, len(w) - k + 1, base) for i in range(len(w) - k + 1)]
    frame = spark.createDataFrame(rows, "k int, gram string, template int, label string, at int, n_grams int, base boolean")
    return frame.withColumn("h", gram_hash([F.element_at(F.split("gram", " "), 1), F.col("gram")]))


def gram_hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _grams(w: Column, k: int, known: list[int]) -> Column:
    """The k-grams of w whose hash is one of a template's: array of (k, at, h, gram)."""
    spans = F.transform(index_range(F.size(w) - k + 1), lambda i: F.struct(i.alias("at"), gram_hash([F.get(w, i), F.array_join(F.slice(w, i + 1, k), " ")]).alias("h")))
    hits = F.filter(spans, lambda s: s["h"].isin(known))
    return F.transform(hits, lambda s: F.struct(F.lit(k).alias("k"), s["at"].alias("pos"), s["h"].alias("h"), F.array_join(F.slice(w, s["at"] + 1, k), " ").alias("gram")))


def scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    notice_gram: int = NOTICE_GRAM,
    slack: int = 4,
    least: float = 0.5,
    gap: float = 0.25,
) -> DataFrame:
    """Per span found: row, doc_id, n_words, label, base, first (word), last (word), share (of the template's k-grams).

    A document without a span has one row with nulls. Null and empty texts have no words. Repeated rows and null ids are
    told apart by ``row``; other columns of docs are not read. ``slack`` is the step
    between diagonals that are merged; for longer templates it is ``gap`` times their k-grams, so words put in or left
    out in the middle don't break a notice in two.
    """
    spark = docs.sparkSession
    templates = template_table(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, notice_gram)
    known = [(r.k, r.h) for r in templates.select("k", "h").distinct().collect()]  # a fixed few hundred
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(ascii_lower(F.col(text_col)), GAPS).alias("w"))
    by_k = {k: [h for kk, h in known if kk == k] for k in {k for k, _ in known}}
    found = source.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), let(F.col("w"), lambda w: F.concat(*[_grams(w, k, hs) for k, hs in sorted(by_k.items())])).alias("grams"))
    hits = found.select("row", "doc_id", "n_words", F.explode_outer("grams").alias("g")).select("row", "doc_id", "n_words", "g.*")
    votes = hits.join(F.broadcast(templates), ["k", "h", "gram"], "left")
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "n_grams", "k"]
    lines = votes.groupBy(*keys, "diagonal").agg(F.collect_set("at").alias("places"), F.count("pos").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(near)
    far = F.greatest(F.lit(slack), (F.col("n_grams") * gap).cast("int"))
    lines = lines.withColumn("new", (F.col("base") | F.coalesce(step > far, F.lit(True))).cast("int"))
    lines = lines.withColumn("span", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy(*keys, "span").agg(F.sum("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
    # A span is verified by the template's different places that it holds, however often they were voted for.
    share = F.col("places") / F.col("n_grams")
    good = F.col("template").isNotNull() & F.when(F.col("base"), F.col("votes") == F.col("n_grams")).otherwise((share >= least) & (F.col("high") - F.col("low") < 2 * F.col("n_grams")))
    pick = lambda c: F.when(good, c)
    return spans.select(
        "row", "doc_id", "n_words", pick(F.col("label")).alias("label"), pick(F.col("base")).alias("base"), pick(F.col("low").cast("long")).alias("first"),
        pick((F.col("high") + F.col("k") - 1).cast("long")).alias("last"), pick(share).alias("share"),
    )


def license_labels(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: n_words, the base phrases' places and all labels. score is the best template's share."""
    base = F.col("base")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    return (
        scan(docs, text_col, **options)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents")).drop("row")
