"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of a text is hashed and joined to the positions that
it has in the templates (a fixed table of this module, so its size is bounded).
A hit votes for the diagonal ``position in text - position in template``;
neighbouring diagonals are merged, which bridges inserted and deleted words.  A
merged group is a span when the words agree (not just their hashes), enough of
the template is covered, and the span is not much longer than the template.  In
a group that is too long, as openings that repeat make it, each diagonal is
tested alone.

Short base phrases are templates as well: they are found where every k-gram
stands on one diagonal.

Defined results: a null text counts as empty; rows keep their identity, so
repeated rows and repeated or null ids give one result row each; an empty table
gives an empty result; further columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that the query's contract names, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Opening words of well-known public licences, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased.  The Kelvin sign is the one other letter that lower() turns into ASCII; it stays a letter of its own."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _gram(at: Column, position: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(at, position + j) for j in range(k)])


def template_grams(spark: SparkSession, base, templates, k: int) -> DataFrame:
    """``(gram_hash, gram, template, label, is_base, n_grams, n_template_words, t_pos)`` and one row that carries texts without a hit."""
    rows = []
    for number, (label, phrase, is_base) in enumerate([(a, b, True) for a, b in base] + [(a, b, False) for a, b in templates]):
        ws = phrase.split(" ")
        if len(ws) < k:
            raise ValueError(f"template shorter than {k} words: {phrase}")
        rows += [(" ".join(ws[i : i + k]), number, label, is_base, len(ws) - k + 1, len(ws), i) for i in range(len(ws) - k + 1)]
    rows.append(("", -1, None, False, 0, 0, 0))
    df = spark.createDataFrame(rows, "gram string, template int, label string, is_base boolean, n_grams int, n_template_words int, t_pos int")
    return df.withColumn("gram_hash", F.xxhash64("gram"))


def scan(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    base=BASE,
    templates=TEMPLATES,
    k: int = K,
    max_shift: int = 3,
    min_coverage: float = 0.6,
    max_stretch: float = 1.5,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists what the method found: label, first word, words covered and
    the share of the template's k-grams that agree.  ``score`` is the largest
    share of any template.
    """
    grams = template_grams(spark, base, templates, k)
    n_phrase = len(base)
    doc = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))
    doc = doc.withColumn("n_words", F.size("ws").cast("long"))
    places = F.when(F.col("n_words") >= k, F.sequence(F.lit(0), F.col("n_words").cast("int") - k)).otherwise(F.array().cast("array<int>"))
    # position -1 holds the empty gram: it carries the text's own row through the join
    listed = F.transform(F.concat(F.array(F.lit(-1)), places), lambda i: F.when(i < 0, F.lit("")).otherwise(_gram(F.col("ws"), i, k)))
    flat = doc.select("rid", "doc_id", "n_words", F.posexplode(listed).alias("at", "gram"))
    flat = flat.withColumn("gram_hash", F.xxhash64("gram"))
    hits = flat.alias("d").join(F.broadcast(grams).alias("t"), (F.col("d.gram_hash") == F.col("t.gram_hash")) & (F.col("d.gram") == F.col("t.gram")))
    hits = hits.select(
        "rid", "doc_id", "n_words", "template", "label", "is_base", "n_grams", "n_template_words", "t_pos", (F.col("at") - 1 - F.col("t_pos")).cast("long").alias("diagonal"), (F.col("at") - 1).cast("long").alias("w_pos")
    )
    of_doc = ["rid", "doc_id", "n_words"]
    of_template = ["template", "label", "is_base", "n_grams", "n_template_words"]
    diagonals = hits.groupBy(*of_doc, *of_template, "diagonal").agg(
        F.collect_set("t_pos").alias("t_set"), F.min("w_pos").alias("lo"), F.max("w_pos").alias("hi")
    )
    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    diagonals = diagonals.withColumn("starts", (F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(line) > max_shift)).cast("int"))
    diagonals = diagonals.withColumn("group", F.sum(F.coalesce("starts", F.lit(1))).over(line))
    spans = diagonals.groupBy(*of_doc, *of_template, "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("t_set")))).alias("votes"), F.min("lo").alias("first"), (F.max("hi") + k).alias("end"), F.min("diagonal").alias("diagonal"),
        F.collect_list(F.when((F.col("template") >= n_phrase) & (F.size("t_set") >= min_coverage * F.col("n_grams")), F.struct(F.col("lo").alias("first_word"), (F.col("hi") + k - F.col("lo")).alias("n_span_words"), F.col("label"), (F.size("t_set") / F.col("n_grams")).alias("coverage")))).alias("alone"),
    )
    coverage = F.when(F.col("template") >= 0, F.col("votes") / F.col("n_grams"))
    whole = F.col("is_base") & (F.col("votes") == F.col("n_grams"))
    fits = (F.col("template") >= n_phrase) & (coverage >= min_coverage) & (F.col("end") - F.col("first") <= F.col("n_template_words") * max_stretch + max_shift)
    own = F.struct(F.col("first").alias("first_word"), (F.col("end") - F.col("first")).alias("n_span_words"), F.col("label"), coverage.alias("coverage"))
    # a group that is too long is not a span, but one of its diagonals may be
    spans = spans.withColumn("found", F.when(fits, F.array(own)).otherwise(F.col("alone")))
    fits = F.size("found") > 0
    return (
        spans.groupBy(*of_doc)
        .agg(
            F.count_if(whole).alias("n_base"),
            F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
            F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set(F.when(whole | fits, F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(whole | F.col("template").between(n_phrase, 1 << 30), coverage)), F.lit(0.0)).alias("score"),
            F.sort_array(F.flatten(F.collect_list("found"))).alias("spans"),
        )
        .drop("rid")
    )
