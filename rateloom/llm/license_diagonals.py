"""License scan by diagonal voting, in DataFrame operations only.

Each word is hashed once; the hash of a k-gram is a cyclic polynomial of its words' hashes, the same for texts and
templates. Grams that no template has are dropped inside the array; the others are joined by hash to the templates, and a
hit at text word ``p`` and template word ``t`` votes for diagonal ``p - t``. Votes are summed per text, template and
diagonal; diagonals of a template that lie within a few words of each other (a word added or left out) are merged to
spans. A span is then verified: the template's words are compared with the text's words on the span's diagonals, and it is
accepted if enough of them stand there. A phrase stands at a place exactly when all its words stand on one diagonal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save

K = 3
#: Up to so many different grams of templates are looked up inside the arrays and broadcast; more are joined by a shuffle.
LISTED_GRAMS = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place is reported, with their labels (fixed values).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Passages of public licenses; each is recognised by a large part of it.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)


def gram_hash(words: str, at: Column) -> Column:
    """Cyclic polynomial (a rolling hash) of the hashes of the ``K`` words from a place."""
    out = F.lit(0).cast("long")
    for j in range(K):
        x, turn = F.xxhash64(F.get(words, at + j)), 7 * (K - 1 - j)
        out = out.bitwiseXOR(F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)) if turn else x)
    return out


def grams_of(words: str, firsts: list[int] | None = None) -> Column:
    """The grams of an array of words as structs (p, h), or only those whose first word has one of the hashes."""
    if firsts is None:
        last = F.size(words) - K
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    else:
        places = F.array_remove(F.transform(words, lambda w, i: F.when(F.xxhash64(w).isin(firsts), i).otherwise(-1)), -1)
        places = F.filter(places, lambda i: i <= F.size(words) - K)
    return F.transform(places, lambda i: F.struct(i.alias("p"), gram_hash(words, i).alias("h")))


def template_table(spark, phrases: Sequence[tuple[str, str]], passages: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``template, label, exact, words`` of the lists, which the caller holds as Python values."""
    rows = [(k, label, exact, text.split()) for k, (label, text, exact) in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in passages])]
    short = [" ".join(r[3]) for r in rows if len(r[3]) < K]
    if short:
        raise ValueError(f"a template has {K} words or more: {short}")
    return spark.createDataFrame(rows, "template int, label string, exact boolean, template_words array<string>")


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, passages: Sequence[tuple[str, str]] = PASSAGES, cover: float = 0.7, gap: int = 3, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED_GRAMS) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of all phrases, ``first_word`` and ``last_word`` are their smallest and largest start (null
    if there are none); ``score`` is the largest part of a template's words that stand in a span. Templates have any length
    from ``K`` words. Null texts count as empty: no words, empty labels, score 0. Rows that repeat an identifier (or have
    none) are scanned each for itself; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    templates = template_table(spark, phrases, passages)
    marks = templates.select("template", "template_words", F.explode(grams_of("template_words")).alias("mark"))
    marks = save(marks.select("template", F.col("mark.p").alias("t"), "mark.h", F.xxhash64(F.get("template_words", F.col("mark.p"))).alias("first")), "license-grams")
    known = marks.select("h", "first").distinct().limit(listed + 1).collect()
    few = len(known) <= listed
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), NOT_WORD), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    if few:
        rows = rows.withColumn("grams", F.filter(grams_of("words", sorted({r.first for r in known})), lambda g: g["h"].isin([r.h for r in known])))
    else:
        rows = rows.withColumn("grams", grams_of("words"))
    # words of texts without any hit are not needed again
    rows = save(rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("grams") > 0, F.col("words")).alias("words"), "grams"), "license-rows")
    marked = rows.filter("words IS NOT NULL")
    hits = marked.select("row", F.explode("grams").alias("gram")).select("row", "gram.p", "gram.h").join(F.broadcast(marks) if few else marks, "h")
    votes = hits.groupBy("row", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > gap, F.lit(True))
    votes = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(near))
    spans = votes.groupBy("row", "template", "span").agg(F.array_sort(F.collect_list("diagonal")).alias("diagonals"))
    spans = spans.join(F.broadcast(templates) if few else templates, "template").join(marked.select("row", "words"), "row")
    here = lambda t, d: F.get("words", t + d) == F.get("template_words", t)
    seen = F.filter(F.sequence(F.lit(0), F.size("template_words") - 1), lambda t: F.exists("diagonals", lambda d: (t + d >= 0) & F.coalesce(here(t, d), F.lit(False))))
    whole = lambda d: (d >= 0) & F.forall(F.sequence(F.lit(0), F.size("template_words") - 1), lambda t: F.coalesce(here(t, d), F.lit(False)))
    at = F.when(F.col("exact"), F.filter("diagonals", whole)).otherwise(F.array().cast("array<int>"))
    spans = spans.select("row", "label", at.alias("at"), (F.size(seen) / F.size("template_words")).alias("part"))
    listed_labels = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    base = F.size("at") > 0
    found = spans.groupBy("row").agg(
        F.sum(F.size("at")).cast("long").alias("n_base"), F.min(F.array_min("at")).cast("long").alias("first_word"), F.max(F.array_max("at")).cast("long").alias("last_word"),
        listed_labels(base).alias("base_labels"), listed_labels(base | (F.col("part") >= cover)).alias("labels"), F.max("part").alias("score"))
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
