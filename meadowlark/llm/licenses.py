"""License scans by diagonal voting: word k-gram hashes of texts meet those of templates, hits vote for offset diagonals.

Built-in functions and joins only. Every place of a text is a row with the hashes of the k-grams that start there; these
meet the template table, which is broadcast (its size is that of the templates below, some hundred rows). A hit at text
place p and template place q votes for the diagonal p - q. Neighbouring diagonals of a template are merged, as words put
in or left out move the offset, and a span is verified by the template words that its hits cover. k-grams are compared
as words after the hashes met, so a verified phrase stands in the text word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text whose A-Z are lower-cased: 0-9, a-z and everything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases with their labels, all of whose words must stand.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Public notices with their labels; a span needs a share of their words.
NOTICES = (
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
)

#: Words of a k-gram for phrases and for notices.
PHRASE_K, NOTICE_K = 2, 3
#: Diagonals of a notice are merged up to this distance.
NEAR = 4
#: Share of a notice's words that a span's hits must cover, and the most words of a span for each word of the notice.
COVERED, STRETCHED = 0.7, 1.5


def template_grams(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(template, label, exact, length, k, q, gram): the k-grams of each template by their place."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("exact"), F.split(F.lit(text), " ").alias("words")) for i, (text, label) in enumerate((*phrases, *notices))]
    known = spark.range(1).select(F.inline(F.array(*rows)))
    sized = known.withColumns({"length": F.size("words"), "k": F.when(F.col("exact"), PHRASE_K).otherwise(NOTICE_K)})
    placed = sized.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("k"))))
    return placed.select("template", "label", "exact", "length", "k", "q", F.array_join(F.slice("words", F.col("q") + 1, F.col("k")), " ").alias("gram"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans): a row for each row of ``docs``; spans are structs.

    ``first`` and ``last`` are the places of a span's first and last word; exact spans are phrases, others notices with
    the share of their words that is covered. A null text is empty; rows that repeat an id and text have equal results,
    and other rows of one id have their own. Spans (first, last, label, exact, score) stand in that order.
    """
    templates = template_grams(docs.sparkSession, phrases, notices)
    hashed = templates.select("template", "label", "exact", "length", "k", "q", F.col("gram").alias("_wanted"), F.xxhash64(F.lit("gram"), "gram").alias("_hash"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).select("doc_id", F.sha2("_text", 256).alias("_sha"), _words(F.col("_text")).alias("_words"))
    # Every place of a text, and one past the end, which keeps texts without hits.
    placed = texts.withColumn("_p", F.explode(F.sequence(F.lit(0), F.size("_words"))))
    word = lambda i: F.get("_words", F.col("_p") + i)
    grams = F.array(*(F.concat_ws(" ", *(word(i) for i in range(k))) for k in (PHRASE_K, NOTICE_K)))
    end = F.col("_p") == F.size("_words")
    looked = placed.select("doc_id", "_sha", F.size("_words").cast("long").alias("n_words"), "_p", end.alias("_end"), F.explode(F.when(end, F.array(F.lit(""))).otherwise(grams)).alias("_gram"))
    keyed = looked.withColumn("_hash", F.when(F.col("_end"), F.xxhash64(F.lit("end"))).otherwise(F.xxhash64(F.lit("gram"), "_gram")))
    # The end meets a row of its own.
    ends = docs.sparkSession.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(True).alias("exact"), F.lit(0).alias("length"), F.lit(0).alias("k"), F.lit(0).alias("q"), F.lit("").alias("_wanted"), F.xxhash64(F.lit("end")).alias("_hash"))
    hits = keyed.join(F.broadcast(hashed.unionByName(ends)), "_hash").where("_gram = _wanted")
    # Votes of a diagonal: the template's places, each once; of the end, how many rows repeat the text.
    own, kind = ["doc_id", "_sha", "n_words"], ["template", "label", "exact", "length", "k"]
    diagonals = hits.groupBy(*own, *kind, (F.col("_p") - F.col("q")).alias("_diagonal")).agg(F.collect_set("q").alias("_votes"), F.count("*").alias("_rows"))
    spans = _merged(diagonals, own, kind)
    found = spans.groupBy(*own).agg(F.max("_rows").alias("_rows"), F.array_sort(F.collect_list("_span")).alias("spans"))
    return found.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy")).drop("_copy")


def _merged(diagonals: DataFrame, own: list[str], kind: list[str]) -> DataFrame:
    """Neighbouring diagonals of a notice in one, those of a phrase each on its own; then spans whose hits cover enough of
    the template's words without much between them. Of an end, ``_rows``, and no span."""
    along = Window.partitionBy(*own, *kind).orderBy("_diagonal")
    apart = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(NEAR), F.lit(True))
    parts = diagonals.withColumn("_apart", apart.cast("int")).withColumn("_part", F.sum("_apart").over(along))
    first, last = F.col("_diagonal") + F.array_min("_votes"), F.col("_diagonal") + F.array_max("_votes") + F.col("k") - 1
    ends = F.max(F.when(F.col("template") < 0, F.col("_rows"))).alias("_rows")
    spans = parts.groupBy(*own, *kind, "_part").agg(F.array_distinct(F.flatten(F.collect_list("_votes"))).alias("_qs"), F.min(first).alias("_first"), F.max(last).alias("_last"), ends)
    words = F.size(F.array_distinct(F.flatten(F.transform("_qs", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    scored = spans.withColumn("_share", F.when(F.col("template") >= 0, words / F.col("length")))
    needs, wide = (F.when(F.col("exact"), 1.0).otherwise(x) for x in (COVERED, STRETCHED))
    good = (F.col("_share") >= needs) & (F.col("_last") - F.col("_first") + 1 <= F.col("length") * wide)
    span = F.struct(F.col("_first").cast("long").alias("first"), F.col("_last").cast("long").alias("last"), "label", "exact", F.col("_share").alias("score"))
    return scored.where((F.col("template") < 0) | good).select(*own, "_rows", F.when(F.col("template") >= 0, span).alias("_span"))
