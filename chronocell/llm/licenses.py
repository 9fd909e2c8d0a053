"""License scans: base phrases by word position and an exact containment join with templates, DataFrame operations only.

A block is a line of a text with the next lines until those hold as many words as the longest template, so a statement
may be wrapped; lines without a word don't count. A template is a short license statement. A block meets a template if at least `threshold` of
the template's distinct words are in the block. Words are ordered by how many documents hold them, rarest first; a
template's prefix is its first |T| - need + 1 words in that order, so a block without any of them can't meet it.
Candidates then pass a length and a positional filter, and are verified on whole word sets. Of the templates that a block
meets, one whose shared words are all among another's gives way to it, if that shares more or, sharing as much, lacks less:
so a statement is not named after its siblings.

Texts are read once: what the join needs of them, the words of lines that templates have and the lines' lengths, is
written by the pass that finds the phrases.

Defined cases: a null or empty text has 0 words, no places and no labels; rows that repeat each get their result; templates
that tie at a line are all named; null ids are matched like others and other columns are left out; an empty table gives
an empty result; a text's length is not limited.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, session_of

#: Fixed values.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Label and wording of common short license statements; a parameter of the operator.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_col(text):
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))


def literal_words(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def base_places(words: str, phrase: str):
    """The word positions at which the phrase starts; the words are only walked where its rarest part is present."""
    parts = phrase.split(" ")
    at = F.col(words)
    here = lambda i: [F.get(at, i + k) == F.lit(p) for k, p in enumerate(parts)]

    def all_of(i):
        x = here(i)
        out = x[0]
        for y in x[1:]:
            out = out & y
        return out

    none = F.expr("cast(array() as array<int>)")
    held = F.array_contains(at, parts[0])
    for p in parts[1:]:
        held = held & F.array_contains(at, p)
    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(at) - 1), all_of)).otherwise(none)


def labelled(places, label: str):
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of every document.

    blocks: the (first line, label, containment) found by the join; score: the best containment. A template is named at
    a line if the line alone meets it, or adds words to what the lines after it hold.
    """
    spark = session_of(docs)
    vocab = sorted({w for _, t in templates for w in t.split(" ")})
    words = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), words_col).alias("parts"))
    words = words.withColumn("words", F.flatten("parts"))
    # of the lines with words: place, number of words, and those words that templates have
    lines = F.filter(F.transform("parts", lambda x, i: F.struct(i.alias("line"), F.size(x).alias("n"), F.array_intersect(x, literal_words(vocab)).alias("words"))), lambda x: x["n"] > 0)
    held = F.array_intersect("words", literal_words(vocab)).alias("held")
    places = F.flatten(F.array(*[labelled(base_places("words", p), label) for label, p in PHRASES])).alias("places")
    kept = cut(words.select("doc_id", "row_hash", F.size("words").cast("long").alias("n_words"), held, places, F.when(F.size(held) > 0, lines).alias("lines")), "license-words")

    # the words of all templates, rarest in the corpus first; there are as many rows as template words
    order = spark.createDataFrame([(w,) for w in vocab], "word string").join(kept.select(F.explode("held").alias("word")).groupBy("word").count(), "word", "left")
    ranked = [r.word for r in order.orderBy(F.coalesce("count", F.lit(0)), "word").collect()]
    rank = {w: i for i, w in enumerate(ranked)}
    plan = []
    for i, (label, t) in enumerate(templates):
        own = sorted(set(t.split(" ")), key=rank.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        plan += [(i, label, own, len(own), need, pos, w) for pos, w in enumerate(own[: len(own) - need + 1], 1)]
    prefix = spark.createDataFrame(plan, "template int, label string, own array<string>, size int, need int, pos int, word string")
    rare = sorted({p[-1] for p in plan})
    longest = max((len(t.split(" ")) for _, t in templates), default=0)
    rare_words = literal_words(rare)

    # a block is built where one of its lines may hold a rare word
    lines = kept.where(F.arrays_overlap("held", rare_words)).select("doc_id", "row_hash", "lines").dropDuplicates(["doc_id", "row_hash"])
    lines = lines.withColumn("rare", F.transform("lines", lambda x: F.arrays_overlap(x["words"], rare_words)))
    none = F.expr("cast(array() as array<string>)")

    def rest_of(i):
        start = F.struct(none.alias("words"), F.lit(0).alias("n"))
        return F.aggregate(F.slice("lines", i + 2, longest), start, lambda acc, x: F.when(acc["n"] < longest, F.struct(F.concat(acc["words"], x["words"]).alias("words"), (acc["n"] + x["n"]).alias("n"))).otherwise(acc), lambda acc: acc["words"])

    starts = F.filter(F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.exists(F.slice("rare", i + 1, longest + 1), lambda x: x))
    runs = lines.select("doc_id", "row_hash", F.explode(F.transform(starts, lambda i: F.struct(F.get(F.col("lines"), i)["line"].alias("line"), F.get(F.col("lines"), i)["words"].alias("own"), rest_of(i).alias("rest")))).alias("run"))
    runs = runs.select("doc_id", "row_hash", "run.line", F.col("run.own").alias("alone"), F.array_distinct("run.rest").alias("rest"))
    blocks = runs.withColumn("ordered", F.array_intersect(literal_words(ranked), F.array_union("alone", "rest")))  # the block's words in the global order
    hits = blocks.withColumn("word", F.explode(F.array_intersect("ordered", literal_words(rare)))).join(prefix, "word")
    bound = 1 + F.least(F.col("size") - F.col("pos"), F.size("ordered") - F.array_position("ordered", F.col("word")))
    hits = hits.where(F.size("ordered") >= F.col("need"))
    first = Window.partitionBy("doc_id", "row_hash", "line", "template").orderBy("pos")
    hits = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1").where(bound >= F.col("need"))  # what stands before the first shared word is not shared
    hits = hits.withColumn("shared", F.array_intersect("ordered", "own")).where("size(shared) >= need")
    hits = hits.where((F.size(F.array_intersect("alone", "own")) >= F.col("need")) | (F.size(F.array_intersect("rest", "own")) < F.size("shared")))
    met = hits.groupBy("doc_id", "row_hash", "line").agg(F.collect_list(F.struct("label", "shared", (F.size("shared") / F.col("size")).alias("containment"))).alias("met"))
    within = lambda x, y: F.size(F.array_except(x["shared"], y["shared"])) == 0
    better = lambda x, y: within(x, y) & ((F.size(y["shared"]) > F.size(x["shared"])) | (y["containment"] > x["containment"]))
    met = met.withColumn("met", F.filter("met", lambda x: ~F.exists("met", lambda y: better(x, y))))
    met = met.select("doc_id", "row_hash", F.transform("met", lambda x: F.struct(F.col("line").alias("line"), x["label"].alias("label"), x["containment"].alias("containment"))).alias("met"))
    found = met.groupBy("doc_id", "row_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))).alias("blocks"))

    found = found.withColumnsRenamed({"doc_id": "k", "row_hash": "h"})
    out = kept.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("row_hash") == F.col("h")), "left")
    at = F.transform("places", lambda p: p["at"])
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.expr("cast(array() as array<string>)"))
    score = F.greatest(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"), score.alias("score"), "blocks")
