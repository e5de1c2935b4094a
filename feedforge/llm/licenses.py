"""License scan by diagonal voting (operator 3), in DataFrame functions only.

The texts of licenses and the phrases are one bounded table of templates: a row for each word pair
with its place. Every rolling word pair of every document is hashed and joined to it; the table is
a constant of the program, so it is broadcast. Hits of one document and template vote for their
offset diagonal (place in the document minus place in the template); a diagonal carries the set of
template places that hit it. A diagonal that has every pair of a phrase is an exact place of it.
Neighbouring diagonals, which insertions and deletions part, merge into spans. A span is verified by
its longest chain of hits that ascend both in the document and in the template, so that a pair which
repeats counts once and pairs in another order don't count together; the share is the chain's length
over the template's pairs. The join compares the words of a pair beside their hash, so no verdict
rests on a hash alone.

Words are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z lower-cased.

Edge cases: null and empty texts have no words, no hits and score 0; places that overlap all
count; repeated rows are scanned each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Distinctive notices of public licenses.
NOTICES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["gnu lesser general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike"],
    "cc-by": ["licensed under cc by 4 0", "creative commons attribution"],
    "cc0": ["creative commons zero", "dedicated to the public domain"],
    "reserved": ["no part of this publication may be reproduced"],
}
#: Share of a notice's word pairs that a chain of hits must show.
MIN_SHARE = 0.75
#: Diagonals this far apart belong to one span.
MAX_SHIFT = 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """template, label, exact (a phrase), pairs (their number), place, first and second word."""
    rows, number = [], 0
    for exact, label, text in [(True, v, k) for k, v in PHRASES.items()] + [(False, k, t) for k, v in NOTICES.items() for t in v]:
        words = text.split()
        if len(words) > 63:
            raise ValueError("a template has 62 word pairs at most, a bit each")
        rows += [(number, label, exact, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
        number += 1
    return spark.createDataFrame(rows, "template int, label string, exact boolean, pairs int, place int, a string, b string").withColumn("pair", F.xxhash64("a", "b"))


def words_of(text: Column) -> Column:
    """Words of a text. The Kelvin sign alone would lower into ASCII, so it is first put into another letter."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(plain), BREAK), "")


def votes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hits by document, template and diagonal; template -1 holds the number of words as its diagonal."""
    spark = docs.sparkSession
    worded = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    pair = F.transform(
        F.when(F.size("words") > 1, F.sequence(F.lit(0), F.size("words") - 2)).otherwise(F.expr("array()").cast("array<int>")),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("words", i), F.get("words", i + 1)).alias("pair"), F.get("words", i).alias("wa"), F.get("words", i + 1).alias("wb")),
    )
    # a pair of empty words carries the number of words, so that texts are read once
    marker = F.array(F.struct(F.size("words").alias("at"), F.lit(0).cast("long").alias("pair"), F.lit("").alias("wa"), F.lit("").alias("wb")))
    grams = worded.select("doc_id", "text_hash", F.inline(F.concat(pair, marker)))
    head = spark.createDataFrame([(-1, "", False, 1, 0, "", "", 0)], "template int, label string, exact boolean, pairs int, place int, a string, b string, pair long")
    vocabulary = F.broadcast(templates(spark).unionByName(head))
    # prefixes of each other, so equal; written so that the hash alone is the key of the join
    alike = lambda x, y: F.startswith(x, y) & F.startswith(y, x)
    hits = grams.join(vocabulary, (grams["pair"] == vocabulary["pair"]) & alike(F.col("wa"), F.col("a")) & alike(F.col("wb"), F.col("b")))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("place"), F.lit(0)))
    return (
        hits.withColumn("diagonal", F.when(F.col("template") < 0, F.col("at")).otherwise(F.col("at") - F.col("place")))
        .groupBy("doc_id", "text_hash", "template", "label", "exact", "pairs", "diagonal")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or(place).alias("places"))
    )


def chain_length(diagonals: Column, pairs: Column) -> Column:
    """Length of the longest chain of hits that ascends in the document and in the template.

    diagonals: structs (diagonal, places) of one span. Hits go in document order, those of one word
    pair by falling template place; each element of the state is the longest chain that ends there or
    at an earlier template place.
    """
    all_places = F.sequence(F.lit(0), pairs - 1)
    hit = lambda d, p: d["places"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p)) != 0
    of = lambda d: F.transform(F.filter(all_places, lambda p: hit(d, p)), lambda p: F.struct((d["diagonal"] + p).alias("at"), (-p).alias("back")))
    ordered = F.array_sort(F.flatten(F.transform(diagonals, of)))
    none = F.array_repeat(F.lit(0), pairs)
    longer = lambda f, h: F.transform(f, lambda v, i: F.when(i >= -h["back"], F.greatest(v, F.coalesce(F.get(f, -h["back"] - 1), F.lit(0)) + 1)).otherwise(v))
    return F.array_max(F.aggregate(ordered, none, longer))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, max_shift: int = MAX_SHIFT) -> DataFrame:
    """One row a distinct document row: doc_id, text_hash, copies, word and place counts, labels and score."""
    votes = votes_of(docs, id_col, text_col)
    one = ["doc_id", "text_hash", "template"]
    marks = F.col("template") < 0
    w = Window.partitionBy(*one).orderBy("diagonal")
    step = F.when(F.col("exact") | marks | (F.col("diagonal") - F.lag("diagonal").over(w) > max_shift) | F.lag("diagonal").over(w).isNull(), 1).otherwise(0)
    spans = (
        votes.withColumn("step", step)
        .withColumn("span", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*one, "label", "exact", "pairs", "span")
        # repeated rows hit the same places; the marker tells how often a row is there
        .agg(F.max(F.when(marks, F.col("n"))).alias("copies"), F.bit_count(F.bit_or("places")).alias("covered"), F.min("diagonal").alias("start"), F.collect_list(F.struct("diagonal", "places")).alias("diagonals"))
    )
    # few spans cover enough places to be worth a chain
    enough = F.col("covered") >= min_share * F.col("pairs")
    length = F.when(F.col("exact"), F.col("covered")).when(enough & ~marks, chain_length(F.col("diagonals"), F.col("pairs"))).otherwise(0)
    spans = spans.withColumn("share", length / F.col("pairs"))
    base = F.col("exact") & (F.col("share") >= 1)
    found = base | (~F.col("exact") & ~marks & (F.col("share") >= min_share))
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    return spans.groupBy("doc_id", "text_hash").agg(
        F.max("copies").alias("copies"),
        F.max(F.when(marks, F.col("start"))).cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """A row for each row of the table: id, counts, labels and score."""
    found = labelled(docs, id_col, text_col, **limits)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies", "text_hash")
