"""License scans by diagonal voting.

Every rolling word 2-gram of a document joins, by hash, the places where license templates have it. A hit at word p of
the document and word t of the template votes for the diagonal p - t: the place where the template would begin.
Votes are counted by document, template and diagonal. Short templates (phrases) count where a diagonal has all their
2-grams. For long ones (passages) a diagonal merges with those up to SLACK behind it, as a few words more or fewer make
them, into one span. A span is then verified: its hits are followed in the order of the document's words, and only
2-grams that also rise in the template count. It stands if they make up enough of the passage, and if it has more of
them than any other span that begins within SLACK. The words themselves are compared, not only hashes.

The passages are characteristic sentences of well-known licenses, not whole texts. Their 2-grams of two common words do
not vote and do not count towards a share.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WORD, few_files, words_of

#: The phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: More phrases and their labels; they feed labels, not the base columns. Where several begin at a word, the longest counts. A version may follow.
SHORT = {
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
}

#: Passages of well-known license texts and the labels they stand for.
PASSAGES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

#: 2-grams of two such words are in no template's list: they would vote on a diagonal wherever prose has them.
COMMON = frozenset("a an and any are as at by for from in is it not of on or that the this to was with you".split())

GRAM, SLACK, ENOUGH = 2, 4, 0.6


def _template_rows(phrases: dict[str, str], passages: dict[str, str], short: dict[str, str]) -> list[tuple[int, str, bool, bool, int, str, str]]:
    """(template, label, is a phrase, feeds the base columns, place of the 2-gram, its two words)."""
    rows = []
    for number, (text, label, phrase, base) in enumerate([*((p, lab, True, True) for p, lab in phrases.items()), *((p, lab, False, False) for lab, p in passages.items()), *((p, lab, True, False) for p, lab in short.items())]):
        words = [w for w in re.split(NOT_WORD, text.lower()) if w]
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text}")
        rows += [(number, label, phrase, base, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if phrase or not (a in COMMON and b in COMMON)]
    return rows


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, passages: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", short: dict[str, str] | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: all places of phrases, short ones aside; first_word, last_word: the smallest and largest word at which one starts (null: none).
    labels: of phrases, short ones too, and passages. score: the largest share of a template found (1 for a phrase, else 0 to 1).
    spans: of (label, start, end word, share), sorted. A null or empty text has no words and no spans. A row that
    repeats comes back as often. Other columns are left out; they may have any name.
    """
    spark = docs.sparkSession
    templates = _template_rows(phrases if phrases is not None else PHRASES, passages if passages is not None else PASSAGES, short if short is not None else SHORT)
    grams = spark.createDataFrame([(*t, sum(x[0] == t[0] for x in templates)) for t in templates], "template int, label string, phrase boolean, base boolean, t_pos int, first string, second string, n_grams int").withColumn("h", F.xxhash64("first", "second"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    n_words = F.size("words")
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(n_words - 1, F.lit(0))).alias("b"))
    # place 0 stands for the document itself, so that one without hits keeps a row
    own = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    rolled = split.select("doc_id", "text_hash", n_words.cast("long").alias("n_words"), F.posexplode(F.concat(own, pairs)).alias("at", "pair"))
    rolled = rolled.select("doc_id", "text_hash", "n_words", "at", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.xxhash64("pair.a", "pair.b").alias("h"))
    same = (F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))
    # the templates are the code's own, a few hundred rows
    joined = rolled.join(F.broadcast(grams), "h", "left").filter((F.col("at") == 0) | same)
    hits = joined.select("doc_id", "text_hash", "n_words", F.when(F.col("at") > 0, F.col("template")).alias("template"), "label", "phrase", "base", "n_grams", "t_pos", (F.col("at") - 1 - F.col("t_pos")).cast("long").alias("diagonal"))
    # few rows are left; one exchange serves all that follows
    hits = hits.repartition("doc_id", "text_hash")

    doc = ["doc_id", "text_hash"]
    by_diagonal = hits.groupBy(*doc, "template", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("votes"), F.max("label").alias("label"), F.max("phrase").alias("phrase"), F.max("base").alias("base"), F.max("n_grams").alias("n_grams"), F.collect_set("t_pos").alias("places"),
    )
    near = lambda before, behind: W.partitionBy(*doc, "template").orderBy("diagonal").rangeBetween(-before, behind)
    # (word of the document, place in the template) of all hits of a span; a phrase's keep to its diagonal
    merged = F.flatten(F.collect_list(F.transform("places", lambda t: F.struct((F.col("diagonal") + t).alias("p"), t.cast("long").alias("t")))).over(near(0, SLACK)))
    only = lambda h: F.col("phrase") & (h["p"] - h["t"] != F.col("diagonal"))
    spans = by_diagonal.withColumn("hits", F.array_sort(F.filter(merged, lambda h: ~only(h))))
    # hits that rise in document and template: how many, the last place in each
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("p"))
    step = lambda s, h: F.when((h["t"] > s["t"]) & (h["p"] > s["p"]), F.struct((s["n"] + 1).alias("n"), h["t"].alias("t"), h["p"].alias("p"))).otherwise(s)
    spans = spans.withColumn("run", F.aggregate("hits", nothing, step)).withColumn("start", F.col("diagonal")).withColumnRenamed("votes", "rows")
    share = F.col("run.n") / F.col("n_grams")
    enough = F.when(F.col("phrase"), share == 1).otherwise(share >= ENOUGH)
    # of spans that begin near each other the fullest, then the first
    rank = F.struct(F.when(enough, F.col("run.n")).otherwise(0).alias("n"), (-F.col("diagonal")).alias("d"))
    spans = spans.withColumn("rank", rank).withColumn("top", F.max("rank").over(near(SLACK, SLACK)))
    sound = enough & (F.col("phrase") | (F.col("rank") == F.col("top")))
    # "cc by" at the start of "cc by nc" is no license of its own
    is_short = F.col("phrase") & ~F.col("base")
    spans = spans.withColumn("sound", sound).withColumn("longest", F.max(F.when(is_short & F.col("sound"), F.col("n_grams"))).over(W.partitionBy(*doc, "start")))
    sound = F.col("sound") & (~is_short | (F.col("n_grams") == F.col("longest")))
    base = sound & F.col("base")
    span = F.struct("label", F.greatest("start", F.lit(0)).alias("start"), (F.col("run.p") + GRAM - 1).alias("end"), F.round(share, 4).alias("share"))
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = spans.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("times"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        listed(F.collect_set(F.when(sound, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(sound, F.round(share, 4))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(sound, span))).alias("spans"),
    )
    again = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")
    found = few_files(found, docs.count())
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans", again).drop("time")


def labelled(scanned: DataFrame, label: str) -> Column:
    """Whether label is among a scan's labels."""
    return F.array_contains(F.split(scanned["labels"], ","), label)
