"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram hash of every text is joined to the positions the same hash has in the license templates. A hit votes
for the diagonal `document position - template position`; votes that follow each other in the text on neighbouring diagonals (a word
more or less shifts one) are merged into one passage, from its first to its last voting word. A passage is verified against its
template: its votes must cover enough of the template, among it the words that tell the license from its relatives, and it may not be
much longer. Of overlapping passages of a text, one that is no better covered than another gives no label. A phrase is found
exactly where all of its k-grams vote for one diagonal.

The template table is a parameter of a checked, fixed size, so it is broadcast; nothing that grows with the corpus is.

Defined cases: a null text is empty (0 words, no labels, score 0); repeated rows give the same result each; a null doc_id is an
id like any other; ties of coverage keep both labels; very long texts are scanned whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_of

K = 3
#: Most k-grams of all templates together; more are refused, since the table is broadcast.
MAX_TEMPLATE_GRAMS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # found only as a whole
    must: str = ""  # words, K at least, that a passage must have


#: Phrases that name a license, and sentences of well-known license texts and notices.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", must="free of charge"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", must="apache license version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", must="gnu general public license"),
    Template("lgpl", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", must="gnu lesser general"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", must="gnu affero general"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", must="mozilla public license"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", must="with or without fee"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", must="attribution 4 0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", must="attribution sharealike 4"),
    Template("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission"),
)


def _words(text):
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def _grams(words):
    """(position, hash) of every k-gram of an array column."""
    grams = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)]))
    return F.slice(grams, F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(0)))


def template_grams(spark: SparkSession, templates: Iterable[Template] = TEMPLATES) -> DataFrame:
    """template, label, phrase, n_grams, n_must, t_pos, gram, must: a row for each k-gram position of each template."""
    rows = [(i, t.label, t.phrase, t.text, t.must) for i, t in enumerate(templates)]
    size = sum(len(r[3].split()) for r in rows)
    if size > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{size} template words; at most {MAX_TEMPLATE_GRAMS} are broadcast")
    t = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string, must string")
    t = t.withColumn("grams", _grams(_words(F.col("text")))).withColumn("needed", _grams(_words(F.col("must"))))
    t = t.withColumn("n_must", F.size(F.array_intersect("grams", "needed"))).withColumn("n_grams", F.size("grams"))
    t = t.select("template", "label", "phrase", "n_grams", "n_must", "needed", F.posexplode("grams").alias("t_pos", "gram"))
    return t.withColumn("must", F.array_contains("needed", F.col("gram"))).drop("needed")


def passages(df: DataFrame, templates: Iterable[Template] = TEMPLATES, min_cover: float = 0.6, max_shift: int = 3, max_gap: int = 12, max_length: float = 1.5) -> DataFrame:
    """doc_id, text_key, label, phrase, start, end, cover: the verified passages of every different text, in words; end is exclusive."""
    # A text is its own key, so repeated ids and repeated rows need no row number; equal texts of one id are scanned once.
    docs = df.select("doc_id", F.xxhash64(text_of()).alias("text_key"), _words(text_of()).alias("words"))
    hits = (
        docs.select("doc_id", "text_key", F.posexplode(_grams(F.col("words"))).alias("pos", "gram"))
        .join(F.broadcast(template_grams(df.sparkSession, templates)), "gram")
        .select("doc_id", "text_key", "template", "label", "phrase", "n_grams", "n_must", "t_pos", "must", "pos", (F.col("pos") - F.col("t_pos")).alias("diag"))
    )
    hits = cut(hits)  # few rows, used twice
    key = ["doc_id", "text_key", "template", "label", "phrase", "n_grams", "n_must"]
    # A diagonal's votes as a set: repeated rows of a document do not vote twice.
    whole = hits.filter("phrase").groupBy(*key, "diag").agg(F.count_distinct("t_pos").alias("votes")).filter(F.col("votes") == F.col("n_grams"))
    whole = whole.select("doc_id", "text_key", "label", "phrase", F.col("diag").alias("start"), (F.col("diag") + F.col("n_grams") + K - 1).alias("end"), F.lit(1.0).alias("cover"))
    # Votes in the order of the text; a jump of the diagonal or a gap begins another passage.
    votes = hits.filter("not phrase").select(*key, "t_pos", "must", "pos", "diag").distinct()
    order = W.partitionBy(*key).orderBy("pos", "t_pos")
    near = (F.abs(F.col("diag") - F.lag("diag").over(order)) <= max_shift) & (F.col("pos") - F.lag("pos").over(order) <= max_gap)
    votes = votes.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("passage", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = votes.groupBy(*key, "passage").agg(F.count_distinct("t_pos").alias("covered"), F.count_distinct(F.when(F.col("must"), F.col("t_pos"))).alias("needed"), F.min("pos").alias("start"), (F.max("pos") + K).alias("end"))
    found = found.withColumn("cover", F.col("covered") / F.col("n_grams"))
    ok = (F.col("cover") >= min_cover) & (F.col("needed") == F.col("n_must")) & (F.col("end") - F.col("start") <= F.lit(max_length) * (F.col("n_grams") + K - 1))
    found = found.filter(ok).select("doc_id", "text_key", "label", "phrase", "start", "end", "cover")
    # Overlapping passages of one text: the best covered stays.
    a, b = found.alias("a"), found.alias("b")
    better = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.cover") < F.col("b.cover"))
    return whole.unionByName(a.join(b, better, "left_anti"))


def license_scan(df: DataFrame, templates: Iterable[Template] = TEMPLATES, min_cover: float = 0.6, max_shift: int = 3) -> DataFrame:
    """A row per input row: n_words, n_base, first_word, last_word, base_labels, labels, passages, score.

    passages has label:start:end of all, in words; score is the share of template k-grams that the best passage covers (1 for a phrase)."""
    docs = df.select("doc_id", F.xxhash64(text_of()).alias("text_key"), _words(text_of()).alias("words"))
    found = passages(df, templates, min_cover, max_shift).withColumn("base_at", F.when(F.col("phrase"), F.col("start")))
    label_list = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = found.groupBy("doc_id", "text_key").agg(
        F.count("base_at").alias("n_base"),
        F.min("base_at").alias("first_word"),
        F.max("base_at").alias("last_word"),
        label_list(F.when(F.col("base_at").isNotNull(), F.col("label"))).alias("base_labels"),
        label_list("label").alias("labels"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "label"))), lambda p: F.concat_ws(":", p["label"], p["start"], p["end"])), ",").alias("passages"),
        F.max("cover").alias("score"),
    )
    d, f = docs.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words")).alias("d"), found.alias("f")
    return d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("passages", F.lit("")).alias("passages"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql(templates: Iterable[Template] = TEMPLATES, min_cover: float = 0.6, max_shift: int = 3, max_gap: int = 12, max_length: float = 1.5) -> str:
    """The same for DuckDB over the view documents, with k-grams compared as text."""
    quote = lambda x: x.replace("'", "''")
    rows = ", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, '{quote(t.text)}', '{quote(t.must)}')" for i, t in enumerate(templates))
    words = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    gram = " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, K))])
    return f"""
WITH t(template, label, phrase, text, must) AS (VALUES {rows}),
tw AS (SELECT template, label, phrase, {words('text')} AS words, ' ' || array_to_string({words('must')}, ' ') || ' ' AS need FROM t),
tp AS (SELECT template, label, phrase, need, len(words) - {K - 1} AS n_grams, unnest(range(len(words))) AS t_pos, unnest(words) AS w FROM tw),
tx AS (SELECT * EXCLUDE w, {gram} AS gram FROM tp WINDOW o AS (PARTITION BY template ORDER BY t_pos)),
ty AS (SELECT *, contains(need, ' ' || gram || ' ') AS must FROM tx WHERE gram IS NOT NULL),
tg AS (SELECT *, count(DISTINCT gram) FILTER (must) OVER (PARTITION BY template) AS n_must FROM ty),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT r, unnest(range(len(words))) AS pos, unnest(words) AS w FROM d),
g AS (SELECT r, pos, {gram} AS gram FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
v AS (SELECT r, template, label, phrase, n_grams, n_must, t_pos, must, pos, pos - t_pos AS diag FROM g JOIN tg USING (gram) WHERE g.gram IS NOT NULL),
b AS (SELECT r, label, true AS phrase, diag AS a, diag + n_grams + {K - 1} AS z, 1.0::DOUBLE AS cover FROM v WHERE phrase GROUP BY r, template, label, n_grams, diag HAVING count(DISTINCT t_pos) = n_grams),
n AS (SELECT *, CASE WHEN abs(diag - lag(diag) OVER o) <= {max_shift} AND pos - lag(pos) OVER o <= {max_gap} THEN 0 ELSE 1 END AS new FROM v WHERE NOT phrase WINDOW o AS (PARTITION BY r, template ORDER BY pos, t_pos)),
s AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY pos, t_pos) AS passage FROM n),
c AS (SELECT r, label, false AS phrase, min(pos) AS a, max(pos) + {K} AS z, count(DISTINCT t_pos) / n_grams AS cover FROM s GROUP BY r, template, label, n_grams, n_must, passage
      HAVING count(DISTINCT t_pos) / n_grams >= {min_cover} AND count(DISTINCT t_pos) FILTER (must) = n_must AND max(pos) + {K} - min(pos) <= {max_length} * (n_grams + {K - 1})),
f AS (FROM b UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.r = c.r AND c.a < x.z AND x.a < c.z AND c.cover < x.cover)),
a AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(a) FILTER (phrase) AS first_word, max(a) FILTER (phrase) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        string_agg(concat(label, ':', a, ':', z), ',' ORDER BY a, z, label) AS passages, max(cover) AS score FROM f GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(passages, '') AS passages, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (r)"""
