"""Licence scan by diagonal voting, in DataFrame operations only.

All rolling GRAM-word hashes of all texts are joined to the positions of the same
hashes in licence templates. A match votes for the diagonal ``position in text -
position in template``; votes are aggregated by diagonal, diagonals close to each
other (words added or left out) are merged, and a merged span is verified: enough of
the template's grams, the gram that tells it from its relatives, and no more than
twice the template's length.

Scale: the templates are a constant of this module (some hundred grams), so the join
is a broadcast inside the scan's stage and texts are never shuffled. Only hits are,
after rows of the same place collapse; a hot phrase spreads by document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import ship

GRAM = 3
#: Share of a template's grams that its span must have, and the shift between diagonals that are merged.
COVERAGE, SHIFT = 0.6, 5
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: (label, gram that must be among the hits or "", text), all in normalised words.
TEMPLATES = [
    ("agpl-3", "gnu affero general", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "", "licensed under the apache license version 2 0"),
    ("apache-2", "version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("boost", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by", "attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "waived all copyright", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "either version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "copy modify and", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-3", "gnu lesser general", "licensed under the gnu lesser general public license version 3"),
    ("mit", "", "released under the mit license"),
    ("mit", "any person obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "", "this is free and unencumbered software released into the public domain"),
    ("zlib", "be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]


def template_grams() -> list[dict]:
    """One entry per gram of each phrase and template: tid, base, label, gram, tpos, size (grams of the whole), must (of this gram), needs (any must)."""
    out = []
    for tid, (base, label, must, text) in enumerate([(True, label, "", text) for label, text in BASE] + [(False, *t) for t in TEMPLATES]):
        w = text.split()
        grams = [" ".join(w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
        out += [{"tid": tid, "base": base, "label": label, "gram": g, "tpos": i, "size": len(grams), "must": g == must, "needs": bool(must)} for i, g in enumerate(grams)]
    return out


def _templates(spark: SparkSession) -> DataFrame:
    kind = "array<struct<tid:int,base:boolean,label:string,gram:string,tpos:int,size:int,must:boolean,needs:boolean>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(template_grams())), kind)).alias("t")).select("t.*")
    return rows.withColumn("h", F.xxhash64("gram")).withColumn("grams", F.array("gram")).drop("gram")


def _words(text: Column) -> Column:
    # Beyond A-Z, lower() turns only two characters into ASCII (U+0130, U+212A); translate() would be exact but several times slower.
    safe = F.when(text.rlike("[İK]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.array_remove(F.split(safe, SEPARATOR), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (array of first word, end word, label, coverage).

    Null texts count as empty: no words, no places, empty label strings, score 0. Rows
    that repeat, also those that repeat an id with another text or have a null id, get
    the result of their own text. The score is 1 with a base phrase, else the best
    coverage of a verified span, else 0.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Zipping the list with itself shifted keeps each row to its own words; rows that carried the list would make long texts quadratic.
    listed = src.select("id", F.xxhash64("text").alias("th"), _words(F.col("text")).alias("w"))
    shifted = F.arrays_zip(*[(F.col("w") if not i else F.slice("w", F.lit(i + 1), F.size("w"))).alias(f"w{i}") for i in range(GRAM)])
    zipped = listed.select("id", "th", F.posexplode_outer(shifted).alias("pos", "z"))
    rolled = zipped.select("id", "th", F.coalesce("pos", F.lit(-1)).alias("pos"), F.col("z.w1").isNull().alias("end"), F.concat_ws(" ", *[F.col(f"z.w{i}") for i in range(GRAM)]).alias("gram"))
    rolled = rolled.withColumn("hash", F.xxhash64("gram"))

    # The hash finds, the words themselves decide; array_contains keeps that out of the join's key. Each text's last word
    # stays as well and stands for the text: it has the number of words, and how many rows share id and text.
    t = F.broadcast(_templates(docs.sparkSession))
    met = rolled.join(t, (F.col("hash") == t.h) & F.array_contains("grams", F.col("gram")), "left").where("end or tid is not null")
    hits = met.groupBy("id", "th", "tid", "base", "label", "size", "needs", "must", "pos", (F.col("pos") - F.col("tpos")).alias("diagonal"), F.when(F.col("tid").isNull(), F.col("end")).alias("end"))
    hits = hits.agg(F.count(F.lit(1)).alias("rows")).repartition("id", "th")  # all that follows is grouped by these two and more
    votes = hits.groupBy("id", "th", "tid", "base", "label", "size", "needs", "diagonal", "end").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("must").alias("must"), F.max("rows").alias("rows"))

    # Base phrases and templates go the same way, so the scan runs once; a phrase's diagonals are never merged.
    of = Window.partitionBy("id", "th", "tid").orderBy("diagonal")  # at most one document's own diagonals
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(of) > SHIFT), F.lit(True)).cast("int")
    spans = (
        votes.withColumn("new", apart)
        .withColumn("run", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "th", "tid", "base", "label", "size", "needs", "run", "end")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("must").alias("must"), F.max("rows").alias("rows"))
        .withColumn("coverage", F.when(F.col("end").isNull(), F.least(F.lit(1.0), F.col("votes") / F.col("size"))))
        .where(F.col("end") | F.when(F.col("base"), F.col("votes") == F.col("size")).otherwise((F.col("coverage") >= COVERAGE) & (F.col("must") | ~F.col("needs")) & (F.col("hi") - F.col("lo") + 1 <= 2 * F.col("size") + GRAM)))
    )
    per = spans.groupBy("id", "th").agg(
        F.max(F.when(F.col("end"), F.col("lo") + 1)).cast("long").alias("n_words"),
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.round(F.coalesce(F.max("coverage"), F.lit(0.0)), 6).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("label").isNotNull(), F.struct("lo", (F.col("hi") + GRAM).alias("end"), "label", "coverage")))).alias("spans"),
        F.max(F.when(F.col("end"), F.col("rows"))).alias("rows"),
    )
    out = per.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle(words: str) -> str:
    """The same scan as DuckDB SQL, by joining the grams themselves; ``words`` is SQL for the word list of ``text``."""
    b = lambda x: str(x).lower()
    rows = ", ".join(f"({g['tid']}, {b(g['base'])}, '{g['label']}', '{g['gram']}', {g['tpos']}, {g['size']}, {b(g['must'])}, {b(g['needs'])})" for g in template_grams())
    return f"""
WITH t(tid, base, label, gram, tpos, size, must, needs) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, array_to_string(w[i : i + {GRAM - 1}], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM d WHERE len(w) >= {GRAM})),
v AS (SELECT rid, tid, base, label, size, needs, pos - tpos AS dg, count(*) AS votes, min(pos) AS lo, max(pos) AS hi, bool_or(must) AS must
      FROM g JOIN t USING (gram) GROUP BY ALL),
r AS (SELECT *, sum(nw) OVER (PARTITION BY rid, tid ORDER BY dg) AS run FROM (
      SELECT *, CASE WHEN dg - lag(dg) OVER (PARTITION BY rid, tid ORDER BY dg) <= {SHIFT} THEN 0 ELSE 1 END AS nw FROM v WHERE NOT base)),
m AS (SELECT rid, label, least(1.0, sum(votes)::DOUBLE / size) AS coverage, bool_or(must) AS must, needs, min(lo) AS lo, max(hi) AS hi, size FROM r GROUP BY rid, tid, label, size, needs, run),
f AS (SELECT rid, true AS base, label, lo, 1.0::DOUBLE AS coverage FROM v WHERE base AND votes = size
      UNION ALL SELECT rid, false, label, lo, coverage FROM m WHERE coverage >= {COVERAGE} AND (must OR NOT needs) AND hi - lo + 1 <= 2 * size + {GRAM}),
p AS (SELECT rid, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN p USING (rid)"""
