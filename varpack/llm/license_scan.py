"""License scan with MinHash bands over overlapping text windows, in DataFrame
functions only.

Words are runs of ASCII letters and digits, lower-cased; a shingle is 5 words in
a row. Templates fall into length classes; the windows of a class are twice as
long as its longest template and overlap by half, so every occurrence lies
wholly inside a window. A window is sketched over those of its shingles that any
template has (other words cannot raise the containment of a template, and
leaving them out keeps the similarity of window and template high), with
``BANDS`` MinHash bands of one row. Similar sets with Jaccard j share a band with
probability 1 - (1 - j) ** BANDS: above 0.9999 from j = 0.25 on, which a window
that holds a template next to three others of its length still reaches.
Retrieved templates are verified by their exact shingle containment.

The text of a document is read and cut into words once, in one projection; only
shingles that some template has leave it, so what is shuffled grows with the
matches. The template tables have a fixed size and are broadcast.

Defined cases: null or empty text matches nothing; texts below 5 words match
nothing; a null id is returned as null; repeated rows give their own result
rows; extra columns are ignored. An empty table, or one without matches, gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
PERCENT = 80
BANDS = 32

# License notices as they are published, by short name.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def words(text: Column) -> Column:
    """Words of a text; an empty text has none."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, n_shingles, span): distinct shingles of each template
    and the power of two that its word count fits in."""
    each = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in templates.items()])
    rows = spark.range(1).select(F.inline(each))
    w = rows.select("license", words(F.col("body")).alias("w")).filter(F.size("w") >= SHINGLE)
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE),
                                            lambda i: F.array_join(F.slice("w", i + 1, SHINGLE), " ")))
    span = F.pow(F.lit(2), F.ceil(F.log2(F.size("w").cast("double")))).cast("int")
    return w.select("license", shingles.alias("shingles"), F.size(shingles).alias("n_shingles"), span.alias("span"))


def band_values(shingles: Column) -> Column:
    """BANDS MinHash values of a set of shingles, one row a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def template_shingles_of(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, pos, shingle) of the shingles that some template has."""
    known = [r.h for r in table.select(F.explode("shingles").alias("s")).select(F.hash(F.substring_index("s", " ", 1), F.element_at(F.split("s", " "), 2)).alias("h")).distinct().collect()]
    w = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = w.select("row", "id", words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    pos = F.filter(F.sequence(F.lit(1), F.size("w") - SHINGLE + 1),
                   lambda i: F.hash(F.element_at("w", i), F.element_at("w", i + 1)).isin(known))
    at = cut.select("row", "id", "w", F.explode(pos).alias("i"))
    found = at.select("row", "id", (F.col("i") - 1).alias("pos"), F.array_join(F.slice("w", F.col("i"), SHINGLE), " ").alias("shingle"))
    universe = table.select(F.explode("shingles").alias("shingle")).distinct()
    return found.join(F.broadcast(universe), "shingle", "left_semi")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and license found: doc_id, license, n_matched (template
    shingles in the best window), n_shingles, first_word (place of the first
    word of the earliest window with that many, counted from 0)."""
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES)
    spans = F.array(*[F.lit(r.span) for r in table.select("span").distinct().collect()])   # one per length class of the templates
    hits = template_shingles_of(docs, table, id_col, text_col)
    # windows of 2 * span words, one every span words: a template of up to span words lies in one of them
    dealt = (hits.withColumn("span", F.explode(spans))
             .withColumn("k", F.floor(F.col("pos") / F.col("span")).cast("int"))
             .withColumn("window", F.explode(F.array_distinct(F.array(F.greatest(F.col("k") - 1, F.lit(0)), F.col("k")))))
             .filter(F.col("pos") + SHINGLE <= (F.col("window") + 2) * F.col("span")))
    windows = (dealt.groupBy("row", "id", "span", "window")
               .agg(F.collect_set("shingle").alias("set"), F.min("pos").alias("first_word")))   # at most 2 * span shingles
    banded = windows.select("*", F.posexplode(band_values(F.col("set"))).alias("band", "value"))
    keys = table.select("license", "span", "shingles", "n_shingles", F.posexplode(band_values(F.col("shingles"))).alias("band", "value"))
    retrieved = banded.join(F.broadcast(keys), ["span", "band", "value"]).dropDuplicates(["row", "window", "license"])
    verified = (retrieved.withColumn("n_matched", F.size(F.array_intersect("set", "shingles")))
                .filter(F.col("n_matched") * 100 >= F.col("n_shingles") * percent))
    best = F.max_by(F.struct("n_matched", "n_shingles", "first_word"), F.struct("n_matched", -F.col("window")))
    return (verified.groupBy("row", "license").agg(F.first("id").alias("doc_id"), best.alias("b"))
            .select("doc_id", "license", "b.n_matched", "b.n_shingles", "b.first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same scan without sketches: exact containment of every template in
    every window."""
    rows = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in templates.items())
    return f"""
WITH t0(license, body) AS (VALUES {rows}),
t1 AS (SELECT license, [x FOR x IN regexp_split_to_array(lower(body), '[^a-z0-9]+') IF x <> ''] AS w FROM t0),
t2 AS (SELECT license, CAST(pow(2, ceil(log2(len(w)))) AS INTEGER) AS span,
              unnest(list_distinct([array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})])) AS shingle FROM t1),
tn AS (SELECT license, count(*) AS n_shingles FROM t2 GROUP BY license),
u AS (SELECT DISTINCT shingle FROM t2),
d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {SHINGLE}], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos FROM d WHERE len(w) >= {SHINGLE})),
h AS (SELECT s.* FROM s SEMI JOIN u USING (shingle)),
k AS (SELECT h.*, span, CAST(floor(pos / span) AS INTEGER) AS k FROM h, (SELECT DISTINCT span FROM t2)),
win AS (SELECT doc_id, pos, shingle, span, k AS win FROM k UNION SELECT doc_id, pos, shingle, span, greatest(k - 1, 0) FROM k),
inw AS (SELECT * FROM win WHERE pos + {SHINGLE} <= (win + 2) * span),
f AS (SELECT doc_id, span, win, min(pos) AS first_word FROM inw GROUP BY ALL),
m AS (SELECT i.doc_id, t2.license, i.span, i.win, count(DISTINCT i.shingle) AS n_matched
      FROM inw i JOIN t2 ON t2.shingle = i.shingle AND t2.span = i.span GROUP BY ALL),
r AS (SELECT m.doc_id, m.license, m.n_matched, tn.n_shingles, f.first_word,
             row_number() OVER (PARTITION BY m.doc_id, m.license ORDER BY m.n_matched DESC, m.win) AS rk
      FROM m JOIN tn USING (license) JOIN f ON f.doc_id = m.doc_id AND f.span = m.span AND f.win = m.win
      WHERE m.n_matched * 100 >= tn.n_shingles * {percent})
SELECT doc_id, license, CAST(n_matched AS INTEGER) AS n_matched, CAST(n_shingles AS INTEGER) AS n_shingles,
       CAST(first_word AS INTEGER) AS first_word FROM r WHERE rk = 1
"""
