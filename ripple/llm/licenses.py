"""License scans (operator 3); DataFrame functions only.

Texts are read as words and cut into overlapping windows of WINDOW words, STEP
words apart; templates into windows at every word.  A window's MinHash has BANDS
bands of one row over its SHINGLE-word runs.  A run of WINDOW - STEP + 1 = 6 words
lies whole in some window, so a notice of five words or more has a window of which
its runs are at least half, and meets it in some band with a probability of
1 - 2 ** -BANDS = 99.98 %; a copy of ten words and more has a window that equals
one of the template's and meets it always.  Candidates are verified exactly: the share
of the template's five-word shingles that occur in the whole document.

Only documents with a band in common are written out and looked at again; their
bands go through the join without their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm.common import quote, written
from ripple.llm.winnow import _fitting, _upto, words

WINDOW, STEP, SHINGLE, BANDS = 8, 3, 3, 12
VERIFY, LEAST = 5, 0.8
#: So many template bands at most stand as a set in the query's plan; more of them are joined.
PLAN_BANDS = 20_000

# Notices by which texts state their licence.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "GPL-2.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided as is",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSL-1.0": "Boost Software License, Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def _bands(w: Column, step: int) -> Column:
    """All bands of all windows of the words; null-free, empty for fewer than SHINGLE words."""
    width = WINDOW - SHINGLE + 1
    # The constants only have to differ at random; they follow a rule.
    salts = [((j * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) - (1 << 63) for j in range(BANDS)]
    # The first window always is, further ones until one reaches the last run.
    n = F.when(F.size(w) > 0, F.greatest(F.ceil((F.size(w) - width) / step) + 1, F.lit(1)).cast("int")).otherwise(0)
    starts = _upto(n)
    parts = []
    for salt in salts:
        parts.append(_least(w, starts, step, width, salt))
    return F.concat(*parts)


def _least(h: Column, starts: Column, step: int, width: int, salt: int) -> Column:
    """For each window its run hash that is nearest to ``salt``."""
    return F.transform(starts, lambda i: F.least(*[F.get(h, i * step + t).bitwiseXOR(F.lit(salt)) for t in range(width)]))


def _runs(w: Column) -> Column:
    return F.transform(_upto(F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))


def _shingles(w: Column) -> Column:
    """The runs of VERIFY words, joined by spaces, in order."""
    return F.transform(_upto(F.size(w) - (VERIFY - 1)), lambda i: F.array_join(F.slice(w, i + 1, VERIFY), " "))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of the given or the built-in notices."""
    return spark.createDataFrame(list((texts or TEMPLATES).items()), "license string, text string")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The licences that documents state: (key, license, n_shingles, n_found, containment, first_char).

    ``known`` has (license, text), a text of at least VERIFY words each; shorter
    ones are passed over.  One row for each document and template of whose
    distinct five-word shingles the share ``least`` or more occurs in the
    document; first_char is where the first of them begins in the document's
    words joined by spaces, from 1.  Words are runs of a-z, 0-9 and characters
    beyond ASCII, A-Z lower-cased.  Null and empty texts state nothing; equal
    rows give one result, and of templates with one name and text one counts.
    Other columns are not read; empty tables on either side give no rows.
    """
    # Written, as the optimizer would copy these expressions into every filter on what they give.
    forms = written(known.select("license", words(F.col("text")).alias("w")).distinct(), "templates").where((F.size("w") >= VERIFY) & F.col("license").isNotNull())
    forms = forms.withColumn("h", _runs(F.col("w")))
    forms = written(forms.select("license", F.array_distinct(_shingles(F.col("w"))).alias("shingles"), F.array_distinct(_bands(F.col("h"), 1)).alias("bands")), "templates")
    forms = forms.select(F.xxhash64("license", "shingles").alias("form"), "license", "shingles", "bands")
    bands = forms.select(F.explode("bands").alias("band"), "form").distinct()

    read = docs.select(F.col(quote(key)).alias("id"), F.xxhash64(quote(text)).alias("text_hash"), words(F.col(quote(text))).alias("w")).withColumn("h", _runs(F.col("w")))
    read = read.select("id", "text_hash", "w", _bands(F.col("h"), STEP).alias("bands"))
    few = [r[0] for r in bands.select("band").distinct().limit(PLAN_BANDS + 1).collect()]
    if len(few) <= PLAN_BANDS:
        listed = ", ".join(f"{x}L" if x != -(1 << 63) else "bigint('-9223372036854775808')" for x in few) or "NULL"
        met = F.array_distinct(F.expr(f"filter(bands, b -> b IN ({listed}))"))
        # Documents with a band in common, few of all; a filter on ``met`` would have it computed twice.
        near = written(read.select("id", "text_hash", "w", F.explode(F.filter(F.array(met), lambda b: F.size(b) > 0)).alias("bands")), "near")
        hits = near.select("id", "text_hash", F.explode("bands").alias("band"))
    else:
        near = read.select("id", "text_hash", "w")
        hits = read.select("id", "text_hash", F.explode(F.array_distinct("bands")).alias("band"))
    met = hits.join(_fitting(bands, F.lit(16)), "band").groupBy(F.col("id").alias("at"), F.col("text_hash").alias("of")).agg(F.collect_set("form").alias("forms"))
    found = near.dropDuplicates(["id", "text_hash"]) if len(few) <= PLAN_BANDS else near
    found = found.join(met, F.col("id").eqNullSafe(F.col("at")) & (F.col("text_hash") == F.col("of")))
    found = found.select("id", "text_hash", "w", _shingles(F.col("w")).alias("has"), F.explode("forms").alias("form"))
    size = F.octet_length(F.array_join("shingles", " ")) + 16 * F.size("shingles")
    found = found.join(_fitting(forms.select("form", "license", "shingles"), size), "form")
    held = F.array_intersect("has", "shingles")  # in the order of the document
    found = found.select("id", "text_hash", "license", "form", "w", F.size("shingles").cast("long").alias("n_shingles"), held.alias("held"))
    found = found.withColumn("n_found", F.size("held").cast("long")).withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= least)
    padded = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    first = F.instr(padded, F.concat(F.lit(" "), F.get("held", F.lit(0)), F.lit(" "))).cast("long")
    found = found.select("id", "text_hash", "license", "n_shingles", "n_found", "containment", first.alias("first_char"), "form")
    return found.dropDuplicates(["id", "text_hash", "form"]).select(F.col("id").alias(key), "license", "n_shingles", "n_found", "containment", "first_char")


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = (
    "WITH t AS (SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES "
    + ", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in TEMPLATES.items())
    + r""") AS x(license, text)
), s AS (
  SELECT DISTINCT license, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT license, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t)
), d AS (
  SELECT doc_id, ' ' || array_to_string(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') || ' ' AS norm FROM documents
)
SELECT doc_id, license, count(*) AS n_shingles, count(*) FILTER (WHERE p > 0) AS n_found,
       CAST(count(*) FILTER (WHERE p > 0) AS DOUBLE) / count(*) AS containment, min(p) FILTER (WHERE p > 0) AS first_char
FROM (SELECT doc_id, license, strpos(norm, ' ' || shingle || ' ') AS p FROM d, s) GROUP BY doc_id, license
HAVING count(*) FILTER (WHERE p > 0) >= 0.8 * count(*)
"""
)
