"""License scans in built-in expressions: fixed phrases, and an exact set-similarity join with license templates.

A template is a set of words. It is met if ``reach`` consecutive words of a text, over any line breaks, hold at least
``CONTAINED`` of its words. Texts are cut into blocks of words that overlap by the longest reach, so each such window is
whole in some block; a block is a set of words with their places. Words are ordered by their frequency in the whole corpus, rarest first. A block can only reach
the threshold if it holds one of the template's few rarest words (prefix filter), holds enough words of any template
(length filter), and has enough words left behind the first common one on both sides (positional filter). What passes
is verified window by window, so the join is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents, let, staged

#: All ASCII characters that aren't letters or digits separate words; a class of the text after lower-casing A-Z.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before lower-casing.
BETWEEN_ANY = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that stand for a label wherever their words are consecutive.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's words that a block must hold, in per cent.
CONTAINED = 80
# Short notices and opening sentences of public licenses, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
#: Templates are broadcast and their words stand in expressions, so their number is bounded.
MOST_TEMPLATES = 1_000


def lowered(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Label and distinct words of each template."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    cut = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    return [(label, sorted(set(text.lower().translate(cut).split()))) for label, text in templates]


def reach(text: str) -> int:
    """Consecutive words of a text among which a template's are looked for: its own length, half of it and two more."""
    length = len(text.translate(str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})).split())
    return length + length // 2 + 2


def needed(words: list[str]) -> int:
    """Words that a window must share with a template of these."""
    return -(-CONTAINED * len(words) // 100)


def frequency_order(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Places of the templates' words by their number of occurrences in all texts, rarest first, then by the word.

    Words are counted where the texts are; one partial count for each template word and task is shuffled.
    """
    found = F.filter(F.split(lowered(F.coalesce(F.col(text), F.lit(""))), BETWEEN), lambda w: w.isin(vocabulary))
    counts = {r["word"]: r["count"] for r in docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def phrase_places(text: Column) -> Column:
    """First word (from 0) and label of every place where a phrase's words are consecutive.

    A pattern over the text decides which texts have any; only those are cut into words.
    """
    gate = "(?i)(" + "|".join(p.replace(" ", BETWEEN_ANY) for p in PHRASES) + ")"

    def found(ws: Column) -> Column:
        def at(phrase: str) -> Column:
            parts = phrase.split()
            here = lambda i: F.reduce(F.array(*[F.coalesce(F.try_element_at(ws, i + k), F.lit("")) == p for k, p in enumerate(parts)]), F.lit(True), lambda a, x: a & x)
            return F.transform(F.filter(F.sequence(F.lit(1), F.size(ws)), here), lambda i: F.struct((i - 1).alias("at"), F.lit(PHRASES[phrase]).alias("label")))

        return F.when(F.size(ws) > 0, F.concat(*[at(p) for p in PHRASES])).otherwise(F.array().cast("array<struct<at:int,label:string>>"))

    ws = F.filter(F.split(lowered(text), BETWEEN), lambda w: w != "")
    return F.when(text.rlike(gate), let(ws, found)).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``key``, ``n_words``, ``places`` of phrases, ``found`` (label and containment of templates) for each row.

    A null text is empty: no words, no places. Repeated rows are scanned each by itself; extra columns are ignored; an
    empty table gives no rows. Blocks have a fixed number of words, however long a text or its lines are.
    """
    templates = TEMPLATES if templates is None else templates
    known, reaches = template_words(templates), [reach(t) for _, t in templates]
    stride = max(reaches)
    order = frequency_order(docs, text, sorted({w for _, ws in known for w in ws}))
    index, rows = [], []
    for number, (label, ws) in enumerate(known):
        ws = sorted(ws, key=order.get)
        rows.append((number, label, ws, len(ws), needed(ws), reaches[number]))
        index += [(w, number, i) for i, w in enumerate(ws[: len(ws) - needed(ws) + 1])]
    prefix, least = sorted({w for w, _, _ in index}), min(r[4] for r in rows)
    value = F.coalesce(F.col(text), F.lit(""))

    def block(ws: Column, k: Column) -> Column:
        """Template words, and their places, among the words from the k-th stride on."""
        placed = F.transform(F.slice(ws, k * stride + 1, F.lit(2 * stride)), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
        return F.filter(placed, lambda h: h["word"].isin(list(order)))

    distinct = lambda hits: F.array_distinct(F.transform(hits, lambda h: h["word"]))
    able = lambda b: F.exists(b, lambda h: h["word"].isin(prefix)) & (F.size(distinct(b)) >= least)
    every = F.filter(F.split(lowered(value), BETWEEN), lambda w: w != "")
    starts = lambda ws: F.sequence(F.lit(0), F.floor(F.size(ws) / stride).cast("int"))
    parts = let(every, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.filter(F.transform(starts(ws), lambda k: block(ws, k)), able).alias("blocks")))
    read = staged(docs.select(F.col(key).alias("key"), phrase_places(value).alias("places"), parts.alias("p")).select("key", "places", "p.*").withColumn("row", F.monotonically_increasing_id()))

    spark = docs.sparkSession
    by_word = spark.createDataFrame(index, "word string, template int, i int")
    by_template = spark.createDataFrame(rows, "template int, label string, of array<string>, size int, need int, reach int")
    # a word's place by frequency, from a map literal of the templates' words
    places = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    blocks = read.select("row", F.posexplode("blocks").alias("block", "hits")).withColumn("words", distinct(F.col("hits")))
    ordered = F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(places, w).alias("o"), w.alias("word"))))
    words = blocks.select("row", "block", F.size("words").alias("n"), F.posexplode(ordered).alias("j", "w")).select("row", "block", "n", "j", "w.word")
    met = words.join(F.broadcast(by_word), "word").groupBy("row", "block", "n", "template").agg(F.min(F.struct("i", "j")).alias("first"))
    pairs = met.join(F.broadcast(by_template), "template").where((F.col("n") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("first.i") - 1, F.col("n") - F.col("first.j") - 1) >= F.col("need")))
    window = lambda h: F.filter("hits", lambda x: (x["at"] >= h["at"]) & (x["at"] < h["at"] + F.col("reach")))
    shared = F.array_max(F.transform("hits", lambda h: F.size(F.array_intersect(F.transform(window(h), lambda x: x["word"]), F.col("of")))))
    verified = pairs.join(blocks, ["row", "block"]).withColumn("shared", shared).where("shared >= need")
    found = verified.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max(F.col("shared") / F.col("size")).alias("containment"))
    return read.join(staged(found), "row", "left").select(F.col("key").alias(key), "n_words", "places", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    starts = F.transform("places", lambda p: p["at"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("labels"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("containment")).alias("score"),
    )


def _sql() -> str:
    known = template_words(TEMPLATES)
    words = ", ".join(f"({i}, '{label}', '{w}', {len(ws)}, {needed(ws)})" for i, (label, ws) in enumerate(known) for w in ws)
    places = " UNION ALL ".join(
        f"SELECT row_id, i - 1 AS pos, '{label}' AS label FROM (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH t(template, label, word, size, need) AS (VALUES {words}),
x AS (SELECT row_number() OVER () AS row_id, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
d AS (SELECT row_id, doc_id, low, list_filter(regexp_split_to_array(low, '{BETWEEN}'), lambda v: v <> '') AS w FROM x),
line AS (SELECT row_id, unnest(string_split(low, chr(10))) AS line, unnest(range(len(string_split(low, chr(10))))) AS n FROM x),
lw AS (SELECT DISTINCT row_id, n, unnest(regexp_split_to_array(line, '{BETWEEN}')) AS word FROM line),
c AS (SELECT row_id, n, template, label, size, need, count(*) AS shared FROM lw JOIN t USING (word) GROUP BY ALL HAVING count(*) >= need),
f AS (SELECT row_id, list(DISTINCT label) AS labels, max(shared / size) AS containment FROM c GROUP BY row_id),
p AS ({places}),
b AS (SELECT row_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS labels FROM p GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.containment, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (row_id) LEFT JOIN f USING (row_id)"""


QUERIES = {"op7_license_scan": op7_license_scan}
SQL = {"op7_license_scan": _sql()}
