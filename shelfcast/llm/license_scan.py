"""License scan by diagonal voting, with DataFrame functions alone.

Every text is cut into words and rolling word k-grams (two words for short phrases, four for long
notices), each hashed. Spark joins all hashes to the positions of the templates' k-grams. A match
votes for its diagonal, the place in the text less the place in the template; diagonals of one
text and template that are near each other are merged, which bridges inserted or missing words, and
the merged span is verified: enough of the template's k-grams, in a span of about its length.

The templates are fixed and few (``TEMPLATES``), so their positions may be broadcast. What is
shuffled is only what matches. Votes are kept by the hash of the text, so that copies of a text
vote once.

Defined cases: a null text is empty; a text without words has no place and no label; equal rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.tables import stage, table

#: Words that may be missing or added between merged diagonals.
SLACK = 4
#: Templates of fewer words are phrases: two-grams, and every one of them must be found.
LONG, SHORT_GRAM, LONG_GRAM = 12, 2, 4
COVERAGE = 0.6
#: Texts with findings that may be broadcast: some 30 MB.
BROADCAST_ROWS = 300_000

# Fixed values: (label, base, text). Openings of public licenses and the lines that name them.
TEMPLATES = (
    ("gpl", True, "gnu general public license"),
    ("apache", True, "apache license"),
    ("cc-by", True, "cc by"),
    ("mit", True, "mit license"),
    ("apache-2.0", False, "apache license version 2 0"),
    ("gpl-2.0", False, "gnu general public license version 2"),
    ("gpl-3.0", False, "gnu general public license version 3"),
    ("lgpl", False, "gnu lesser general public license"),
    ("agpl", False, "gnu affero general public license"),
    ("cc-by-nc", False, "cc by nc"),
    ("cc-by-sa", False, "cc by sa"),
    ("cc-by-nd", False, "cc by nd"),
    ("bsd", False, "bsd license"),
    ("mpl", False, "mozilla public license"),
    (
        "mit-notice",
        False,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "apache-2.0-notice",
        False,
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "gpl-notice",
        False,
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    (
        "bsd-notice",
        False,
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    ("mpl-2.0-notice", False, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-notice", False, "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit"),
)
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in lower case. The two letters beyond ASCII that ``lower`` would make ASCII are replaced before."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")), F.lit("İ"), F.lit("å"))
    return F.array_remove(F.split(F.lower(plain), _BREAK), "")


def _rolled(items: Column, apart: int) -> Column:
    """Hashes of each item and the one ``apart`` behind it."""
    n = F.size(items) - apart
    pair = F.zip_with(items, F.slice(items, apart + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.slice(pair, 1, F.greatest(n, F.lit(0)))


def grams(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the text, by (k, place, gram)."""
    kept = [c for c in df.columns if c != text]
    two = df.withColumn("__words", words(F.col(text))).select(*kept, "__words").withColumn("__two", _rolled(F.col("__words"), 1)).drop("__words")
    both = F.array(F.struct(F.lit(SHORT_GRAM).alias("k"), F.col("__two").alias("grams")), F.struct(F.lit(LONG_GRAM).alias("k"), _rolled(F.col("__two"), 2).alias("grams")))
    each = two.select(*kept, F.explode(both).alias("__by"))
    return each.select(*kept, F.col("__by.k").alias("k"), F.posexplode("__by.grams").alias("place", "gram"))


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """(template, label, base, k, at, gram, n_grams, least) of all templates: a few hundred rows."""
    rows = []
    for number, (label, base, text) in enumerate(templates):
        n = len(text.split())
        k = LONG_GRAM if n >= LONG else SHORT_GRAM
        rows.append((number, label, base, text, k, n - k + 1, COVERAGE if n >= LONG else 1.0, n))
    given = spark.createDataFrame(rows, "template int, label string, base boolean, text string, own_k int, n_grams int, least double, n_words int")
    return grams(given, "text").where("k = own_k").withColumnRenamed("place", "at").drop("own_k")


def spans(texts: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """(text_hash, label, base, first_word, n_span, coverage) of the verified spans of each distinct text."""
    found = grams(texts.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), text), text)
    about = ["template", "label", "base", "n_grams", "least", "n_words", "k"]
    votes = found.join(F.broadcast(templates), ["k", "gram"]).select("text_hash", *about, (F.col("place") - F.col("at")).alias("diagonal"), "at").distinct()
    lines = votes.groupBy("text_hash", *about, "diagonal").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("at").alias("ats"))
    lines = stage(lines, "diagonals")  # only what matches; the corpus is cut into words once
    exact = lines.where((F.col("least") == 1) & (F.col("n") == F.col("n_grams"))).select("text_hash", "label", "base", F.col("diagonal").alias("first_word"), F.col("n_words").alias("n_span"), F.lit(1.0).alias("coverage"))
    order = Window.partitionBy("text_hash", "template").orderBy("diagonal")
    merged = lines.where("least < 1").withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > SLACK).cast("int")).withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a position of the template counts once, however many merged diagonals hit it
    long = merged.withColumn("at", F.explode("ats")).groupBy("text_hash", *about, "cluster").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("first_word"), F.max(F.col("diagonal") + F.col("high") + F.col("k")).alias("last"), F.count_distinct("at").alias("n")
    )
    coverage = F.col("n") / F.col("n_grams")
    long = long.withColumn("n_span", F.col("last") - F.col("first_word")).where((coverage >= F.col("least")) & (2 * F.col("n_span") <= 3 * F.col("n_words")))
    return exact.unionByName(long.select("text_hash", "label", "base", "first_word", "n_span", coverage.alias("coverage")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    verified = spans(source, template_grams(docs.sparkSession, templates))
    mine = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = verified.groupBy("text_hash").agg(
        F.count_if(mine).alias("n_base"), F.min(F.when(mine, F.col("first_word"))).cast("long").alias("first_word"), F.max(F.when(mine, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(mine, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    # written, so that Spark may split the rows of a text with very many copies, or send the few results to all
    by_text = stage(by_text, "licenses")
    by_text = F.broadcast(by_text) if by_text.count() <= BROADCAST_ROWS else by_text
    rows = source.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"))
    found = rows.join(by_text, "text_hash", "left")
    return found.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({i}, '{label}', {base}, '{text}')" for i, (label, base, text) in enumerate(TEMPLATES))
_GRAM = lambda ws: f"array_to_string({ws}[s + 1 : s + k], ' ')"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tt AS (SELECT template, label, base, string_split(text, ' ') AS ws, CASE WHEN len(string_split(text, ' ')) >= {LONG} THEN {LONG_GRAM} ELSE {SHORT_GRAM} END AS k FROM (VALUES {_VALUES}) AS v(template, label, base, text)),
tg AS (SELECT template, label, base, len(ws) AS n_words, k, s AS tp, {_GRAM("ws")} AS gram, len(ws) - k + 1 AS n_grams FROM (SELECT *, unnest(range(0, len(ws) - k + 1)) AS s FROM tt)),
dg AS (SELECT r, k, s AS place, {_GRAM("ws")} AS gram FROM (SELECT r, ws, k, unnest(range(0, len(ws) - k + 1)) AS s FROM d, (VALUES ({SHORT_GRAM}), ({LONG_GRAM})) AS g(k) WHERE len(ws) >= k)),
li AS (SELECT r, template, label, base, n_grams, n_words, k, place - tp AS diagonal, count(*) AS n, min(tp) AS low, max(tp) AS high, list(DISTINCT tp) AS ats FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
ex AS (SELECT r, label, base, diagonal AS first_word, CAST(1 AS DOUBLE) AS coverage FROM li WHERE n_words < {LONG} AND n = n_grams),
mg AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN diagonal - lag(diagonal, 1, {-(1 << 30)}) OVER (PARTITION BY r, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS fresh FROM li WHERE n_words >= {LONG})),
lo AS (SELECT r, template, label, base, n_words, n_grams, min(diagonal + low) AS first_word, max(diagonal + high + k) AS l, count(DISTINCT tp) AS n FROM (SELECT *, unnest(ats) AS tp FROM mg) GROUP BY r, template, label, base, n_words, n_grams, k, cluster),
al AS (SELECT * FROM ex UNION ALL SELECT r, label, base, first_word, n / n_grams FROM lo WHERE n / n_grams >= {COVERAGE} AND 2 * (l - first_word) <= 3 * n_words),
su AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first_word) FILTER (WHERE base) AS first_word, max(first_word) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM al GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN su USING (r)"""
