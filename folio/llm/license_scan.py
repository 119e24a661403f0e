"""Licence scans over whole texts, in DataFrame functions alone.

Base phrases are counted where their words stand consecutively. On top of that, every
text block is joined with licence templates by exact containment. A block is a run of
WIDTH words that begins at a multiple of STEP, so a notice of up to WIDTH - STEP words
lies in one block as a whole, wherever its lines break. A template's distinct words are
put in order of corpus frequency, rarest first; a block that holds a share T of them must
hold one of its first |template| - ceil(T * |template|) + 1 words (prefix filter), have
that many template words at all (length filter), and the words before and after the
shared one, in that order on both sides, must leave enough (positional filter). What
passes is verified.

The templates are a short fixed list, so they travel as literals and inline tables of
some dozen rows; the corpus is never shuffled but for counts and the few blocks that match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9

#: Phrase, in words, and its label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Words of a block, and between the beginnings of two; no template may have more than WIDTH - STEP words.
WIDTH, STEP = 128, 64

#: Usual notices; label and text.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "free software under the terms of the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"),
)

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lowered, each between single spaces; a null is empty."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(" ")), _NOT_WORD, " ")


def n_words(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1).cast("long")


def starts(words: Column, phrase: str) -> Column:
    """Positions, from 0, where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == p)
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(F.size(words) >= len(parts), found).otherwise(F.array().cast("array<int>"))


def _hit(label: str):
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


def _once(value: Column, use) -> Column:
    """use(value), the value being computed once a row: as a lambda's argument no rewrite copies it into each place of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(s: Column) -> Column:
    return F.split(F.substring(s, F.lit(2), F.length(s) - 2), " ")


def base(docs: DataFrame) -> DataFrame:
    """Adds n_words, hits (array of struct<start, label>) of the base phrases to rows that have a text.

    Positions are sought only in texts that hold a phrase; words are counted in all.
    """

    def scan_one(s: Column) -> Column:
        any_phrase = F.lit(False)
        for phrase, _ in BASE:
            any_phrase = any_phrase | F.contains(s, F.lit(f" {phrase} "))
        hits = lambda w: F.concat(*[F.transform(starts(w, phrase), _hit(label)) for phrase, label in BASE])
        return F.struct(n_words(s).alias("n_words"), F.when(any_phrase, _once(_words(s), hits)).alias("hits"))

    return docs.withColumn("_scan", _once(spaced(F.col("text")), scan_one)).select(*docs.columns, "_scan.n_words", "_scan.hits")


def templates() -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of each template."""
    return [(i, label, list(dict.fromkeys(text.split()))) for i, (label, text) in enumerate(TEMPLATES)]


def needed(n: int) -> int:
    """Words that a block must share with a template of n words."""
    return math.ceil(round(CONTAINMENT * n, 9))


def frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents of the corpus that hold each template word: one row for each word of a fixed list, counted over all rows."""
    vocabulary = sorted({w for _, _, ws in templates() for w in ws})
    held = F.array_intersect(F.split(spaced(F.col("text")), " "), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def _inline(docs: DataFrame, columns: str, rows: list[tuple[str, ...]]) -> DataFrame:
    """A table of SQL literals, which Catalyst holds as it is."""
    values = ", ".join(f"({', '.join(r)})" for r in rows)
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def blocks(docs: DataFrame, counts: dict[str, int]) -> DataFrame:
    """doc_id, block (from 0), label, share: every block of a text that meets a template's containment threshold."""
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order, 1)}
    index, table = [], []
    for number, label, words in templates():
        ranks = sorted(rank[w] for w in words)
        need = needed(len(ranks))
        index += [(f"'{order[r - 1]}'", f"{r}L", str(number), str(at)) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
        table.append((str(number), f"'{label}'", f"array({', '.join(f'{r}L' for r in ranks)})", str(need)))
    prefix = sorted({w.strip("'") for w, *_ in index})
    wanted = F.array(*[F.lit(w) for w in prefix])
    vocabulary = F.array(*[F.lit(w) for w in order])

    def cut(words: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(words) - STEP - 1, F.lit(0)), F.lit(STEP))
        each = F.transform(begins, lambda i: F.struct((i / STEP).cast("int").alias("block"), F.array_distinct(F.slice(words, i + 1, WIDTH)).alias("words")))
        return F.filter(each, lambda b: F.arrays_overlap(b["words"], wanted))

    def where_held(s: Column) -> Column:
        """Words are taken one by one only in texts that hold a prefix word."""
        held = F.lit(False)
        for p in prefix:
            held = held | F.contains(s, F.lit(f" {p} "))
        return F.when(held, _once(_words(s), cut))

    # An outer explode: an inner one would have the blocks made twice, once to see if there are any.
    rows = docs.select("doc_id", F.explode_outer(_once(spaced(F.col("text")), where_held)).alias("x")).where(F.col("x").isNotNull())
    ranks = F.array_sort(F.filter(F.transform("x.words", lambda w: F.array_position(vocabulary, w)), lambda r: r > 0))
    held = rows.select("doc_id", "x.block", F.explode(F.array_intersect("x.words", wanted)).alias("word"), ranks.alias("ranks"))
    n, m, at = F.size("template"), F.size("ranks"), F.array_position("ranks", F.col("rank")).cast("int") - 1
    shared = F.size(F.array_intersect("template", "ranks"))
    return (
        held.join(F.broadcast(_inline(docs, "word, rank, number, place", index)), "word")
        .join(F.broadcast(_inline(docs, "number, label, template, need", table)), "number")
        .where((m >= F.col("need")) & (F.least("place", at) + 1 + F.least(n - F.col("place") - 1, m - at - 1) >= F.col("need")))
        .where(shared >= F.col("need"))
        .select("doc_id", "block", "label", (shared / n).alias("share"))
        .distinct()
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: base phrase counts and positions, labels of both kinds, and a score.

    The score is 1 with a base phrase, else the largest share of a template in a block, else 0.
    A null text is empty: no words, null positions, empty labels, score 0. Repeated rows
    are each returned; rows of one doc_id (a null one included) share their template
    labels; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    counts = frequencies(docs)
    found = blocks(docs, counts).groupBy("doc_id").agg(F.sort_array(F.collect_set("label")).alias("more"), F.max("share").alias("share"))
    own = base(docs).drop("text")
    hits, more = F.coalesce(F.col("hits"), F.array().cast("array<struct<start: bigint, label: string>>")), F.coalesce(F.col("more"), F.array().cast("array<string>"))
    base_labels = F.array_distinct(F.transform(hits, lambda h: h["label"]))
    return own.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id",
        "n_words",
        F.size(hits).cast("long").alias("n_base"),
        F.array_min(F.transform(hits, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(hits, lambda h: h["start"])).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, more)), ",").alias("labels"),
        F.when(F.size(hits) > 0, 1.0).otherwise(F.coalesce(F.col("share"), F.lit(0.0))).alias("score"),
    )
