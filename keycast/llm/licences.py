"""Licence scan by a positional index of rare licence words.

The words of the templates are counted over all documents. Of each template the
words with the highest inverse document frequency form its postings (word and
place in the template). A file's words of the index, with their places, vote
for relative positions: place in the file less place in the template. Where
enough different words of one template agree on a position, the template's
mandatory phrases are looked for in that part of the file. All of it is
DataFrame expressions inside a row; no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters between words, base phrases with their labels, and notices of public licences.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence notice in lower-case words, and phrases of which all must stand where it is found."""

    label: str
    words: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ("waived all copyright",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Settings:
    templates: tuple[Template, ...] = TEMPLATES
    share: float = 2 / 3  # of a template's different words that enter the index, rarest first
    most: int = 8  # words of a template in the index
    agree: float = 0.6  # share of a template's index words that must agree on a position
    grid: int = 8  # positions up to so many words apart agree, so that small edits do no harm


@dataclass(frozen=True)
class Index:
    """Postings: for each template its index words with their weights, and how many must agree."""

    templates: tuple[tuple[Template, dict[str, float], int], ...]

    @property
    def words(self) -> set[str]:
        return {w for _, weights, _ in self.templates for w in weights}


def words_of(text: Column) -> Column:
    """The words of a text in their own case; empty for null. Only A-Z differ from lower case, so words are folded where they are looked at."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), "")


def _is_one_of(word: Column, wanted: set[str]) -> Column:
    """The word, A-Z folded, is one of `wanted`, which are ASCII; one hash look-up per word."""
    return F.lower(word).isin(sorted(wanted)) & (F.octet_length(word) == F.length(word))


def index(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Index:
    """Document frequencies of the templates' words over all documents, and the postings they give.

    What comes to the driver has one row per word of the templates at most,
    whatever the corpus.
    """
    vocabulary = {w for t in settings.templates for w in t.words.split()}
    words = docs.select(words_of(F.col(f"`{text_col}`")).alias("words"))
    held = words.select(F.array_distinct(F.transform(F.filter("words", lambda w: _is_one_of(w, vocabulary)), F.lower)).alias("held"))
    counted = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    documents, total = {r.word: r.documents for r in counted.collect()}, docs.count()
    rows = []
    for template in settings.templates:
        own = sorted(set(template.words.split()), key=lambda w: (documents.get(w, 0), w))
        chosen = own[: min(settings.most, math.ceil(settings.share * len(own)))]
        weights = {w: math.log((1 + total) / (1 + documents.get(w, 0))) + 1 for w in chosen}
        rows.append((template, weights, math.ceil(settings.agree * len(chosen))))
    return Index(tuple(rows))


def _postings(index: Index) -> Column:
    """Constant array of (template number, word, place in the template, words that must agree)."""
    rows = []
    for number, (template, weights, least) in enumerate(index.templates):
        for place, word in enumerate(template.words.split()):
            if word in weights:
                rows.append(F.struct(F.lit(number).alias("t"), F.lit(word).alias("w"), F.lit(place).alias("q"), F.lit(least).alias("least")))
    return F.array(*rows)


def _details(index: Index) -> Column:
    """Constant array with a template's label, length, phrases and weights at its number."""
    rows = []
    for template, weights, _ in index.templates:
        weighted = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in sorted(weights.items())))
        phrases = F.array(*(F.lit(f" {p} ") for p in template.phrases))
        rows.append(F.struct(F.lit(template.label).alias("label"), F.lit(len(template.words.split())).alias("long"), phrases.alias("phrases"), weighted.alias("weights"), F.lit(sum(weights.values())).alias("sum")))
    return F.array(*rows)


def _base_at(words: Column, place: Column) -> Column:
    """Label of the base phrase that starts at a place, or null."""
    found = None
    for phrase, label in BASE.items():
        here = F.lit(True)
        for k, word in enumerate(phrase.split()):
            here = here & (F.lower(F.get(words, place + k)) == word)
        found = F.when(here, label) if found is None else found.when(here, label)
    return found


def scanned(docs: DataFrame, index: Index, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and `found`.

    `found` lists the accepted templates: label, first word of the part of the
    file that was looked at, and the share of the template's index weight that
    agreed there. `score` is the largest such share, 1 with a base phrase, 0
    with neither. Null and empty texts have no words. Rows that repeat an id, or
    have none, are rows of their own.
    """
    starts = {phrase.split()[0] for phrase in BASE}
    wanted, grid = index.words | starts, settings.grid
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    places = F.array_compact(F.transform("words", lambda w, i: F.when(_is_one_of(w, wanted), i)))
    rows = rows.withColumn("marks", F.transform(places, lambda p: F.struct(p.alias("p"), F.lower(F.get("words", p)).alias("w"))))
    bases = F.transform(F.filter("marks", lambda m: m["w"].isin(sorted(starts))), lambda m: F.struct(m["p"].alias("p"), _base_at(F.col("words"), m["p"]).alias("label")))
    rows = rows.withColumn("bases", F.filter(bases, lambda b: b["label"].isNotNull()))

    # Votes: every position is told to both cells of a grid that it can share with its neighbours.
    postings = _postings(index)

    def votes(mark: Column) -> Column:
        own = F.filter(postings, lambda x: x["w"] == mark["w"])
        cell = lambda x: F.floor((mark["p"] - x["q"]) / grid).cast("int")
        both = lambda x: F.array(*(F.struct(x["t"].alias("t"), (cell(x) - k).alias("cell"), x["w"].alias("w"), x["least"].alias("least")) for k in (0, 1)))
        return F.flatten(F.transform(own, both))

    least = min((n for *_, n in index.templates), default=1)
    enough = F.size(F.array_distinct(F.transform("marks", lambda m: m["w"]))) >= least
    nothing = F.expr("cast(array() as array<struct<t:int,cell:int,w:string,least:int>>)")
    rows = rows.withColumn("votes", F.when(enough, F.sort_array(F.array_distinct(F.flatten(F.transform("marks", votes))))).otherwise(nothing))
    # Votes are sorted: a cell holds enough words if the vote so many places on is still of it.
    again = lambda x, i: F.get("votes", i + x["least"] - 1)
    full = F.filter("votes", lambda x, i: (again(x, i)["t"] == x["t"]) & (again(x, i)["cell"] == x["cell"]))
    rows = rows.withColumn("cells", F.array_distinct(F.transform(full, lambda x: F.struct(x["t"].alias("t"), x["cell"].alias("cell")))))

    details = _details(index)
    look = lambda c: F.struct(
        c["t"].alias("t"), c["cell"].alias("cell"), F.greatest(F.lit(0), c["cell"] * grid).alias("low"), F.get(details, c["t"]).alias("d"),
    )
    rows = rows.withColumn("looked", F.transform("cells", look))

    def part(c: Column) -> Column:
        high = c["cell"] * grid + 2 * grid + c["d"]["long"]
        joined = F.array_join(F.slice("words", c["low"] + 1, F.greatest(F.lit(0), high - c["low"])), " ")
        return F.concat(F.lit(" "), F.translate(joined, UPPER, LOWER), F.lit(" "))

    verified = F.filter("looked", lambda c: F.forall(c["d"]["phrases"], lambda phrase: F.contains(part(c), phrase)))

    def share(c: Column) -> Column:
        here = F.transform(F.filter("votes", lambda v: (v["t"] == c["t"]) & (v["cell"] == c["cell"])), lambda v: v["w"])
        weight = F.aggregate(F.filter(c["d"]["weights"], lambda w: F.array_contains(here, w["w"])), F.lit(0.0), lambda a, w: a + w["x"])
        return F.least(F.lit(1.0), F.round(weight / c["d"]["sum"], 6))

    rows = rows.withColumn("found", F.transform(verified, lambda c: F.struct(c["d"]["label"].alias("label"), c["low"].alias("word"), share(c).alias("share"))))
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base = F.transform("bases", lambda b: b["label"])
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("bases").cast("long").alias("n_base"),
        F.array_min(F.transform("bases", lambda b: b["p"])).cast("long").alias("first_word"), F.array_max(F.transform("bases", lambda b: b["p"])).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.transform("found", lambda f: f["label"]))).alias("labels"),
        F.when(F.size("bases") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))).cast("double").alias("score"),
        "found",
    )


def licence_scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Index the corpus and scan it; see `scanned`."""
    return scanned(docs, index(docs, settings), settings)
