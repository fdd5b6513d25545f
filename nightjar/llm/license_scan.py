"""Licence scans by a positional rare-token index. DataFrame functions only, on every path.

A template is a word sequence with a mandatory key phrase. Its postings give each word's places relative to the
template's start. Document frequencies of the templates' words are counted over the whole corpus; of a template's
key phrase the words of highest inverse document frequency are the ones looked up. In a file that holds all words
of a key phrase, each looked-up word's places less its relative place are the starts that it votes for; the
starts that all of them vote for are kept, the key phrase is verified there word by word, and the share of the
template's words that stand at their relative places is its score.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKED_UP, LEAST_SHARE = 2, 0.7


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    key_at: int
    key_len: int
    base: bool

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_at : self.key_at + self.key_len]


def _template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words, phrase = text.split(), (key or text).split()
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, tuple(words), at, len(phrase), base)


# The base phrases, then opening passages and names of common licences with their key phrases.
TEMPLATES = (
    _template("gpl", "gnu general public license", base=True),
    _template("apache", "apache license", base=True),
    _template("cc-by", "cc by", base=True),
    _template("mit", "mit license", base=True),
    _template("gpl-3.0", "gnu general public license version 3"),
    _template("gpl-2.0", "gnu general public license version 2"),
    _template("lgpl", "gnu lesser general public license"),
    _template("agpl", "gnu affero general public license"),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _template("cc-by-nc", "cc by nc"),
    _template("cc-by-sa", "cc by sa"),
    _template("cc-by-nd", "cc by nd"),
    _template("cc0", "cc0 1 0 universal"),
    _template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    _template("boost", "boost software license version 1 0", "boost software license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "you can redistribute it and or modify it"),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered, an empty array for none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    spaced = F.trim(F.regexp_replace(lowered, NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequencies(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many rows of `words` each word of a key phrase occurs: at most one entry for each such word."""
    vocabulary = sorted({w for t in templates for w in t.key})
    held = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("w"))
    return {w: 0 for w in vocabulary} | {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def looked_up(template: Template, idf: dict[str, float], count: int = LOOKED_UP) -> list[int]:
    """Relative places of the key phrase's words of highest inverse document frequency, one place a word."""
    places: dict[str, int] = {}
    for i, w in enumerate(template.key):
        places.setdefault(w, template.key_at + i)
    ranked = sorted(places.items(), key=lambda p: (-idf[p[0]], p[1]))
    return [at for _, at in ranked[:count]]


def _votes(marks: Column, word: str, at: int) -> Column:
    """The starts that one looked-up word's places vote for."""
    return F.transform(F.filter(marks, lambda m: m["w"] == word), lambda m: m["i"] - at)


def _complete(template: Template, starts: Column, words: Column, least: float) -> Column:
    """The shares of the starts at which enough of the template's words are in place."""
    return F.filter(F.transform(starts, lambda s: _share(template, s, words)), lambda x: x >= least)


def _starts(template: Template, idf: dict[str, float], marks: Column, words: Column) -> Column:
    """Where the template stands: the intersection of the votes, with the key phrase verified."""
    votes = None
    for at in looked_up(template, idf):
        here = _votes(marks, template.words[at], at)
        votes = here if votes is None else F.array_intersect(votes, here)
    key = _strings(template.key)
    first = template.key_at
    sound = lambda s: (s + first >= 0) & (F.slice(words, F.greatest(s + first, F.lit(0)) + 1, template.key_len) == key)
    return F.filter(votes, sound)


def _share(template: Template, start: Column, words: Column) -> Column:
    """Share of the template's words that stand at their relative places."""
    n = len(template.words)
    hits = F.transform(_numbered(template.words), lambda p: (F.get(words, F.when(start + p["i"] >= 0, start + p["i"])) == p["w"]).cast("int"))
    return F.aggregate(hits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) / F.lit(float(n))


def _numbered(words) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are their smallest and largest starts. A
    template that isn't a base phrase adds its label where its key phrase stands and at least ``least_share`` of its
    words are in place; score is the largest share of a template that gave a label, 0 without one. A null text
    counts as empty. No text is shuffled; the corpus gives only the word counts. Repeated rows are scanned
    repeatedly; other columns are not read; an empty table gives an empty result.
    """
    worded = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    counted = document_frequencies(worded, templates)
    rows = 1 + max([0, *counted.values()])
    idf = {w: math.log((1 + rows) / (1 + n)) for w, n in counted.items()}
    anchors = sorted({t.words[at] for t in templates for at in looked_up(t, idf)})
    rarest = sorted({t.words[looked_up(t, idf)[0]] for t in templates})
    words = F.col("words")
    worded = worded.withColumn("any", F.arrays_overlap(words, _strings(rarest)))
    numbered = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda m: m["w"].isin(anchors))
    marked = worded.withColumn("marks", F.when(F.col("any"), numbered))
    found = {}
    for i, t in enumerate(templates):
        at = _starts(t, idf, F.col("marks"), words)
        if not t.base:
            at = _complete(t, at, words, least_share)
        found[f"t{i}"] = F.when(F.col("any") & F.arrays_overlap(F.transform("marks", lambda m: m["w"]), _strings([t.words[looked_up(t, idf)[0]]])), at)
    hit = marked.select("doc_id", F.size("words").cast("long").alias("n_words"), *[c.alias(n) for n, c in found.items()])
    base = [f"t{i}" for i, t in enumerate(templates) if t.base]
    own = [f"t{i}" for i, t in enumerate(templates) if not t.base]
    label = {f"t{i}": t.label for i, t in enumerate(templates)}
    held = lambda n: F.coalesce(F.size(F.nullif(F.col(n), F.array().cast(hit.schema[n].dataType))), F.lit(0)) > 0
    places = F.flatten(F.array(*[F.coalesce(F.col(n).cast("array<long>"), F.array().cast("array<long>")) for n in base]))
    named = lambda names: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(held(n), F.lit(label[n])) for n in names])))), ",")
    shares = [F.when(held(n), F.lit(1.0)) for n in base] + [F.array_max(n) for n in own]
    hit = hit.withColumn("places", places)
    return hit.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        named(base).alias("base_labels"),
        named(base + own).alias("labels"),
        F.greatest(F.lit(0.0), *shares).alias("score"),
    )
