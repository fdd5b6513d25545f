import re

from nightjar.llm import license_scan as ls

SCHEMA = "doc_id long, text string, words string, labels string, score double"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    w = re.findall(ls.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for p, label in PHRASES.items():
        q = p.split()
        here = [i for i in range(len(w)) if w[i : i + len(q)] == q]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_against_brute_force(spark):
    texts = [
        None, "", " ...", "no licence here, mit ohne alles", "MIT License", "the MIT-license; MIT\nLICENSE cc by cc by-nc CC.BY!", "GNU General Public License version 3 " * 40,
        "gnu general public", "general public license gnu", "Ünder the Apache License, Version 2.0 é", "apache apache license license", "x " * 30_000 + "cc by",
    ]
    rows = [(i, t, "a", "b", 1.0) for i, t in enumerate(texts)] + [(None, "mit license", None, None, None), (4, "MIT License", "a", "b", 1.0)]
    got = ls.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((r[0], *brute(r[1])) for r in rows), key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_templates_need_key_phrase_and_enough_words(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = [(1, bsd, "", "", 0.0), (2, bsd.replace("modification", "change"), "", "", 0.0), (3, bsd.replace("source", "sauce"), "", "", 0.0), (4, "redistribution and use in source and binary forms of another kind", "", "", 0.0)]
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in ls.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("bsd", 1.0), 2: ("bsd", round(20 / 21, 3)), 3: ("", 0.0), 4: ("", 0.0)}


def test_empty(spark):
    assert ls.scan(spark.createDataFrame([], SCHEMA)).count() == 0
