"""License scan with a positional index of rare words, in DataFrame operations.

Every template is a stretch of license text. The index holds, for each word
that is rare among the templates (highest inverse document frequency), where it
stands in which template. A document's words are looked up in it, each hit
votes for a template at the place where the template would begin, and the best
place gives the share of index words found in the right relative positions.
A template counts only if its mandatory phrase stands in the document too.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST = 0.5  # share of a template's index words in place
#: Phrases and labels of the plain scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, opening words of the public license text, key phrase.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)
RARE_WORDS = 10  # index words of a template, the rarest ones


def index(templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Template number and position of each template's rarest words."""
    texts = [t.split() for _, t, _ in templates]
    df = Counter(w for t in texts for w in set(t))
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(texts):
        idf = {w: math.log(len(texts) / df[w]) for w in set(t)}
        for w in sorted(idf, key=lambda w: (-idf[w], t.index(w)))[:RARE_WORDS]:
            for at, x in enumerate(t):
                if x == w:
                    postings.setdefault(w, []).append((k, at))
    return postings


def _places(phrase: str) -> Column:
    """Starts of a phrase in the array ``words``."""
    parts = phrase.split()
    here = " and ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(parts))
    return F.expr(f"filter(sequence(0, size(words) - {len(parts)}), i -> {here})")


def _has(phrase: str) -> Column:
    return F.col("line").contains(f" {phrase} ")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document row: word and phrase counts, labels and score.

    Null and empty texts have no words; long texts are scanned whole. Repeated
    rows are kept, an empty table gives no rows, other columns are left out,
    whatever their names. Words with one inverse document frequency enter the
    index in the order of the template; of places with equally many votes any
    gives the same share. ``score`` is the greatest share of a template's
    index words found in place, for templates whose key phrase is present.
    Only documents with an index hit build arrays of positions.
    """
    postings = index(templates)
    size = [sum(1 for p in postings.values() for k, _ in p if k == n) for n in range(len(templates))]
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    df = docs.select("doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("found"))
    df = df.withColumn("n_words", F.size("found").cast("long"))
    # Arrays go on only where a phrase or an index word can matter.
    keys = [w for w in postings if len(w) > 3]
    hint = F.arrays_overlap("found", F.array(*[F.lit(w) for w in sorted({"license", *keys, "cc", "nc"})]))
    df = df.withColumn("words", F.when(hint, F.col("found")).otherwise(F.expr("cast(array() as array<string>)"))).drop("found")
    df = df.withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    for k, (phrase, _) in enumerate(PHRASES):
        df = df.withColumn(f"p{k}", F.when(_has(phrase), _places(phrase)).otherwise(F.expr("cast(array() as array<int>)")))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    df = df.withColumn("places", places)
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    entries = ", ".join(f"'{w}', array({', '.join(f'named_struct("t", {k}, "p", {at})' for k, at in p)})" for w, p in sorted(postings.items()))
    df = df.withColumn("hits", F.expr(f"""
        flatten(transform(words, (w, i) -> transform(
            coalesce(element_at(map({entries}), w), cast(array() as array<struct<t: int, p: int>>)),
            e -> named_struct('t', e.t, 'at', i - e.p))))"""))
    # Length of the longest run of equal votes per template, over sorted votes.
    df = df.withColumn("best", F.expr(f"""
        aggregate(array_sort(hits),
            named_struct('t', -1, 'at', 0, 'run', 0, 'best', array_repeat(0, {len(templates)})),
            (s, v) -> named_struct('t', v.t, 'at', v.at, 'run', if(v.t = s.t and v.at = s.at, s.run + 1, 1),
                'best', transform(s.best, (b, k) -> if(k = v.t, greatest(b, if(v.t = s.t and v.at = s.at, s.run + 1, 1)), b))),
            s -> s.best)"""))
    share = [F.when(_has(key), F.col("best")[n] / F.lit(float(size[n]))).otherwise(F.lit(0.0)) for n, (_, _, key) in enumerate(templates)]
    own = F.array_compact(F.array(*[F.when(share[n] >= LEAST, F.lit(label)) for n, (label, _, _) in enumerate(templates)]))
    return df.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.least(F.greatest(*share), F.lit(1.0)).alias("score"),
    )
