"""Licence texts found with a positional index of rare words. DataFrame functions only.

Templates are short public notices. Each of their words has postings (template, place). The inverse document
frequency of these words is counted over all documents. For each template on its own, a document looks up the ``RARE``
words of that template of highest frequency-weight that it holds, so that no notice takes the places of another: every
place of such a word votes, for each posting in the template, for the shift between document and template. A template and shift with enough different words is a candidate, and it counts if the template's
mandatory phrases stand in the text it would cover. The work stays in the row: nothing of the texts is shuffled,
and votes are counted by sorting, so a long text costs in proportion to its length.

Null texts count as empty (no words, no labels). Repeated rows are labelled alike. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Templates: label, notice, mandatory key phrases. Openings of public licence notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the"
     " rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ["permission is hereby granted", "to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in"
     " compliance with the license you may obtain a copy of the license at",
     ["licensed under the apache license", "except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met redistributions of source code must retain the above copyright notice",
     ["redistribution and use in source and binary forms", "the following conditions are met"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation either version",
     ["free software", "gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
     " general public license as published by the free software foundation either version",
     ["free software", "gnu lesser general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
     " not distributed with this file you can obtain one at",
     ["mozilla public license", "subject to the terms of"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
]
#: Rare words of each template looked up in a document, share of a template's own rare words that must agree on a shift, and the words of
#: slack around the place where a template's phrases are sought.
RARE, AGREE, SLACK = 8, 0.5, 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    """All words of the templates: some hundred, whatever the input."""
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each template word over all documents."""
    held = F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary())))
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in rows}  # one row for each template word, and "" for all documents
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary()}


def _literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _base_places(w: Column) -> Column:
    """(place, label) of each base phrase, in order of place."""
    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def here(x: Column, i: Column) -> Column:
            ok = x == first
            for k, word in enumerate(rest, 1):
                ok = ok & F.coalesce(F.get(w, i + k) == word, F.lit(False))
            return F.when(ok, i)

        at = F.filter(F.transform(w, here), lambda i: i.isNotNull())
        found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        held = F.lit(True)  # a text without one of the words needs no look at each place
        for word in sorted(set(phrase.split()), key=len, reverse=True):
            held = held & F.array_contains(w, word)
        return F.when(held, found).otherwise(F.array().cast("array<struct<at:int,label:string>>"))

    found = [places(phrase, label) for phrase, label in BASE.items()]
    return F.array_sort(F.concat(*found))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: counts, places, labels and a score (the best share of a template's rare words)."""
    weight = idf(docs, text)
    order = sorted(vocabulary(), key=lambda w: (-weight[w], w))
    rank = {w: i for i, w in enumerate(order)}
    postings: dict[str, list[tuple[int, int]]] = {w: [] for w in order}
    need, votes = [], []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        notice = notice.split()
        for i, w in enumerate(notice):
            postings[w].append((t, i))
        own = len({w for w in notice})
        votes.append(min(RARE, own))
        need.append(max(2, math.ceil(AGREE * min(RARE, own))))
    index = F.create_map(
        *[
            x
            for w in order
            for x in (
                F.lit(w),
                F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in postings[w]]),
            )
        ]
    )

    w = F.col("_words")
    df = docs.select(
        F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("_words")
    )
    # Licence words held, rarest first: places in the order of rarity sort as numbers.
    held = F.array_intersect(_literal(order), w)
    df = df.select("*", held.alias("_held"), _base_places(w).alias("_base"))

    def own_rare(t: int) -> Column:
        # without one of the words of its phrases a template cannot stand in the text
        keys = sorted({x for key in TEMPLATES[t][2] for x in key.split()})
        own = [x for x in order if x in TEMPLATES[t][1].split()]
        whole = F.size(F.array_except(_literal(keys), F.col("_held"))) == 0
        rare = F.slice(F.array_intersect(_literal(own), F.col("_held")), 1, RARE)
        return F.when(whole, rare).otherwise(F.array().cast("array<string>"))

    df = df.withColumn("_own", F.array(*[own_rare(t) for t in range(len(TEMPLATES))]))
    df = df.withColumn("_rare", F.array_distinct(F.flatten("_own")))
    few = F.size("_rare") >= min(need)
    hits = F.filter(
        F.transform(w, lambda x, i: F.when(F.array_contains("_rare", x), F.struct(x.alias("x"), i.alias("i")))),
        lambda h: h.isNotNull(),
    )
    votes_of = F.flatten(
        F.transform(
            F.col("_hits"),
            lambda h: F.transform(
                F.filter(F.element_at(index, h["x"]), lambda p: F.array_contains(F.get("_own", p["t"]), h["x"])),
                lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("shift"), h["x"].alias("x")),
            ),
        )
    )
    df = df.withColumn("_hits", F.when(few, hits))
    df = df.withColumn("_votes", F.array_sort(F.array_distinct(votes_of)))
    v = F.col("_votes")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(v) - 1),
        lambda k: (k == 0)
        | F.coalesce(
            (F.get(v, k)["t"] != F.get(v, k - 1)["t"]) | (F.get(v, k)["shift"] != F.get(v, k - 1)["shift"]), F.lit(True)
        ),
    )
    df = df.withColumn("_starts", F.when(F.size(v) > 0, starts))
    runs = F.transform(
        F.col("_starts"),
        lambda s, j: F.struct(
            F.get(v, s)["t"].alias("t"),
            F.get(v, s)["shift"].alias("shift"),
            (F.coalesce(F.get(F.col("_starts"), j + 1), F.size(v)) - s).alias("n"),
        ),
    )
    df = df.withColumn("_runs", F.filter(runs, lambda r: r["n"] >= F.get(_literal(need), r["t"])))

    def phrases_stand(r: Column) -> Column:
        ok = F.lit(False)
        for t, (_, notice, keys) in enumerate(TEMPLATES):
            first = F.greatest(r["shift"] - SLACK, F.lit(0)) + 1
            around = F.slice(w, first, len(notice.split()) + 2 * SLACK)
            covered = F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" "))
            here = r["t"] == t
            for key in keys:
                here = here & F.contains(covered, F.lit(f" {key} "))
            ok = ok | here
        return ok

    df = df.withColumn("_found", F.filter(F.col("_runs"), phrases_stand))
    method = F.transform(F.col("_found"), lambda r: F.get(_literal([t[0] for t in TEMPLATES]), r["t"]))
    none = F.array().cast("array<string>")
    base = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.coalesce(method, none))))
    share = F.array_max(
        F.transform(F.col("_found"), lambda r: F.least(F.lit(1.0), r["n"] / F.get(_literal(votes), r["t"])))
    )
    places = F.transform("_base", lambda b: b["at"].cast("long"))
    return df.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
        F.transform("_found", lambda r: r["shift"]).alias("template_places"),
    )
