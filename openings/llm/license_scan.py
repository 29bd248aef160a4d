"""Licence scans with a positional index of rare words.  DataFrame functions only.

1. The document frequency of every template word is counted over the corpus.
2. A template can stand only in a file that has all words of its mandatory
   phrases; most files have those of none and are done.
3. In the others the file's own licence words of highest IDF are looked up, and
   with them the two rarest mandatory words of each template at hand.
4. Their postings (template, place) are intersected by relative position: a
   (template, offset) stays that two or more of them agree on.  Both mandatory
   words agree wherever the phrases stand, so IDF sets the cost and the
   evidence, never the labels.
5. The mandatory phrases are verified word by word at what is left, and all of
   the template's words are counted at that offset (the score).

All of it is one projection a text.  Postings are intersected by one sort and
one pass over runs, so a text of n notices costs n log n; the only shuffle is
the count of document frequencies, of at most as many words as the templates
have.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence notice: its words, and (place, phrase) pairs that must stand there."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]


def template(label: str, notice: str, *phrases: str) -> Template:
    """A template of a notice in plain text; phrases default to the whole notice."""
    words = tuple(re.findall(WORD, notice.lower()))
    placed = []
    for phrase in phrases or (notice,):
        wanted = tuple(re.findall(WORD, phrase.lower()))
        placed.append((next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted), wanted))
    return Template(label, words, tuple(placed))


#: Base phrases and their labels, counted wherever their words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as the licences themselves ask for or begin.
NOTICES = (
    template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License"),
    template("mit", "Released under the MIT License", "MIT License"),
    template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "hereby granted", "free of charge", "to any person obtaining"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms"),
    template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of", "endorse or promote products"),
    template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU General Public License"),
    template("gpl-2.0", "licensed under the GNU General Public License version 2", "GNU General Public License version 2"),
    template("gpl-3.0", "licensed under the GNU General Public License version 3", "GNU General Public License version 3"),
    template("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Lesser General Public License"),
    template("agpl-notice", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Affero General Public License"),
    template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License"),
    template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software License"),
    template("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License", "Common Development and Distribution License"),
    template("eupl-1.2", "Licensed under the European Union Public Licence, Version 1.2", "European Union Public Licence"),
    template("artistic-2.0", "distributed under the terms of the Artistic License 2.0", "Artistic License"),
    template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "provided as is without any express or implied warranty", "authors be held liable"),
    template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "modify and or distribute this software"),
    template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
    template("wtfpl", "Do What The Fuck You Want To Public License", "Do What The Fuck You Want To"),
    template("psf-2.0", "Python Software Foundation License Version 2", "Python Software Foundation License"),
    template("cc0", "dedicated to the public domain under CC0", "public domain under CC0"),
    template("cc0", "Creative Commons Zero v1.0 Universal", "Creative Commons Zero"),
    template("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4 0"),
    template("cc-by-sa-text", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike"),
    template("cc-by-nc-text", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial"),
    template("cc-by-nc", "licensed under CC BY NC", "CC BY NC"),
    template("cc-by-sa", "licensed under CC BY SA", "CC BY SA"),
    template("cc-by-nd", "licensed under CC BY ND", "CC BY ND"),
    template("reserved-notice", "Copyright. All rights reserved.", "All rights reserved"),
)

#: Identifiers of the SPDX list; each is a template of the tag that names it.
SPDX = "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only AGPL-3.0-only AGPL-3.0-or-later EPL-2.0 BSL-1.0 ISC Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()

TEMPLATES = (*NOTICES, *(template(i.lower(), f"SPDX-License-Identifier: {i}") for i in SPDX))


def _words(text: Column) -> Column:
    """Lower-cased (A-Z) words.  The Kelvin sign, whose lower case is an ASCII letter, stays itself."""
    kept = F.when(text.contains("K"), F.translate(text, "K", "")).otherwise(text)
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def _stands(words: Column, place: Column, phrase: Column) -> Column:
    """The phrase's words (an array) stand at a place from 0."""
    return (place >= 0) & (F.slice(words, F.greatest(place, F.lit(0)).cast("int") + 1, F.size(phrase)) == phrase)


@dataclass(frozen=True)
class Index:
    """n: documents that have each word; postings: word -> (template's number, place); pairs: of each template that can stand its two rarest mandatory words."""

    n: dict[str, int] = field(default_factory=dict)
    postings: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pairs: dict[int, tuple[str, ...]] = field(default_factory=dict)


def build_index(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """The index of all words of templates whose mandatory words all occur somewhere; others stand nowhere."""
    vocabulary = sorted({w for t in templates for w in t.words})
    if not vocabulary:
        return Index()
    text = F.col(text_col).cast("string")
    hit = F.array_distinct(F.filter(_words(F.coalesce(text, F.lit(""))), lambda w: w.isin(vocabulary)))
    n = {r.word: r.n for r in docs.select(F.explode(hit).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the templates' words
    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
    pairs = {}
    for number, t in enumerate(templates):
        mandatory = {w for _, phrase in t.phrases for w in phrase}
        if all(n.get(w) for w in mandatory):
            pairs[number] = tuple(sorted(mandatory, key=lambda w: (n[w], w))[:2])
            for place, w in enumerate(t.words):
                if n.get(w):
                    postings[w].append((number, place))
    return Index(n, dict(postings), pairs)


def _runs(sorted_: Column, starts: Column) -> Column:
    """(x, n) of each run of a sorted array, given the places where runs start."""
    return F.transform(starts, lambda at, j: F.struct(F.get(sorted_, at).alias("x"), (F.coalesce(F.get(starts, j + 1), F.size(sorted_)) - at).alias("n")))


def _run_starts(sorted_: Column) -> Column:
    places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, rarest: int = 8) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    n_base counts all places of the BASE phrases, first_word and last_word are
    the smallest and largest of them (words from 0; null if none).  labels
    are the base labels and those of templates whose mandatory phrases stand,
    distinct, sorted, comma-joined ("" if none).  found: distinct (label, place,
    support, share) of verified templates: place is that of the template's
    first word (before the text, if that has only the later part), support the
    number of looked-up words (the file's `rarest` ones and the mandatory ones)
    and share that of all words which stand there.
    score: the largest share; at least 0.5 where a base phrase stands; else 0.

    Null and empty texts have no words.  Rows are independent: ties, repeated
    rows and null ids are each answered as they come.  Only id_col and
    text_col are read.  An empty table gives an empty result.
    """
    index = build_index(docs, text_col, templates)
    phrases = {tuple(p.split()): label for p, label in BASE.items()}
    starts = sorted({p[0] for p in phrases})
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*[F.struct(F.lit(q).alias("place"), F.array(*map(F.lit, p)).alias("words")) for q, p in t.phrases]).alias("phrases")) for t in templates])
    mandatory = {number: sorted({w for _, phrase in templates[number].phrases for w in phrase}, key=lambda w: (index.n[w], w)) for number in index.pairs}
    strings, numbers, found_type = F.array().cast("array<string>"), F.array().cast("array<int>"), "array<struct<label:string,place:int,support:int,share:double>>"

    def placed(vocabulary: list[str]) -> Column:
        return F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull()) if vocabulary else F.array().cast("array<struct<w:string,i:int>>")

    def base(h: Column) -> Column:
        found = [F.when((h["w"] == p[0]) & _stands(F.col("words"), h["i"], F.array(*map(F.lit, p))), F.struct(h["i"].alias("i"), F.lit(label).alias("label"))) for p, label in phrases.items()]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    def verified(c: Column) -> Column:
        t = F.element_at(known, c["t"] + 1)
        return F.forall(t["phrases"], lambda p: _stands(F.col("words"), c["place"] + p["place"], p["words"]))

    def measured(c: Column) -> Column:
        t = F.element_at(known, c["x"]["t"] + 1)
        standing = F.size(F.filter(F.transform(t["words"], lambda w, i: (c["x"]["place"] + i >= 0) & F.coalesce(F.get("words", c["x"]["place"] + i) == w, F.lit(False))), lambda x: x))
        return F.struct(t["label"].alias("label"), c["x"]["place"].alias("place"), c["n"].alias("support"), (standing / F.size(t["words"])).alias("share"))

    rows = docs.select(F.col(id_col).alias("id"), _words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    rows = settle(rows, starts=placed(starts), hits=placed(sorted(index.postings)))
    rows = settle(rows, base=F.when(F.size("starts") > 0, F.flatten(F.transform("starts", base))), licence=F.array_distinct(F.transform("hits", lambda h: h["w"])))
    # templates that can stand here; the rarest of their words is asked for first
    has = lambda w: F.array_contains("licence", w)
    possible = [F.when(F.forall(F.array(*map(F.lit, words)), has), F.lit(number)) for number, words in mandatory.items()]
    rows = settle(rows, here=F.when(F.size("licence") > 1, F.array_compact(F.array(*possible))).otherwise(numbers) if possible else numbers)
    if possible:
        counts = F.create_map(*[x for w in sorted(index.postings) for x in (F.lit(w), F.lit(index.n[w]))])
        own = F.transform(F.slice(F.array_sort(F.transform("licence", lambda w: F.struct(F.element_at(counts, w).alias("n"), w.alias("w")))), 1, rarest), lambda x: x["w"])
        pairs = F.create_map(*[x for number, words in index.pairs.items() for x in (F.lit(number), F.array(*map(F.lit, words)))])
        postings = F.create_map(*[x for w, places in sorted(index.postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(number).alias("t"), F.lit(q).alias("place")) for number, q in places]))])
        some = F.size("here") > 0
        rows = settle(rows, asked=F.when(some, F.array_union(own, F.flatten(F.transform("here", lambda t: F.element_at(pairs, t))))).otherwise(strings))
        # of each looked-up word the postings in the templates at hand
        wanted = F.transform("asked", lambda w: F.struct(w.alias("w"), F.filter(F.element_at(postings, w), lambda p: F.array_contains("here", p["t"])).alias("own")))
        rows = settle(rows, wanted=F.map_from_entries(F.transform(F.when(some, wanted), lambda x: F.struct(x["w"], x["own"]))))
        agreed = F.flatten(F.transform(F.filter("hits", lambda h: F.array_contains("asked", h["w"])), lambda h: F.transform(F.element_at("wanted", h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["place"]).alias("place")))))
        rows = settle(rows, agreed=F.when(some, F.array_sort(agreed)))
        rows = settle(rows, edges=F.when(some, _run_starts(F.col("agreed"))))
        standing = F.filter(_runs(F.col("agreed"), F.col("edges")), lambda c: (c["n"] >= F.least(F.lit(2), F.size(F.element_at(pairs, c["x"]["t"])))) & verified(c["x"]))
        rows = settle(rows, standing=F.when(some, F.array_sort(F.transform(standing, measured))))
        # two templates of one label at one place are one
        rows = settle(rows, found=F.filter("standing", lambda x, i: (i == 0) | (x != F.get("standing", i - 1))))
    else:
        rows = rows.withColumn("found", F.lit(None).cast(found_type))
    step3 = rows.select("id", F.size("words").cast("long").alias("n_words"), "base", "found")
    base_labels = F.coalesce(F.transform("base", lambda b: b["label"]), F.array().cast("array<string>"))
    own = F.coalesce(F.transform("found", lambda b: b["label"]), F.array().cast("array<string>"))
    n_base = F.coalesce(F.size("base"), F.lit(0))
    n_base = F.when(F.col("base").isNull(), F.lit(0)).otherwise(n_base).cast("long")
    return step3.select(
        F.col("id").cast("long").alias("doc_id"),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["i"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))).alias("score"),
        F.coalesce("found", F.array().cast(found_type)).alias("found"),
    )
