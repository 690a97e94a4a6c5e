"""Licence scans: normalised passages compared with licence templates by the Dice coefficient of their word bigrams.

Passages are a text's lines, sentences and the whole text. Two bounds prune
before any comparison: a passage reaches the threshold only if the sizes of the
two bigram sets are close, and only if it holds one of a few bigrams of the
template (so many of them that a passage without any misses too much).

Notices that no passage holds alone (wrapped over lines, cut at a semicolon,
inside a longer sentence) are found in windows: runs of words of any start and
any size within the same bounds. The best window of a template starts and ends
with a bigram of the template, so only those are compared. Where windows of
several licences overlap, only the closest wording counts, also for passages.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

THRESHOLD = 0.8
#: Fixed wording of common notices, by licence name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Whole standard notices, looked for in windows besides the templates.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
)


def _pairs(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _bigrams(text: str) -> list[str]:
    return sorted(set(_pairs(text)))


def _probes(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of which a passage that reaches the threshold holds at least one: longest first, as the rarest."""
    missed = len(grams) - math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: missed + 1]


def bigrams(passage: Column) -> Column:
    """Sorted distinct word bigrams of a passage; letters a-z and digits make words."""
    words = F.filter(F.split(F.lower(passage), "[^a-z0-9]+", -1), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))).otherwise(none))


def _gate(grams: set[str]) -> str:
    """Pattern of texts that hold one of the bigrams; tried only where a word starts, and by its first letter."""
    letters = sorted({g[0] for g in grams})
    branches = [f"{c}(?:{'|'.join(sorted(g[1:].replace(' ', '[^a-z0-9]+') for g in grams if g[0] == c))})" for c in letters]
    return f"(?<![a-z0-9])(?:{'|'.join(branches)})"


def _windows(text: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Best window from every start that reaches a template, as structs ``(dice, name, kept)``.

    A window is kept if no closer wording of another licence overlaps it.
    """
    none = F.array().cast("array<struct<dice:double,name:string,start:int,stop:int>>")
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")
    places = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    every = let(words, lambda w: F.when(F.size(w) > 1, places(w)).otherwise(F.array().cast("array<string>")))

    def best(pairs: Column, name: str, run: list[str]) -> Column:
        mine = sorted(set(run))
        probes = _probes(mine, threshold)
        least = math.ceil(threshold * len(mine) / (2 - threshold) - 1e-9)
        longest = math.floor((2 - threshold) * len(run) / threshold + 1e-9)

        def ends(start: Column) -> Column:
            def compared(stop: Column) -> Column:
                def dice(grams: Column) -> Column:
                    shared = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in mine])))
                    return 2.0 * shared / (F.size(grams) + len(mine))

                value = let(F.array_distinct(F.slice(pairs, start + 1, stop - start + 1)), dice)
                return F.struct(value.alias("dice"), F.lit(name).alias("name"), start.alias("start"), stop.alias("stop"))

            last = F.least(start + longest - 1, F.size(pairs) - 1)
            inside = F.filter(F.sequence(start, last), lambda i: F.get(pairs, i).isin(mine))
            # too few bigrams of the template, or none of its probes, ahead of this start
            able = lambda at: (F.size(at) >= least) & F.exists(at, lambda i: F.get(pairs, i).isin(probes))
            return let(inside, lambda at: F.when(able(at), F.transform(F.filter(at, lambda i: i - start + 1 >= least), compared)).otherwise(none))

        starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.get(pairs, i).isin(mine))
        return F.filter(F.transform(starts, lambda start: F.array_max(ends(start))), lambda f: f["dice"] >= threshold)

    def of(pairs: Column) -> Column:
        found = []
        for name, run in templates:
            here = F.lower(text).rlike(_gate(set(_probes(sorted(set(run)), threshold)))) & (F.size(pairs) > 0)
            found.append(F.when(here, best(pairs, name, run)).otherwise(none))
        return F.flatten(F.array(*found))

    def closest(found: Column) -> Column:
        beats = lambda g, f: (g["name"] != f["name"]) & (g["dice"] > f["dice"]) & (g["start"] <= f["stop"]) & (f["start"] <= g["stop"])
        several = F.size(F.array_distinct(F.transform(found, lambda f: f["name"]))) > 1
        return F.transform(found, lambda f: F.struct(f["dice"].alias("dice"), f["name"].alias("name"), (~(several & F.exists(found, lambda g: beats(g, f)))).alias("kept")))

    return let(let(every, of), closest)


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``(doc_id, licenses, best_dice, n_passages)`` of every row, without a shuffle.

    ``licenses`` are the sorted distinct names of templates that a passage or a
    window reaches, joined by commas (empty if none); ``best_dice`` is the highest
    coefficient (0 if none) and ``n_passages`` the number of different passages
    that match, and one for each licence that only a window holds. Null and empty
    texts have none; a template needs two words; repeated rows stay repeated;
    other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    runs = [(name, _pairs(text)) for name, text in (*templates, *notices)]
    runs = [(name, run) for name, run in runs if run]
    known = [(name, _bigrams(text)) for name, text in templates]
    known = [(name, grams) for name, grams in known if grams]
    gate = _gate({g for _, grams in known for g in _probes(grams, threshold)})
    wide = _gate({g for _, run in runs for g in _probes(sorted(set(run)), threshold)})
    text = F.col("text")
    lines = F.split(text, "\n", -1)
    sentences = F.split(text, r"(?<=[.!?;])[\x20\x09-\x0D]+", -1)
    passages = F.array_distinct(F.concat(F.array(text), lines, sentences))

    def match(passage: Column) -> Column:
        def against(grams: Column) -> Column:
            found = []
            for name, mine in known:
                low, high = threshold * len(mine) / (2 - threshold), (2 - threshold) * len(mine) / threshold
                shared = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in mine])))
                dice = 2.0 * shared / (F.size(grams) + len(mine))
                fits = (F.size(grams) >= math.ceil(low - 1e-9)) & (F.size(grams) <= math.floor(high + 1e-9))
                found.append(F.struct(F.lit(name).alias("name"), F.when(fits, dice).otherwise(0.0).alias("dice")))
            return F.filter(F.array(*found), lambda f: f["dice"] >= threshold)

        return F.when(F.lower(passage).rlike(gate), let(bigrams(passage), against)).otherwise(F.array().cast("array<struct<name:string,dice:double>>"))

    hits = F.filter(F.transform(passages, match), lambda h: F.size(h) > 0)
    # one look at every text; what it gates off holds no probe of a passage either
    none, empty = F.array().cast("array<array<struct<name:string,dice:double>>>"), F.array().cast("array<struct<dice:double,name:string,kept:boolean>>")
    found = F.when(F.lower(text).rlike(wide), F.struct(hits.alias("hits"), _windows(text, runs, threshold).alias("windows")))
    rows = rows.select("doc_id", found.alias("found")).select("doc_id", F.coalesce("found.hits", none).alias("hits"), F.coalesce("found.windows", empty).alias("windows"))
    names = lambda found: F.array_distinct(F.transform(found, lambda f: f["name"]))
    rows = rows.withColumn("seen", names(F.filter("windows", lambda f: f["kept"])))
    rows = rows.withColumn("hidden", F.array_except(names(F.col("windows")), "seen"))
    rows = rows.withColumn("hits", F.filter(F.transform("hits", lambda h: F.filter(h, lambda f: ~F.array_contains("hidden", f["name"]))), lambda h: F.size(h) > 0))
    every = F.flatten("hits")
    return rows.select(
        "doc_id", F.array_join(F.array_sort(F.array_union(names(every), "seen")), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.concat(F.transform(every, lambda h: h["dice"]), F.transform("windows", lambda h: h["dice"]))), F.lit(0.0)), 6).alias("best_dice"),
        (F.size("hits") + F.size(F.array_except("seen", names(every)))).cast("long").alias("n_passages"),
    )
