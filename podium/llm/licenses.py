"""Licence scan: known licence sentences, and ordered rules over them.

A text is cut into pieces at line breaks and after . ! ? ; : before white space. Pieces are normalised: lower case,
everything but letters, digits and dots inside numbers becomes one space, so comment marks and quotes do not matter. A known
sentence begins and ends where pieces do, and may go over any number of them: it can be wrapped at any of its words. A map
gives it its identifier; a run of identifiers of a text, with unknown sentences in between left out, is matched against rules, which
are sequences of identifiers that must occur in this order. All of it is expressions on one row: no
shuffle, and no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
        "This software is licensed under the MIT License.", "The code is released under the MIT License.", "This software is released under the MIT License."],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,'
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:"
    ],
    "mit-condition": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "apache-notice": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "This project is licensed under the Apache License, Version 2.0.",
    ],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": [
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl3-notice": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
    ],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "gpl3-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License" + end
        for end in (
            " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            " as published by the Free Software Foundation, either version 3 of the License, or any later version.",
            " as published by the Free Software Foundation, version 3 of the License.",
            " as published by the Free Software Foundation, version 3.",
        )
    ],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "cc0-notice": ["Released under CC0 1.0.", "Licensed under CC0 1.0."],
    "bsd-redistribution": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met:"
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission."
    ],
    "lgpl21-free": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
        " as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "bsd2-notice": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "bsd-notice": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "all-rights": ["All rights reserved."],
}
#: Identifiers that stand in lines of their own for a licence.
SPDX = (
    "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later"
    " LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 ISC CC0-1.0 CC-BY-4.0 Unlicense Zlib BSL-1.0 EPL-2.0"
).split()
SENTENCES |= {f"spdx-{name}": [f"SPDX-License-Identifier: {name}"] for name in SPDX}

#: Rules: name, licence, identifiers in order. A rule that another one of the same licence includes is less specific.
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("mit-short", "MIT", ["mit-grant", "mit-condition"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-title", "MIT", ["mit-title"]),
    ("apache-header", "Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("apache-notice", "Apache-2.0", ["apache-notice"]),
    ("gpl3-header", "GPL-3.0", ["gpl3-free", "gpl-warranty"]),
    ("gpl-header", "GPL", ["gpl-free", "gpl-warranty"]),
    ("gpl3-notice", "GPL-3.0", ["gpl3-notice"]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("cc0-notice", "CC0-1.0", ["cc0-notice"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("bsd-text", "BSD-2-Clause", ["bsd-redistribution"]),
    ("bsd-notice", "BSD-3-Clause", ["bsd-notice"]),
    ("bsd2-notice", "BSD-2-Clause", ["bsd2-notice"]),
    ("lgpl21-header", "LGPL-2.1", ["lgpl21-free"]),
    ("mpl-notice", "MPL-2.0", ["mpl-notice"]),
    ("isc-text", "ISC", ["isc-grant"]),
    *((f"spdx-{name}", name, [f"spdx-{name}"]) for name in SPDX),
    ("all-rights", "proprietary", ["all-rights"]),
]
#: Rules that give way to others found in the same text; None: to any other.
YIELDS = {"bsd-text": ["bsd3-text"], "mit-title": ["mit-text", "mit-short"], "all-rights": None}


_CUTS = r"[\n\r\u2028\u2029]+|(?<=[.!?;:])\s+"


def normalised(text: Column) -> Column:
    """The pieces of a text with a line break before, between and after them: lower case; dots only inside numbers; anything
    else that is no letter or digit is one space. Comment marks that are words, at the beginning of a line, are left out."""
    cut = F.concat(F.lit("\n"), F.regexp_replace(F.lower(text), _CUTS, "\n"), F.lit("\n"))
    kept = F.regexp_replace(F.regexp_replace(cut, r"\n[ \t]*@?(?:dnl|rem)(?=[ \t\n])", "\n"), r"(?<![0-9])\.|\.(?![0-9])", " ")
    return F.regexp_replace(F.regexp_replace(kept, r"[^\p{L}\p{N}.\n]+", " "), r" *\n[ \n]*", "\n")


def sentences(text: Column) -> Column:
    """The pieces of a text: cut at line breaks and after . ! ? ; : before white space."""
    return F.split(text, _CUTS)


def _joined(pieces: Column) -> Column:
    return F.trim(F.translate(pieces, "\n", " "))


def known_sentences(spark, table: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The normalised forms of the sentences, with their identifiers. Two identifiers of one sentence are an error."""
    given = [(text, name) for name, texts in table.items() for text in texts]
    cut = spark.createDataFrame(given, "text string, name string").select(_joined(normalised(F.col("text"))).alias("text"), "name").collect()
    known: dict[str, str] = {}
    for row in cut:
        if known.setdefault(row["text"], row["name"]) != row["name"]:
            raise ValueError(f"two identifiers for the sentence {row['text']!r}")
    return known


def scan(
    documents: DataFrame,
    table: Mapping[str, Sequence[str]] = SENTENCES,
    rules: Sequence[tuple[str, str, Sequence[str]]] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
    yields: Mapping[str, Sequence[str] | None] = YIELDS,
) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids, rules, licenses.

    ``sentence_ids`` are the identifiers of the known sentences of the whole text, in order and with
    repeats. ``rules`` are the names of the rules whose sequence occurs in them in order, without those that
    another found rule of the same licence includes, or that yield to another found one; ``licenses`` are their licences. Both are sorted and
    without repeats. A null or empty text has no sentences and empty arrays; ``n_sentences`` counts the pieces of a text.
    Other columns are ignored, repeated rows kept.
    """
    known = known_sentences(documents.sparkSession, table)
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.create_map().cast("map<string,string>")
    text = F.coalesce(text_column, F.lit(""))
    # the longest of those that begin at a place; a space of a known sentence may be the end of a piece
    words = sorted((k.replace(".", r"\.").replace(" ", r"[ \n]") for k in known if k), key=lambda k: (-len(k), k))
    hits = F.regexp_extract_all(normalised(text), F.lit(r"\n(" + "|".join(words) + r")(?=\n)"), F.lit(1)) if words else F.array().cast("array<string>")
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.size(F.filter(sentences(text), lambda s: F.trim(s) != "")).cast("long").alias("n_sentences"),
        F.transform(hits, lambda s: names[_joined(s)]).alias("sentence_ids"),
    )

    def occurs(ids):
        """Whether the identifiers stand in this order among those of the text: one pass that waits for the next of them."""
        wanted = F.array(*map(F.lit, ids))
        step = lambda at, found: F.when((at < len(ids)) & (F.get(wanted, at) == found), at + 1).otherwise(at)
        return F.aggregate("sentence_ids", F.lit(0), step) == len(ids)

    includes = lambda big, small: len(big) > len(small) and list(small) == [i for i in big if i in small]
    hits = []
    for name, licence, ids in rules:
        hit = occurs(ids)
        for _, other, more in rules:
            if other == licence and includes(more, ids):
                hit = hit & ~occurs(more)
        hits.append(F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("license"))))
    matched = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array().cast("array<struct<rule:string,license:string>>")
    rows = rows.withColumn("found", F.when(F.size("sentence_ids") > 0, matched).otherwise(F.slice(matched, 1, 0)))

    def stays(hit):
        gone = F.lit(False)
        for name, others in yields.items():
            stronger = F.size("found") > 1 if others is None else F.exists("found", lambda other: other["rule"].isin(*others))
            gone = gone | (hit["rule"] == name) & stronger
        return ~gone

    rows = rows.withColumn("matched", F.filter("found", stays))
    return rows.select(
        "doc_id", "n_sentences", "sentence_ids", F.array_sort("matched.rule").alias("rules"),
        F.array_sort(F.array_distinct("matched.license")).alias("licenses"),
    )
