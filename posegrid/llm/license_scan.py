"""License scan by sentence rules, in DataFrame operations only.

A text is cut into sentences, each is normalised (A-Z lower-cased, everything but
ASCII letters and digits one blank, trimmed) and looked up among known licence
sentences. The document becomes the sequence of the identifiers found, other
sentences left out, and ordered rules are matched against that sequence: a rule
fits where its identifiers follow each other. The first fitting rule of each
licence names the evidence; a licence whose evidence another one's contains (two BSD
clauses within three) does not count beside it. Everything stays in the row, so nothing is shuffled.

A line is a sentence of its own, but known sentences are also found where they are
wrapped: a single line end without a sentence mark before it may stand for a blank
of theirs, also with comment markers (signs, not words such as `dnl`) around it.
They still begin and end at a sentence's or line's edge; of several that begin at
one place the longest counts, and its lines do not count again. An empty line, or
one of markers only, always ends a sentence. n_sentences counts lines as before.

Defined results: null text, and text without a known sentence, has empty
sequences and no licence; a sentence counts as often as it stands; a text of any
length is read whole; repeated rows give repeated results; other columns pass by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence names that may follow an SPDX tag (fixed values).
SPDX_NAMES = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 ISC BSD-2-Clause BSD-3-Clause Unlicense Zlib CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0"
).split()
#: Known licence sentences (fixed values): identifier and wording.
SENTENCES: list[tuple[str, str]] = [
    ("mit-ref", "Released under the MIT License"),
    ("mit-ref", "Licensed under the MIT License"),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    (
        "mit-grant",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache2-ref", "Licensed under the Apache License, Version 2.0"),
    ("apache2-ref", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache2-comply", "you may not use this file except in compliance with the License"),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-ref", "Licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software"),
    (
        "gpl-terms3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("ccbync4-ref", "Licensed under CC BY-NC 4.0"),
    ("ccbync4-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("ccby4-ref", "Licensed under CC BY 4.0"),
    ("ccby4-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-redistribute", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-ref", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    (
        "bsd-binary",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "bsd-endorse",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-free", "This library is free software"),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("later-2", "either version 2 of the License, or (at your option) any later version"),
    ("later-2.1", "either version 2.1 of the License, or (at your option) any later version"),
    (
        "lgpl-terms3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "agpl-terms3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("mpl2-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("cc0-waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("spdx", "SPDX-License-Identifier"),
    *((f"name:{name}", name) for name in SPDX_NAMES),
]
#: Rules in order of precedence: rule, licence, identifiers that must follow each other.
RULES: list[tuple[str, str, list[str]]] = [
    ("mit-full", "MIT", ["mit-grant", "mit-notice"]),
    ("mit-titled", "MIT", ["mit-title", "mit-grant"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("mit-reference", "MIT", ["mit-ref"]),
    ("apache2-header", "Apache-2.0", ["apache2-ref", "apache2-comply", "apache2-copy"]),
    ("apache2-reference", "Apache-2.0", ["apache2-ref"]),
    ("gpl3-header", "GPL-3.0", ["gpl-free", "gpl-terms3", "gpl-hope"]),
    ("gpl3-terms", "GPL-3.0", ["gpl-terms3"]),
    ("gpl3-reference", "GPL-3.0", ["gpl3-ref"]),
    ("cc-by-nc4-reference", "CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("cc-by4-reference", "CC-BY-4.0", ["ccby4-ref"]),
    ("bsd-clauses", "BSD", ["bsd-redistribute"]),
    ("bsd-reference", "BSD", ["bsd-ref"]),
    ("bsd3-clauses", "BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd2-clauses", "BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("gpl2-header", "GPL-2.0", ["gpl-terms", "later-2"]),
    ("lgpl21-header", "LGPL-2.1", ["lgpl-terms", "later-2.1"]),
    ("lgpl3-terms", "LGPL-3.0", ["lgpl-terms3"]),
    ("agpl3-terms", "AGPL-3.0", ["agpl-terms3"]),
    ("mpl2-terms", "MPL-2.0", ["mpl2-terms"]),
    ("mpl2-copy", "MPL-2.0", ["mpl2-copy"]),
    ("isc-grant", "ISC", ["isc-grant"]),
    ("unlicense", "Unlicense", ["unlicense-free"]),
    ("zlib-altered", "Zlib", ["zlib-altered"]),
    ("cc0-waiver", "CC0-1.0", ["cc0-waiver"]),
    *(("spdx-tag", re.sub("-only$|-or-later$", "", name), ["spdx", f"name:{name}"]) for name in SPDX_NAMES),
]
#: Licences whose evidence contains that of others, which then don't count.
SUPERSEDES: dict[str, list[str]] = {"BSD-3-Clause": ["BSD-2-Clause", "BSD"], "BSD-2-Clause": ["BSD"]}
#: Ends of sentences: a line's end, or sentence marks before white space.
BOUNDARY = r"[.;:!?]*[ \t\r]*\n[ \t\r\n]*|[.;:!?]+[ \t\r]+"
#: The ends among them that no sentence runs over: sentence marks, empty lines.
HARD = r"[.;:!?]+[ \t\r]*\n[ \t\r\n]*|[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*|[.;:!?]+[ \t\r]+"
#: Comment markers at a line's start; some would pass for sentence marks.
MARKER = r"\n[ \t]*[#*/%;!>|-]+(?=[ \t])"
#: ASCII signs that stand for a blank in normal form; NUL goes with all that is not ASCII.
SIGNS = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum() and c not in "\n ")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    """The form in which sentences are compared."""
    kept = (c if c.isascii() and c.isalnum() else " " for c in sentence.translate(str.maketrans(_UPPER, _LOWER)))
    return " ".join("".join(kept).split())


def known(sentences: list[tuple[str, str]] = SENTENCES) -> dict[str, str]:
    """Identifier by normalised sentence; a sentence of several parts counts by its whole."""
    return {normalise(text): name for name, text in sentences}


def _marked(s: Column) -> Column:
    """Text in normal form, with Z for the ends that no sentence runs over and L for other line ends."""
    bare = F.regexp_replace(F.translate(s, _UPPER, _LOWER), MARKER, "\n")
    # Signs go by translate: a pattern tried on every blank took most of the time.
    cut = F.translate(F.regexp_replace(bare, HARD, "Z"), SIGNS + "\n", " " * len(SIGNS) + "L")
    plain = F.regexp_replace(F.regexp_replace(cut, r"[^\x01-\x7F]+", " "), "  +", " ")
    return F.concat(F.lit("Z"), plain, F.lit("Z"))


def _pattern(table: dict[str, str]) -> str:
    """Known sentences in marked text, the longest first, each between two ends and with at most one line end for a blank."""
    found = "|".join(t.replace(" ", "(?: | ?L ?)") for t in sorted(table, key=len, reverse=True) if t)
    return f"(?<=[LZ] ?)(?:{found})(?= ?[LZ])"


def scan(df: DataFrame, text: str = "text", sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """Add n_sentences, sentence_ids, rules and licenses (strings of space-separated names) to the other columns."""
    table = known(sentences)
    ids = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    pieces = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BOUNDARY), lambda s: F.length(s) > 0)
    out = [c for c in df.columns if c not in ("n_sentences", "sentence_ids", "rules", "licenses")]
    hits = F.regexp_extract_all(_marked(F.coalesce(F.col(text), F.lit(""))), F.lit(_pattern(table)), F.lit(0))
    named = F.transform(hits, lambda s: F.element_at(ids, F.regexp_replace(s, "[ L]+", " ")))
    rows = df.withColumn("_pieces", pieces).withColumn("_ids", F.concat(F.lit(" "), F.array_join(named, " "), F.lit(" ")))
    fits = [F.when(F.col("_ids").contains(" " + " ".join(seq) + " "), F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("licence"))) for rule, licence, seq in rules]
    rows = rows.withColumn("_fits", F.filter(F.array(*fits), lambda r: r.isNotNull()))
    licences = F.array_distinct(F.transform("_fits", lambda r: r["licence"]))
    lesser = F.create_map(*[x for k, less in SUPERSEDES.items() for x in (F.lit(k), F.array(*map(F.lit, less)))])
    licences = F.array_except(licences, F.flatten(F.transform(licences, lambda k: F.coalesce(F.element_at(lesser, k), F.array().cast("array<string>")))))
    first = F.transform(licences, lambda k: F.element_at(F.filter("_fits", lambda r: r["licence"] == k), 1)["rule"])
    return rows.select(
        *out,
        F.size("_pieces").cast("long").alias("n_sentences"),
        F.trim("_ids").alias("sentence_ids"),
        F.array_join(first, " ").alias("rules"),
        F.array_join(licences, " ").alias("licenses"),
    )


def oracle_sql() -> str:
    """The same result for `documents` in DuckDB's SQL."""
    pairs = ", ".join(f"('{t}', '{name}')" for t, name in known().items())
    sizes = min(len(t) for t in known())
    by_licence: dict[str, list[tuple[str, list[str]]]] = {}
    for rule, licence, seq in RULES:
        by_licence.setdefault(licence, []).append((rule, seq))
    seen = lambda seq: f"contains(ids, ' {' '.join(seq)} ')"
    greater = {k: [seen(seq) for k2, less in SUPERSEDES.items() if k in less for _, seq in by_licence[k2]] for k in by_licence}
    none = lambda k: f"WHEN {' OR '.join(greater[k])} THEN NULL " if greater[k] else ""
    case = lambda k, seqs: none(k) + " ".join(f"WHEN {seen(seq)} THEN '{name}'" for name, seq in seqs)
    named = ", ".join(f"CASE {case(k, seqs)} END" for k, seqs in by_licence.items())
    licences = ", ".join(f"CASE {case(k, [(k, s) for _, s in seqs])} END" for k, seqs in by_licence.items())
    boundary = BOUNDARY.replace("'", "''")
    return rf"""
        WITH known(sentence, name) AS (VALUES {pairs}),
        cut AS (
          SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{boundary}'), lambda s: length(s) > 0) AS pieces FROM documents
        ), each AS (
          SELECT doc_id, unnest(pieces) AS s, unnest(range(1, len(pieces) + 1)) AS k FROM cut
        ), named AS (
          SELECT doc_id, string_agg(name, ' ' ORDER BY k) AS ids
          FROM each JOIN known ON known.sentence = trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))
          WHERE length(s) >= {sizes}
          GROUP BY doc_id
        ), all_ids AS (
          SELECT doc_id, len(pieces) AS n_sentences, ' ' || coalesce(ids, '') || ' ' AS ids FROM cut LEFT JOIN named USING (doc_id)
        )
        SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, trim(ids) AS sentence_ids,
               concat_ws(' ', {named}) AS rules, concat_ws(' ', {licences}) AS licenses
        FROM all_ids
    """
