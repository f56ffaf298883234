"""License scan by sentence rules (op 9); DataFrame functions only.

A known sentence is found wherever its words stand one after the other (lower case, anything
but letters a-z and digits apart), whatever line breaks, comment marks or punctuation lie
between them, so a hard-wrapped notice and "v. 2.0" are whole. It must begin and end at the
bound of a clause: an end of the text, a line break, a URL, a comma, colon, semicolon, bracket,
double quote or dash, or `.`, `!`, `?` before anything but a letter or digit. Before it may stand one
of the known leads ("this file is"), after it the rest of the official sentence. The
identifiers found, in order, are the text's sequence; a rule is an ordered list of identifiers
that must stand in the sequence in that order, other sentences between them allowed.

`n_sentences` counts the pieces between line breaks and `.`, `!`, `?` or `;` before a blank. The
SQL looks up only whole pieces: every sentence it finds is found here, but not the reverse.

Everything is one projection: no shuffle, no join, no row of its own for a sentence.

Defined results: a null or empty text has no sentences and no licences; long texts are scanned
whole; repeated rows are answered each; null ids are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normalised sentences of public licence notices, by identifier.
SENTENCES: dict[int, str] = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind",
    6: "licensed under the apache license version 2 0",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at",
    9: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    10: "this work is licensed under the gnu general public license version 3",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    12: "this program is distributed in the hope that it will be useful but without any warranty",
    13: "you should have received a copy of the gnu general public license along with this program",
    14: "licensed under cc by nc 4 0",
    15: "licensed under cc by 4 0",
    16: "this work is licensed under a creative commons attribution 4 0 international license",
    17: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    18: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    19: "redistributions in binary form must reproduce the above copyright notice",
    20: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    21: "this source code form is subject to the terms of the mozilla public license v 2 0",
    22: "this is free and unencumbered software released into the public domain",
    23: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    24: "all rights reserved",
}
# Fixed values: (licence, identifiers in order).
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("Apache-2.0", (6,)),
    ("Apache-2.0-header", (6, 7, 8, 9)),
    ("BSD-2-Clause", (17, 18, 19)),
    ("BSD-3-Clause", (17, 18, 19, 20)),
    ("CC-BY-4.0", (15,)),
    ("CC-BY-4.0-notice", (16,)),
    ("CC-BY-NC-4.0", (14,)),
    ("GPL-3.0", (10,)),
    ("GPL-header", (11, 12, 13)),
    ("ISC", (23,)),
    ("MIT", (1,)),
    ("MIT-notice", (2,)),
    ("MIT-text", (3, 4, 5)),
    ("MPL-2.0", (21,)),
    ("Proprietary", (24,)),
    ("Unlicense", (22,)),
)
#: How the official sentence goes on where the known one is its beginning.
RESTS: dict[int, str] = {
    3: "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    5: "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    9: "without warranties or conditions of any kind either express or implied",
    11: "as published by the free software foundation",
    19: "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    20: "without specific prior written permission",
    23: "provided that the above copyright notice and this permission notice appear in all copies",
}
#: Parts of sentences that the official texts leave to their users, as patterns.
SLOTS = {20: ("the copyright holder", "(?:[a-z0-9]+ ){0,11}?[a-z0-9]+"), 23: ("and or", "and(?: or)?")}
LEAD = "(?:this|the) (?:code|file|library|module|package|program|project|repository|script|software|source code|work) is"
SENTENCE_END = r"[\n\r]+|[.!?;]+[ \t]+"
CLAUSE_END = r"""https?://\S*|[\n\r,:;()\[\]{}"\u201c\u201d\u2013\u2014|]|[.!?](?![a-z0-9])|(?<=\s)-+(?=\s)"""


def sentences(text: Column) -> Column:
    """Normalised sentences in order, blank ones left out."""
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def clauses(text: Column) -> Column:
    """The words of the text with `|` at every bound of a clause."""
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), CLAUSE_END, "|")
    return F.concat(F.lit("|"), F.regexp_replace(marked, "[^a-z0-9|]+", " "), F.lit("|"))


def sentence_pattern(i: int) -> str:
    """The known sentence as a pattern over `clauses`, its rest optional."""
    words = SENTENCES[i].replace(*SLOTS[i]) if i in SLOTS else SENTENCES[i]
    return (words + (f"(?: {RESTS[i]})?" if i in RESTS else "")).replace(" ", "[ |]+")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    lead = f"(?:{LEAD} )?".replace(" ", "[ |]+")
    known = "|".join(map(sentence_pattern, SENTENCES))
    found = F.regexp_extract_all(clauses(text), F.lit(rf"\|[ |]*{lead}({known})(?=[ |]*\|)"), F.lit(1))
    which = lambda s: F.coalesce(*(F.when(s.rlike(f"^{sentence_pattern(i)}$"), F.lit(i)) for i in SENTENCES))
    return F.transform(found, which)


def rule_pattern(ids: tuple[int, ...]) -> str:
    """The rule as a pattern over ",1,2,3,": its identifiers in order, any others between."""
    return "(?:,[0-9]+)*?".join(f",{i}" for i in ids) + ","


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_known, sequence, licenses) of every document; licenses are joined by commas."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size(sentences(F.col("text"))).alias("n_sentences"), sentence_ids(F.col("text")).alias("ids")
    )
    line = known.select("doc_id", "n_sentences", F.size("ids").alias("n_known"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("sequence"))
    marked = F.concat(F.lit(","), F.col("sequence"), F.lit(","))
    hits = [F.when(marked.rlike(rule_pattern(ids)), F.lit(name)) for name, ids in RULES]
    return line.select("doc_id", "n_sentences", "n_known", "sequence", F.concat_ws(",", *hits).alias("licenses"))
