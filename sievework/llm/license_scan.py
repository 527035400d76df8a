"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are cut into sentences, sentences are normalised (A-Z lowered, runs of anything but a-z and 0-9 are one space)
and looked up among known licence sentences; the ordered list of the identifiers found, other sentences left out, is
matched against the rules, each an ordered run of identifiers. Three readings are tried: line ends close a sentence;
blank lines and copyright lines do, and other line ends are spaces (notices that are wrapped); all line ends are spaces.
A line without letters and digits is blank, so notices in comments are read too. Texts without any of a few words, of
which each known sentence has one, can't hold a known sentence and are not cut.

Defined cases: null and empty texts have no sentences and no licences; a repeated row is returned again; null ids are
kept; an empty table gives no rows; further columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licence notices.
SENTENCES: dict[str, str] = {
    "mit_ref": "Released under the MIT License.",
    "mit_ref2": "Licensed under the MIT License.",
    "mit_title": "The MIT License (MIT)",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache_ref": "Licensed under the Apache License, Version 2.0.",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_comply": "you may not use this file except in compliance with the License.",
    "apache_asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3_ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software:",
    "gpl3_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "ccbync4_ref": "Licensed under CC BY-NC 4.0.",
    "ccby4_ref": "Licensed under CC BY 4.0.",
    "ccbysa4_ref": "Licensed under CC BY-SA 4.0.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2_ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Licence, ordered run of sentences.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache_ref",)),
    ("Apache-2.0", ("apache_header", "apache_comply")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("CC-BY-4.0", ("ccby4_ref",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("ISC", ("isc_grant",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_ref2",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MPL-2.0", ("mpl2_ref",)),
    ("Unlicense", ("unlicense",)),
]
# Further sentences and rules. They are kept apart: the SQL in queries.py is made of the ones above.
MORE_SENTENCES: dict[str, str] = {
    "bsd_neither": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "version2": "version 2 of the License.",
    "version2_later": "either version 2 of the License, or (at your option) any later version.",
    "version21_later": "either version 2.1 of the License, or (at your option) any later version.",
    "version3_later": "either version 3 of the License, or (at your option) any later version.",
    "lgpl_free": "This library is free software;",
    "lgpl_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl_terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation;",
    "agpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc0_waiver": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0_ref": "Licensed under CC0 1.0.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
MORE_RULES: list[tuple[str, tuple[str, ...]]] = [
    ("AGPL-3.0-or-later", ("gpl_free", "agpl3_later")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl_terms", "version3_later")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_neither")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_author")),
    ("CC0-1.0", ("cc0_ref",)),
    ("CC0-1.0", ("cc0_waiver",)),
    ("GPL-2.0-only", ("gpl_free", "gpl2_terms")),
    ("GPL-2.0-only", ("gpl_free", "gpl_terms", "version2")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl_terms", "version2_later")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_terms", "version3_later")),
    ("LGPL-2.1-or-later", ("lgpl_free", "lgpl21_later")),
    ("LGPL-2.1-or-later", ("lgpl_free", "lgpl_terms", "version21_later")),
    ("LGPL-3.0-or-later", ("gpl_free", "lgpl3_later")),
    ("LGPL-3.0-or-later", ("gpl_free", "lgpl_terms", "version3_later")),
    ("LGPL-3.0-or-later", ("lgpl_free", "lgpl3_later")),
    ("LGPL-3.0-or-later", ("lgpl_free", "lgpl_terms", "version3_later")),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
]
# The holder's name in the third condition of BSD, in normalised sentences; "Inc." may have closed one.
NAMED = r"neither the names? of [a-z0-9 \n]{1,300}?[ \n]nor the names of (?:its|their) contributors"
# A line that names a holder ends there, also without an end mark or a blank line below it.
HOLDER = r"(?md)^([^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*)$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def known_sentences() -> dict[str, int]:
    """Normalised sentence -> identifier, of SENTENCES, each with its words as one entry."""
    return {" ".join(re.findall("[a-z0-9]+", text.lower())): i for i, text in enumerate(SENTENCES.values(), 1)}


def catalogue() -> dict[str, str]:
    return SENTENCES | MORE_SENTENCES


def sentence_parts() -> dict[tuple[str, ...], int]:
    """The sentences that the cutter makes of each known one -> its identifier."""
    out = {}
    for i, text in enumerate(catalogue().values(), 1):
        parts = re.split(r"(?<=[.!?;:])[\x20\x09-\x0D]+", text.strip())
        out[tuple(" ".join(re.findall("[a-z0-9]+", p.lower())) for p in parts)] = i
    return out


def telling_words() -> list[str]:
    """Words of which every known sentence has one: the word of most sentences, again and again."""
    left, out = [{w for p in parts for w in p.split(" ")} for parts in sentence_parts()], []
    while left:
        words = sorted({w for s in left for w in s if len(w) > 4})
        out.append(max(words, key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


def may_hold(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    test = F.lit(False)
    for word in telling_words():
        test = test | low.contains(word)
    return test


def _sentences(text: Column) -> Column:
    """Array of normalised sentences: an end mark with white space after it, or a line end, closes one."""
    cut = F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n")
    plain = F.regexp_replace(F.translate(cut, UPPER, LOWER), r"[^a-z0-9\n]+", " ")
    plain = F.regexp_replace(plain, r"\x20?\n\x20?", "\n")
    return F.split(F.regexp_replace(plain, NAMED, "neither the name of the copyright holder nor the names of its contributors"), "\n")


def _paragraphs(text: Column) -> Column:
    """text with one line for each paragraph: single line ends are spaces, blank lines and holders' lines end a paragraph."""
    low = F.translate(F.regexp_replace(text, r"\r\n?", "\n"), UPPER + "\f", LOWER + " ")
    marked = F.regexp_replace(F.regexp_replace(low, HOLDER, "\n$1\n"), r"\n[^a-z0-9]*\n", "\f")
    return F.translate(marked, "\n\f", " \n")


def _found(text: Column, known: dict[tuple[str, ...], int]) -> Column:
    """Identifiers of the known sentences of text, in order: one of several parts is known where all of them follow."""
    lookup = F.create_map(*[F.lit(x) for parts, i in known.items() if len(parts) == 1 for x in (parts[0], i)])
    several = {parts: i for parts, i in known.items() if len(parts) > 1}
    cut = F.transform(_sentences(text), lambda s: F.trim(s))
    single = lambda s: F.try_element_at(lookup, s)
    if not several:
        return F.filter(F.transform(cut, single), lambda i: i.isNotNull())

    def ids(cuts: Column) -> Column:
        whole = lambda parts, at: F.slice(cuts, at + 1, len(parts)) == F.array(*[F.lit(p) for p in parts])
        test = lambda s, at: F.coalesce(*[F.when((s == parts[0]) & whole(parts, at), F.lit(i)) for parts, i in several.items()], single(s))
        return F.transform(cuts, test)

    # the cut sentences are an array of one, so that they are made once
    return F.filter(F.flatten(F.transform(F.array(cut), ids)), lambda i: i.isNotNull())


def _names(readings: list[Column], number: dict[str, int]) -> list[Column]:
    """For each licence its name where a rule of it is found in a reading, else null. The longest rule wins: one that a
    longer rule holds counts only where it is found more often than that."""
    rules = RULES + MORE_RULES
    mark = lambda rule: "".join(f",{number[s]}," for s in rule)
    runs = [F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(",")) for ids in readings]
    times = lambda rule: F.greatest(*[(F.length(r) - F.length(F.replace(r, F.lit(mark(rule)), F.lit("")))) / len(mark(rule)) for r in runs])

    def hit(name: str, rule: tuple[str, ...]) -> Column:
        longer = [r for n, r in rules if n != name and mark(rule) in mark(r) and r != rule]
        if longer:
            return times(rule) > sum((times(r) for r in longer), F.lit(0.0))
        out = F.lit(False)
        for r in runs:
            out = out | r.contains(mark(rule))
        return out

    out = []
    for name in sorted({n for n, _ in rules}):
        test = F.lit(False)
        for n, rule in rules:
            if n == name:
                test = test | hit(name, rule)
        out.append(F.when(test, F.lit(name)))
    return out


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (sorted names), sentence_ids (by lines), wrapped_ids (all line ends read as spaces), paragraph_ids."""
    known, number = sentence_parts(), {name: i for i, name in enumerate(catalogue(), 1)}
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<int>")
    scan = lambda t: F.when(F.col("may"), _found(t, known)).otherwise(none)
    found = docs.select("doc_id", text.alias("text"), may_hold(text).alias("may"))
    readings = {"sentence_ids": F.col("text"), "wrapped_ids": F.translate("text", "\n\r", "  "), "paragraph_ids": _paragraphs(F.col("text"))}
    found = found.select("doc_id", *[scan(t).alias(c) for c, t in readings.items()])
    names = _names([F.col(c) for c in readings], number)
    return found.select("doc_id", F.filter(F.array(*names), lambda x: x.isNotNull()).alias("licences"), *readings)
