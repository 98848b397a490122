"""License scan by sentence rules (native DataFrame and SQL functions only).

Sentences are normalised (letters and digits in lower case, single blanks) and looked up in
a table of known licence sentences, each with an identifier.  The identifiers of a document,
in their order, are matched against rules: ordered lists of identifiers that make up a
licence, with other known sentences allowed between.  A document is cut into sentences twice,
at line ends and across wrapped lines, and a rule counts that either cut meets.  The sentences
listed are those of the cut that knows more (line ends if equal), then what only the other
knows.  "v. 2.0" doesn't end a sentence.  "All rights reserved" makes a text proprietary only
if no licence is found: licences that permit much begin with it too.

All is done within the row: no shuffle, no join; the table goes into the plan as a hash set.
Null, empty or blank texts have no sentences; very long texts are read whole; repeated rows
are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

LINES = r"\n+|[.!?;]+(?:\s+|$)"
WRAPPED = r"\n[ \t]*\n\s*|:[ \t]*\n\s*|[.!?;]+(?:\s+|$)"

#: A point within "v. 2.0".
ABBREVIATION = r"([^A-Za-z0-9][vV])[.]\s+([0-9])"

# Names by which licences are cited, and the templates of citing sentences.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0", "CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
SUBJECTS = ["", "this work is ", "this project is ", "this program is ", "this software is ", "this file is ", "this document is ", "the code is "]
VERBS = ["licensed under ", "released under ", "distributed under ", "available under ", "made available under ", "published under "]

# Sentences of licence texts and notices.
TEXTS = {
    "reserved": ["All rights reserved"],
    "mit.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"
        " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "isc.grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright"
        " notice and this permission notice appear in all copies"
    ],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd.binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
        " and/or other materials provided with the distribution"
    ],
    "bsd.names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission"
    ],
    "apache.use": ["you may not use this file except in compliance with the License", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache.copy": ["You may obtain a copy of the License at"],
    "fsf.free": ["This program is free software", "This library is free software", "This software is free software", "This file is free software"],
    "fsf.either2": ["either version 2 of the License, or (at your option) any later version"],
    "fsf.either2.1": ["either version 2.1 of the License, or (at your option) any later version"],
    "fsf.either3": ["either version 3 of the License, or (at your option) any later version"],
    "apache.title": ["Apache License"],
    "apache.version": ["Version 2.0, January 2004", "Apache License Version 2.0, January 2004"],
    "gpl.title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl.title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl.title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "version.2.1991": ["Version 2, June 1991"],
    "version.2.1.1999": ["Version 2.1, February 1999"],
    "version.3.2007": ["Version 3, 29 June 2007"],
    "version.3.2007a": ["Version 3, 19 November 2007"],
    "mpl.title": ["Mozilla Public License Version 2.0"],
    "epl.title": ["Eclipse Public License - v 2.0"],
    "mit.title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mpl.subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense.free": ["This is free and unencumbered software released into the public domain"],
}

# Licences of the Free Software Foundation by rule identifier, full name and the versions of their notices.
FSF = {
    "gpl": ("GNU General Public License", {"2": "GPL-2.0", "3": "GPL-3.0"}),
    "lgpl": ("GNU Lesser General Public License", {"2.1": "LGPL-2.1", "3": "LGPL-3.0"}),
    "agpl": ("GNU Affero General Public License", {"3": "AGPL-3.0"}),
}
FSF_TERMS = "you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"

KIND = {"permissive": ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0"), "copyleft": ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC-BY-SA-4.0")}


ANY = "any"


@dataclass(frozen=True)
class Rule:
    """A licence that an ordered list of sentence identifiers makes up; ``unless`` names the
    licence whose longer rule includes this one (or, as ``ANY``, any other licence)."""

    license: str
    sequence: tuple[str, ...]
    unless: str | None = None

    @property
    def pattern(self) -> str:
        return "," + ",(?:[^,]+,)*".join(re.escape(s) for s in self.sequence) + ","


RULES = [
    *(Rule(name, (f"cites.{name}",)) for name in NAMES),
    Rule("MIT", ("mit.grant", "mit.notice")),
    Rule("ISC", ("isc.grant",)),
    Rule("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    Rule("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary"), "BSD-3-Clause"),
    Rule("Apache-2.0", ("apache.use", "apache.copy")),
    Rule("Apache-2.0", ("apache.title", "apache.version")),
    *(Rule(ident, ("fsf.free", f"{k}.terms", f"fsf.either{v}")) for k, (_, versions) in FSF.items() for v, ident in versions.items()),
    *(Rule(ident, (f"{k}.notice{v}",)) for k, (_, versions) in FSF.items() for v, ident in versions.items()),
    Rule("GPL-2.0", ("gpl.title", "version.2.1991")),
    Rule("GPL-3.0", ("gpl.title", "version.3.2007")),
    Rule("LGPL-2.1", ("lgpl.title", "version.2.1.1999")),
    Rule("LGPL-3.0", ("lgpl.title", "version.3.2007")),
    Rule("AGPL-3.0", ("agpl.title", "version.3.2007a")),
    Rule("MPL-2.0", ("mpl.subject",)),
    Rule("MPL-2.0", ("mpl.title",)),
    Rule("EPL-2.0", ("epl.title",)),
    Rule("MIT", ("mit.title",)),
    Rule("Unlicense", ("unlicense.free",)),
    Rule("Proprietary", ("reserved",), ANY),
]


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier, built from the names, templates and texts above."""
    table = {}
    for name, forms in NAMES.items():
        for form in forms:
            for verb in VERBS:
                for subject in SUBJECTS:
                    for article in ("", "the "):
                        table[normal(subject + verb + article + form)] = f"cites.{name}"
        table[normal(f"SPDX-License-Identifier {name}")] = f"cites.{name}"
    for ident, sentences in TEXTS.items():
        for s in sentences:
            table[normal(s)] = ident
    for k, (name, versions) in FSF.items():
        terms = FSF_TERMS.format(name=name)
        table[normal(terms)] = f"{k}.terms"
        for v in versions:
            for free in TEXTS["fsf.free"]:  # notices of one sentence, with colon and comma
                table[normal(f"{free}: {terms}, either version {v} of the License, or (at your option) any later version")] = f"{k}.notice{v}"
    return table


def _recognised(cut: str, table: dict[str, str]) -> str:
    """SQL for the identifiers of the known sentences of ``__x``, in their order.

    Normalised sentences hold letters, digits and blanks only, so they can stand in SQL text;
    the lists are folded to one hash set and one map when the plan is made.
    """
    quote = lambda words: ", ".join(f"'{w}'" for w in words)
    cut = cut.replace("\\", "\\\\")
    plain = f"transform(split(__x, '{cut}'), s -> trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ')))"
    some = f"filter({plain}, s -> substring_index(s, ' ', 1) in ({quote(sorted({k.split(' ')[0] for k in table}))}) and s in ({quote(table)}))"
    ids = f"map_from_arrays(split('{'|'.join(table)}', '[|]'), split('{'|'.join(table.values())}', '[|]'))"
    return f"transform({some}, s -> element_at({ids}, s))"


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentences, licenses (both comma-joined), n_sentences, kind."""
    table = known()
    text = docs.select("doc_id", F.regexp_replace(text_or_empty(), ABBREVIATION, "$1.$2").alias("__x"))
    cuts = text.select("doc_id", F.expr(_recognised(LINES, table)).alias("a"), F.expr(_recognised(WRAPPED, table)).alias("b"))
    more = F.size("a") >= F.size("b")
    base, other = F.when(more, F.col("a")).otherwise(F.col("b")), F.when(more, F.col("b")).otherwise(F.col("a"))
    seq = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    ids = cuts.select("doc_id", F.concat(base, F.array_except(other, base)).alias("ids"), seq("a").alias("sa"), seq("b").alias("sb"))
    fits = lambda r: (F.size("ids") > 0) & (F.col("sa").rlike(r.pattern) | F.col("sb").rlike(r.pattern))
    raw = F.array_compact(F.array(*[F.when(fits(r), F.lit(r.license)) for r in RULES if not r.unless]))
    rest = lambda r: F.size("raw") == 0 if r.unless == ANY else ~F.array_contains("raw", r.unless)
    found = ids.withColumn("raw", raw).withColumn("raw", F.concat("raw", F.array_compact(F.array(*[F.when(fits(r) & rest(r), F.lit(r.license)) for r in RULES if r.unless not in (None, ANY)]))))
    last = F.array_compact(F.array(*[F.when(fits(r) & rest(r), F.lit(r.license)) for r in RULES if r.unless == ANY]))
    all_of = found.select("doc_id", "ids", F.array_sort(F.array_distinct(F.concat("raw", last))).alias("l"))
    kind = F.when(F.size("l") == 0, "none").when(F.exists("l", lambda x: ~x.isin([n for k in KIND.values() for n in k])), "restricted")
    kind = kind.when(F.exists("l", lambda x: x.isin(list(KIND["copyleft"]))), "copyleft").otherwise("permissive")
    return all_of.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"), F.array_join("l", ",").alias("licenses"), kind.alias("kind")
    )
