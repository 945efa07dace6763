"""License scans: known sentences become identifiers, ordered rules read licenses from their sequence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.words import once

# Sentences of common license texts and notices by identifier.
SENTENCES = {
    "mit-name": ("The MIT License", "MIT License", "The MIT License (MIT)"),
    "mit-notice": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "apache2-notice": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    "apache2-comply": ("you may not use this file except in compliance with the License",),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "gpl3-notice": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"),
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution",),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",),
    "ccbync4-notice": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "ccby4-notice": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"),
    "arr-notice": ("All rights reserved",),
}

Rule = tuple[str, tuple[str, ...]]

#: In the order they are tried; what one has used is no longer there for those below it.
RULES = (
    ("MIT", ("mit-name", "mit-grant", "mit-condition")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache2-notice", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-notice", "apache2-comply")),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("LicenseRef-all-rights-reserved", ("arr-notice",)),
)

#: Every known sentence holds one of these, whatever stands between its words, so a text without any needs no look at its sentences.
HINTS = r"(?i)licen[sc]e|permi|redistribut|rights[^a-z0-9+]+reserved|warrant|above[^a-z0-9+]+copyright|copyright[^a-z0-9+]+holder|spdx|mozilla|apache|unencumbered|public[^a-z0-9+]+domain|released[^a-z0-9+]+under|free[^a-z0-9+]+software"
ENDS = r"([.!?;:])[ \t\r\n]+"
BLANK = r"\n[ \t\r]*\n"
OTHER = r"[^a-z0-9+]+"
MARK = "\x1e"


def normalised(sentence: str) -> str:
    """Lower case; what is neither a letter, a digit nor a plus becomes one space."""
    return re.sub(OTHER, " ", sentence.lower()).strip()


KNOWN = {normalised(s): name for name, forms in SENTENCES.items() for s in forms}

#: Names by SPDX identifier, for notices such as "Licensed under the ...".
NAMES = {
    "GPL-2.0-only": ("GNU General Public License, version 2",), "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",), "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",), "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",), "Unlicense": ("Unlicense",), "0BSD": ("BSD Zero Clause License",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    **{f"CC-{code}-{version}": (f"CC {code} {version}", f"Creative Commons {name} {version} {place} License")
       for code, name in (
           ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
           ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
       for version, place in (("3.0", "Unported"), ("4.0", "International"))},
}
SPDX = (*NAMES, *(f"{x}-or-later" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
        "MIT", "MIT-0", "Apache-2.0", "GPL-3.0-only", "LGPL-2.0-only", "MPL-1.1", "EPL-1.0", "BSD-4-Clause", "Artistic-2.0", "EUPL-1.2", "WTFPL", "PostgreSQL", "PSF-2.0", "OFL-1.1")
#: As older headers have it: GPL-2.0 and GPL-2.0+.
OLD_SPDX = {f"{kind}-{v}{mark}": f"{kind}-{v}-{what}" for kind, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))
            for mark, what in (("", "only"), ("+", "or-later"))}

_USE = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted"
_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} License"
_LATER = "either version {} of the License, or (at your option) any later version"
_KINDS = {"GPL": "General Public", "LGPL": "Lesser General Public", "AGPL": "Affero General Public"}
#: As the sentences stand in the licenses' own headers, which are cut at their colons, semicolons and blank lines.
MORE_SENTENCES = {
    "apache2-copy": ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "gpl-free": (f"{_TERMS.format('General Public')} as published by the Free Software Foundation, {_LATER.format(3)}",),
    "lgpl-later": (f"{_TERMS.format('Lesser General Public')} as published by the Free Software Foundation, {_LATER.format(3)}",),
    "agpl-later": (f"{_TERMS.format('Affero General Public')} as published by the Free Software Foundation, {_LATER.format(3)}",),
    **{f"{kind.lower()}-terms": (f"{_TERMS.format(name)} as published by the Free Software Foundation",) for kind, name in (*_KINDS.items(), ("LGPL-library", "Library General Public"))},
    **{f"gnu-later-{v}": (_LATER.format(v),) for v in ("2", "2.1", "3")},
    "gpl2-terms": (f"{_TERMS.format('General Public')} version 2 as published by the Free Software Foundation", f"{_TERMS.format('General Public')}, version 2, as published by the Free Software Foundation"),
    "mpl-form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v",),
    "mpl2-copy": tuple(f"If a copy of the MPL was not distributed with this file, You can obtain one at {x}://mozilla.org/MPL/2.0/" for x in ("http", "https")),
    "isc-grant": tuple(f"{_USE.format(x)}, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and", "and/or")),
    "0bsd-grant": (_USE.format("and/or"),),
    "unlicense-free": ("This is free and unencumbered software released into the public domain",),
    "cc0-waiver": tuple(f"To the extent possible under law, the author(s) {x} dedicated all copyright and related and neighboring rights to this software to the public domain worldwide" for x in ("have", "has")),
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions",),
    "bsl-notice": ("Distributed under the Boost Software License, Version 1.0",),
    "epl2-terms": tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {x}" for x in ("https://www.eclipse.org/legal/epl-2.0", "http://www.eclipse.org/legal/epl-2.0", "https://www.eclipse.org/legal/epl-2.0/")),
    **{f"named-{x}": tuple(f"{start} {article}{name}" for name in names for start in ("Licensed under", "Released under", "This work is licensed under", "This project is licensed under") for article in ("", "the ", "a "))
       for x, names in NAMES.items()},
    **{f"spdx-{x}": (f"SPDX-License-Identifier {x}",) for x in (*SPDX, *OLD_SPDX)},
}
ALL_SENTENCES = {name: SENTENCES.get(name, ()) + MORE_SENTENCES.get(name, ()) for name in (*SENTENCES, *MORE_SENTENCES)}
ALL_RULES = (
    *RULES,
    ("GPL-2.0-or-later", ("gpl-terms", "gnu-later-2")), ("GPL-3.0-or-later", ("gpl-terms", "gnu-later-3")), ("GPL-2.0-only", ("gpl2-terms",)),
    ("LGPL-2.0-or-later", ("lgpl-library-terms", "gnu-later-2")), ("LGPL-2.0-or-later", ("lgpl-terms", "gnu-later-2")), ("LGPL-2.1-or-later", ("lgpl-terms", "gnu-later-2.1")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "gnu-later-3")), ("LGPL-3.0-or-later", ("lgpl-later",)),
    ("AGPL-3.0-or-later", ("agpl-terms", "gnu-later-3")), ("AGPL-3.0-or-later", ("agpl-later",)),
    ("MPL-2.0", ("mpl-form", "mpl2-copy")), ("MPL-2.0", ("mpl2-copy",)), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",)), ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waiver",)), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("bsl-notice",)), ("EPL-2.0", ("epl2-terms",)),
    *((x, (f"named-{x}",)) for x in NAMES), *((OLD_SPDX.get(x, x), (f"spdx-{x}",)) for x in (*SPDX, *OLD_SPDX)),
)
SPDX_TAG = r"(?i)(SPDX-License-Identifier):[ \t]*"  # its colon ends no sentence


def _known(sentences: Mapping[str, Sequence[str]]) -> dict[str, str]:
    known = {}  # a sentence that two identifiers claim stays with the first
    for name, forms in sentences.items():
        for form in forms:
            known.setdefault(normalised(form), name)
    return known


def _identifier(sentence: Column, table: Mapping[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(known, F.trim(F.regexp_replace(F.lower(sentence), OTHER, " ")))


def sentence_ids(text: Column, table: Mapping[str, str]) -> Column:
    """Identifiers of the known sentences (normalised sentence to identifier) of a text, in order.

    A sentence ends at a mark followed by white space, or at a blank line; one that is not known as a
    whole, its line ends read as spaces, is looked up line by line.
    """
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPDX_TAG, "$1 "), ENDS, "$1" + MARK), BLANK, MARK)

    def found(sentence: Column) -> Column:
        lines = F.filter(F.transform(F.split(sentence, "\n"), lambda line: _identifier(line, table)), lambda x: x.isNotNull())
        return once(_identifier(sentence, table), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(lines))

    return F.flatten(F.transform(F.split(marked, MARK), found))


def _read(ids: Column, ordered: Sequence[Rule]) -> Column:
    """(left, licenses) after all rules, from identifiers as `` a b c ``."""
    rules = F.array(*[F.struct(F.lit(license_).alias("license"), F.lit(f" {' '.join(names)} ").alias("names")) for license_, names in ordered])
    start = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("licenses"))
    return F.aggregate(rules, start, lambda state, rule: F.when(
        F.contains(state["left"], rule["names"]),
        F.struct(F.replace(state["left"], rule["names"], F.lit(" | ")).alias("left"), F.array_append(state["licenses"], rule["license"]).alias("licenses")),
    ).otherwise(state))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: Mapping[str, Sequence[str]] = ALL_SENTENCES, rules: Sequence[Rule] = ALL_RULES,
) -> DataFrame:
    """(key, sentences array, licenses array) of every row.

    The column ``sentences`` has the identifiers of the known ``sentences`` (identifier to its forms) in
    order, repeats included; ``licenses`` what ``rules`` read from them, in the order of the rules and each once: a rule fits where its identifiers
    follow one another, other sentences between them notwithstanding. Null and empty texts hold none;
    every row is judged on its own, over its whole text, so repeated rows and null keys need no care;
    other columns are not read.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    table = _known(sentences)
    # Sentences of the caller's own may hold no hint; then every text is looked through.
    sure = all(re.search(HINTS.removeprefix("(?i)"), s) for s in table)
    hinted = F.coalesce(F.col("_text").rlike(HINTS), F.lit(False)) if sure else F.col("_text").isNotNull()
    found = slim.select("_key", F.when(hinted, sentence_ids(F.col("_text"), table)).otherwise(F.array().cast("array<string>")).alias("sentences"))
    sequence = F.concat(F.lit(" "), F.array_join("sentences", " "), F.lit(" "))
    return found.select(
        F.col("_key").alias(key), "sentences", F.when(F.size("sentences") > 0, F.array_distinct(_read(sequence, rules)["licenses"])).otherwise(F.array().cast("array<string>")).alias("licenses"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scan_sql() -> str:
    """The same over ``documents``, arrays joined by spaces."""
    norm = f"trim(regexp_replace(lower({{}}), '{OTHER}', ' ', 'g'))"
    known, names = ("[" + ", ".join(map(_text, x)) + "]" for x in (KNOWN, KNOWN.values()))
    look = f"list_extract({names}, list_position({known}, {norm}))"
    steps, last = [], "sequence"
    for i, (license_, names) in enumerate(RULES):
        pattern = _text(f" {' '.join(names)} ")
        steps.append(
            f"step{i} AS (SELECT doc_id, ids, replace(rest, {pattern}, ' | ') AS rest, "
            f"CASE WHEN contains(rest, {pattern}) THEN list_append(found, {_text(license_)}) ELSE found END AS found FROM {last})")
        last = f"step{i}"
    return f"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '{ENDS}', '\\1' || chr(30), 'g'), '{BLANK}', chr(30), 'g'), chr(30))) AS sentence,
    generate_subscripts(string_split(regexp_replace(regexp_replace(text, '{ENDS}', '\\1' || chr(30), 'g'), '{BLANK}', chr(30), 'g'), chr(30)), 1) AS place
  FROM documents WHERE text IS NOT NULL
), looked AS (
  SELECT doc_id, place, CASE WHEN {look.format('sentence')} IS NOT NULL THEN [{look.format('sentence')}]
    ELSE list_filter(list_transform(string_split(sentence, chr(10)), lambda x: {look.format('x')}), lambda x: x IS NOT NULL) END AS ids FROM cut
), gathered AS (
  SELECT doc_id, flatten(list(ids ORDER BY place)) AS ids FROM looked GROUP BY doc_id
), sequence AS (
  SELECT d.doc_id, coalesce(g.ids, []) AS ids, ' ' || array_to_string(coalesce(g.ids, []), ' ') || ' ' AS rest, CAST([] AS VARCHAR[]) AS found
  FROM documents d LEFT JOIN gathered g ON d.doc_id = g.doc_id
), {", ".join(steps)}
SELECT doc_id, array_to_string(ids, ' ') AS sentences, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' ') AS licenses FROM {last}
"""
