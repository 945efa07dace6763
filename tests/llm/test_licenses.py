import re

from check import compare, connect

from shelfsift.llm import licenses
from shelfsift.llm.queries import QUERIES, SQL


def brute(text):
    ids = []
    for sentence in re.split(licenses.MARK, re.sub(licenses.BLANK, licenses.MARK, re.sub(licenses.ENDS, r"\1" + licenses.MARK, text or ""))):
        whole = licenses.KNOWN.get(licenses.normalised(sentence))
        ids += [whole] if whole else [x for x in map(licenses.KNOWN.get, map(licenses.normalised, sentence.split("\n"))) if x]
    left, found = f" {' '.join(ids)} ", []
    for name, names in licenses.RULES:
        pattern = f" {' '.join(names)} "
        if pattern in left:
            left = left.replace(pattern, " | ")
            found.append(name)
    return ids, list(dict.fromkeys(found))


S = {k: v[0] for k, v in licenses.SENTENCES.items()}
MIT = f"The MIT License (MIT)\n\nCopyright (c) X\n\n{S['mit-grant']}:\n\n{S['mit-condition']}."
TEXTS = [
    None, "", "no rights", MIT, MIT.replace("software", "software\n"), S["mit-grant"] + ": " + S["bsd-grant"] + ". " + S["mit-condition"], f"{S['mit-condition']}. {S['mit-grant']}:",
    "Text end.\nReleased under the MIT License.", "no stop\nReleased under the MIT License\nmore", "Licensed under the Apache License, Version 2.0. Then LICENSED UNDER CC BY-NC 4.0!",
    f"{S['apache2-notice']}; {S['apache2-comply']}. {S['apache2-copy']}", f"{S['bsd-grant']}: {S['bsd-source']}. {S['bsd-binary']}. {S['bsd-endorse']}.",
    f"{S['bsd-grant']}: {S['bsd-source']}. x. {S['bsd-binary']}. All rights reserved. All rights reserved.", "filler words " * 20_000 + ". Released under the MIT License.",
]


def test_every_sentence_has_a_hint_and_every_rule_its_sentences():
    assert all(re.search(licenses.HINTS.removeprefix("(?i)"), s, re.I) for forms in licenses.SENTENCES.values() for s in forms)
    assert {x for _, names in licenses.RULES for x in names} <= set(licenses.SENTENCES)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, sentences int")
    got = {r["doc_id"]: (r["sentences"], r["licenses"]) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[3][1] == ["MIT"] and got[4][1] == ["MIT"] and got[6][1] == []


def test_equals_sql(spark, folder):
    assert compare(QUERIES["op2_license_sentences"](spark, folder), connect(folder), SQL["op2_license_sentences"]) is None


def test_edges(spark):
    docs = spark.createDataFrame([(None, "All rights reserved."), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["licenses"]) for r in licenses.scan(docs).collect()) == [(0, ["LicenseRef-all-rights-reserved"]), (1, []), (1, [])]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_sentences_over_line_ends_tabs_and_comment_marks(spark):
    cases = [(name, s.replace(" ", gap)) for name, forms in licenses.SENTENCES.items() for s in forms for gap in ("\n", "\t", "  ", "\n# ", "\r\n * ") if not re.search(licenses.ENDS, s)]
    docs = spark.createDataFrame([(i, f"# {text}.") for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["sentences"] for r in licenses.scan(docs).collect()}
    assert got == {i: [name] for i, (name, _) in enumerate(cases)}


GNU = "This {0} is free software{1} you can redistribute it and/or modify\n it under the terms of the GNU {2} License as published by\n the Free Software Foundation{3} either version {4} of the License, or\n (at your option) any later version.\n\nThis {0} is distributed in the hope that it will be useful,"
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law"),
    ("GPL-3.0-or-later", GNU.format("program", ":", "General Public", ",", 3)), ("GPL-2.0-or-later", GNU.format("program", ";", "General Public", ";", 2)),
    ("LGPL-2.1-or-later", GNU.format("library", ";", "Lesser General Public", ";", 2.1)), ("LGPL-3.0-or-later", GNU.format("program", ":", "Lesser General Public", ",", 3)),
    ("AGPL-3.0-or-later", GNU.format("program", ":", "Affero General Public", ",", 3)),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free"), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is licensed under CC0 1.0 Universal."), ("GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0\n#include"), ("MIT", "/* SPDX-License-Identifier: MIT */\nint x;"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin"),
]


def test_headers_as_the_licenses_have_them(spark):
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(HEADERS)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [rows[i]["licenses"] for i in range(len(HEADERS))] == [[name] for name, _ in HEADERS]
    assert rows[0]["sentences"] == ["apache2-notice", "apache2-comply", "apache2-copy"]


def test_own_sentences_and_rules(spark):
    assert {x for _, names in licenses.ALL_RULES for x in names} <= set(licenses.ALL_SENTENCES)
    assert all(re.search(licenses.HINTS.removeprefix("(?i)"), s) for s in licenses._known(licenses.ALL_SENTENCES))
    docs = spark.createDataFrame([(1, "Mine alone. All rights reserved.")], "doc_id long, text string")
    row = licenses.scan(docs, sentences={"own": ("Mine alone",)}, rules=[("LicenseRef-own", ("own",))]).first()
    assert (row["sentences"], row["licenses"]) == (["own"], ["LicenseRef-own"])
