"""Licence sentences alone, in prose, and wrapped over lines as in licence files and source headers."""

import textwrap

from trisearch.llm import licenses


def test_every_sentence_is_found_alone_in_prose_and_wrapped(spark):
    rows, expected = [], {}
    for name, text in licenses.SENTENCES.items():
        end = "\n\n" if name == "apache-2.0-copy" else "\n"
        forms = [text, f"Some words first. {text}{end}And more words."]
        for mark in ("", " * ", "// ", "# ", "dnl ", "REM "):
            for width in (30, 78):
                lines = textwrap.wrap(text, width)
                forms.append("\n".join(mark + x for x in lines))
                forms.append(f"{mark}Words before.\n{mark.rstrip()}\n" + "\r\n".join(mark + x for x in lines) + f"\n{mark.rstrip()}\n{mark}Words after.")
        for form in forms:
            expected[len(rows)] = name
            rows.append((len(rows), form))
    got = {r.doc_id: r.sentences for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (got.get(i), rows[i][1]) for i in expected if got.get(i) != expected[i]} == {}


def test_rules_over_wrapped_texts(spark):
    known = licenses.SENTENCES
    wrap = lambda *names, mark="": f"\n{mark.rstrip()}\n".join("\n".join(mark + x for x in textwrap.wrap(known[n], 76)) for n in names)
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 X\n\n" + wrap("mit-grant", "mit-condition", "mit-warranty")),
        (2, wrap("apache-2.0-notice-2", mark=" * ") + "\n" + wrap("apache-2.0-copy", mark=" * ") + "\n *\n *     http://www.apache.org/licenses/LICENSE-2.0"),
        (3, "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        (4, wrap("mit-grant") + "\n\nUnknown words.\n\n" + wrap("mit-condition")),
        (5, "Licensed under the Apache\n\nLicense, Version 2.0."),
        (6, "Licensed under: the MIT\nLicense."),
    ]
    got = {r.doc_id: r.license for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "MPL-2.0", 4: None, 6: "MIT"}
