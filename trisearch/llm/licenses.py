"""Licence recognition by sentences, in DataFrame functions only.

A text's sentences are normalised and looked up among known licence sentences,
over line ends and comment marks too; the sequence of their identifiers is matched
against ordered rules. All of it happens within a row, so nothing is shuffled and no
group can grow large.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Identifiers and sentences of public licence texts and notices.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-2.0-copy": "You may obtain a copy of the License at",
    "apache-2.0-law": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this program.",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-release": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
    "spdx-gpl-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl-2.1-or-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-agpl-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "rights-reserved": "All rights reserved.",
}

#: Rules in order: a licence and the identifiers that must follow each other.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT-0", ["mit-0-grant", "mit-warranty"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-2.0-notice-2", "apache-2.0-copy"]),
    ("Apache-2.0", ["apache-2.0-law", "apache-2.0-see"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-free"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-free"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-2.0-free"]),
    ("GPL-2.0-only", ["gpl-2.0-only-free"]),
    ("GPL-3.0", ["gpl-3.0-notice"]),
    ("GPL-2.0", ["gpl-2.0-notice"]),
    ("MPL-2.0", ["mpl-2.0-notice"]),
    ("EPL-2.0", ["epl-2.0-notice"]),
    ("BSL-1.0", ["boost-1.0-notice"]),
    ("Unlicense", ["unlicense-release", "unlicense-grant"]),
    ("Zlib", ["zlib-warranty"]),
    ("Zlib", ["zlib-grant"]),
    ("Apache-2.0", ["apache-2.0-notice-2"]),
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD", ["rights-reserved", "bsd-redistribution"]),
    ("BSD", ["bsd-redistribution"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4.0"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4.0"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0"]),
    ("CC-BY-4.0", ["cc-by-4.0"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-notice"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache-2.0"]),
    ("BSD-2-Clause", ["spdx-bsd-2-clause"]),
    ("BSD-3-Clause", ["spdx-bsd-3-clause"]),
    ("ISC", ["spdx-isc"]),
    ("MPL-2.0", ["spdx-mpl-2.0"]),
    ("GPL-2.0-only", ["spdx-gpl-2.0-only"]),
    ("GPL-2.0-or-later", ["spdx-gpl-2.0-or-later"]),
    ("GPL-3.0-only", ["spdx-gpl-3.0-only"]),
    ("GPL-3.0-or-later", ["spdx-gpl-3.0-or-later"]),
    ("LGPL-2.1-or-later", ["spdx-lgpl-2.1-or-later"]),
    ("AGPL-3.0-or-later", ["spdx-agpl-3.0-or-later"]),
    ("all-rights-reserved", ["rights-reserved"]),
]


#: Steps that make text with A-Z lowered ASCII words, one space between them, and breaks, in capitals: H where a
#: sentence ends (. ! ? and white space, a blank line), S where one may end (a line end, a colon and white space).
STEPS = [
    (r"[.!?](?=[ \t\r\n])", "H"),
    (r":(?=[ \t\r\n])", "C"),
    (r"(?:\n|^)(?:[ \t]*@?(?:dnl|rem)(?=[ \t\r\n]))?", "N"),
    (r"[^a-z0-9HCN]+", " "),
    (r"(?: ?C)++ ?", "C"),
    (r"[ C]?(?:N[ C]?N|N?[ C]?H)[ HCN]*+", "H"),
    (r"[ C]?N[ C]?|C", "S"),
    (r"^[ HS]*+", "H"),
    (r"[ HS]*+$", "H"),
]


#: The number of an item of a list, after a sentence's end or a colon and a line end: H and C as in the first STEPS.
ITEM = r"([HC][ \t\r]*\n[ \t\r\n*#/;%-]*+)\(?[0-9]{1,2}(?:H|\))(?=[ \t])"


def broken(text: Column) -> Column:
    """The words and breaks of a text, with a break at both ends, without the numbers of lists."""
    found = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for i, (step, by) in enumerate(STEPS):
        if i == 2:
            found = F.regexp_replace(found, ITEM, "$1")
        found = F.regexp_replace(found, step, by)
    return found


def _broken(text: str) -> str:
    found = text.translate(str.maketrans(UPPER, LOWER))
    for step, by in STEPS:
        found = re.sub(step, by, found)
    return found


def _pattern(sentence: str) -> str:
    """Where a known sentence stands: it may be wrapped, and ends inside it are its own."""
    return _broken(sentence).strip("HS").replace("S", " ").replace(" ", "[ S]").replace("H", "[ HS]")


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def recognise(docs: DataFrame, known: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, n_sentences, sentences, licenses, license) of each row of docs (doc_id, text) that holds a known sentence.

    sentences: the identifiers of the known sentences in order, joined by spaces.
    A sentence may be wrapped over lines, with comment marks before them; a line alone is one, too.
    A rule fits if its identifiers come one right after another, with no unknown
    sentence between. licenses: the names of the rules that fit, in the rules'
    order, each once, joined by spaces; license: the first, null if none fits.
    Texts that are null, empty or without a known sentence give no row; null ids and
    repeated rows are kept; an empty table gives an empty one; other columns are
    ignored. known and rules are small lists, written into the plan.
    """
    known, rules = SENTENCES if known is None else known, RULES if rules is None else rules
    by_text = {_normal(s): k for k, s in reversed(known.items()) if _normal(s)}
    names = list(by_text.values())
    if any(" " in x or "|" in x for x in [*names, *(n for n, _ in rules)]):
        raise ValueError("identifiers and licence names hold no spaces or bars")
    # The longest first: a notice may begin another.
    patterns = sorted(((_pattern(known[k]), i) for i, k in enumerate(names)), key=lambda p: (-len(p[0]), p[1]))
    # Inner names that docs cannot clash with: only the two columns are read.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), broken(F.col("text")).alias("broken"))
    found = found.where(F.col("broken").rlike("(?<=[HS])(?:" + "|".join(p for p, _ in patterns) + ")(?=[HS])") if patterns else F.lit(False))
    marks = F.col("broken")
    for p, i in patterns:
        marks = F.regexp_replace(marks, f"(?<=[HS]){p}(?=[HS])", f"K{i + 1}")
    at = F.transform(F.filter(F.split(marks, "[HS]"), lambda s: s != ""), lambda s: F.when(s.startswith("K"), F.substring(s, 2, 9).cast("int")).otherwise(F.lit(0)))
    found = found.select("doc_id", at.alias("at"))
    name = lambda i: F.when(i > 0, F.element_at(F.array(*map(F.lit, names)), i)).otherwise(F.lit(""))
    found = found.withColumn("ids", F.transform("at", name))
    marked = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))
    fitting = [F.when(F.contains("marked", F.lit("|" + "|".join(seq) + "|")), F.lit(licence)) for licence, seq in rules]
    found = found.withColumn("marked", marked).withColumn("fit", F.array_distinct(F.array_compact(F.array(*fitting))))
    ids = F.filter("ids", lambda s: s != "")
    return found.select("doc_id", F.size(ids).cast("long").alias("n_sentences"), F.array_join(ids, " ").alias("sentences"), F.array_join("fit", " ").alias("licenses"), F.get("fit", F.lit(0)).alias("license"))


def sql(table: str = "documents") -> str:
    """DuckDB SQL for recognise() with SENTENCES and RULES."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    by_text = {_normal(s): k for k, s in reversed(SENTENCES.items())}
    texts, names = (", ".join(map(quote, x)) for x in (by_text, by_text.values()))
    fits = ", ".join(f"CASE WHEN contains(marked, {quote('|' + '|'.join(seq) + '|')}) THEN {quote(name)} END" for name, seq in RULES)
    return rf"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS sentences
  FROM {table}
), i AS (
  SELECT doc_id, list_transform(sentences, lambda x: CASE WHEN list_contains([{texts}], x) THEN [{names}][list_position([{texts}], x)] ELSE '' END) AS ids FROM s
), m AS (
  SELECT doc_id, list_filter(ids, lambda x: x <> '') AS known, '|' || array_to_string(ids, '|') || '|' AS marked FROM i
), f AS (
  SELECT doc_id, known, list_filter([{fits}], lambda x: x IS NOT NULL) AS fit FROM m WHERE len(known) > 0
), d AS (
  SELECT doc_id, known, list_filter(fit, lambda x, k: list_position(fit, x) = k) AS fit FROM f
)
SELECT doc_id, len(known) AS n_sentences, array_to_string(known, ' ') AS sentences, array_to_string(fit, ' ') AS licenses, fit[1] AS license FROM d
"""
