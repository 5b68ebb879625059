"""Licence texts and headers as files have them."""

import pytest

from trisearch.llm import licenses

MIT = """The MIT License (MIT)

Copyright (c) 2019 A. Uthor

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright 2012 Some People. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
APACHE = """/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package a;
"""
GNU = """# This {what} is free software{mark} you can redistribute it and/or modify
# it under the terms of the GNU {name}General Public License as published by
# the Free Software Foundation{sign} either version {version} of the License, or
# (at your option) any later version.
#
# This {what} is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {name}General Public License for more details.
"""
gnu = lambda what, mark, name, sign, version: GNU.format(what=what, mark=mark, name=name, sign=sign, version=version)
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


@pytest.mark.parametrize("end", ["\n", "\r\n", " "])
def test_texts(spark, end):
    texts = [
        (MIT, "MIT", "mit-grant mit-condition mit-warranty mit-liability"),
        (BSD3, "BSD-3-Clause", "rights-reserved bsd-redistribution bsd-source bsd-binary bsd-endorsement bsd-warranty"),
        (BSD, "BSD-2-Clause", "rights-reserved bsd-redistribution bsd-source bsd-binary"),
        (ISC, "ISC", "isc-grant isc-warranty"),
        (APACHE, "Apache-2.0", "apache-2.0-notice-2 apache-2.0-copy apache-2.0-law apache-2.0-see"),
        (gnu("program", ";", "", ";", "2"), "GPL-2.0-or-later", "gpl-2.0-free gpl-hope gpl-details"),
        (gnu("program", ":", "", ",", "3"), "GPL-3.0-or-later", "gpl-free gpl-hope gpl-details"),
        (gnu("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1-or-later", "lgpl-2.1-free lgpl-hope lgpl-details"),
        (gnu("program", ":", "Affero ", ",", "3"), "AGPL-3.0-or-later", "agpl-3.0-free gpl-hope agpl-details"),
        (MPL, "MPL-2.0", "mpl-2.0-notice mpl-2.0-copy"),
        ("# SPDX-License-Identifier: GPL-2.0-only\nimport os", "GPL-2.0-only", "spdx-gpl-2.0-only"),
        ("Terms.\n\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0", "cc-by-nc-sa-4.0"),
    ]
    if end == " ":  # joined into one line without list numbers and comment marks
        texts = [t for t in texts if t[0] in (MIT, ISC)]
    rows = [(i, t.replace("\n", end)) for i, (t, _, _) in enumerate(texts)]
    got = {r.doc_id: (r.license, r.sentences) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    if end == " ":
        # The grant follows the copyright line without a sentence's end between them.
        assert [got[i][1] for i in (0, 1)] == ["mit-condition mit-warranty mit-liability", "isc-grant isc-warranty"]
    else:
        assert got == {i: (name, sentences) for i, (_, name, sentences) in enumerate(texts)}


def test_numbers_that_are_no_list(spark):
    text = "This work is licensed under the GNU General Public License, version\n3. More.\n\n1) All rights reserved."
    (row,) = licenses.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.sentences == "gpl-3.0-notice rights-reserved"


def test_a_very_long_text(spark):
    text = "word " * 200_000 + "\n" * 100_000 + "All rights reserved." + " " * 500_000 + "x" * 500_000
    (row,) = licenses.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.license == "all-rights-reserved"
