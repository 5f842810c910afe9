import re

import duckdb
from fixtures import awkward, frame

from sparkrecall.llm import licenses, oracles, queries

SF0001 = "/root/testdata/sf0.001"


def found(spark, pairs):
    return sorted((tuple(r) for r in licenses.scan(frame(spark, pairs)).collect()), key=str)


def test_every_rule_has_an_anchor():
    known, rules = licenses.rule_table()
    assert all(any(a in known[i - 1] for i in ids for a in licenses.ANCHORS) for _, _, ids in rules)
    assert [len(ids) for _, _, ids in rules][0] == 3 and len(set(known)) == len(known)


def test_each_rule_is_found(spark):
    pairs, want = [], []
    names = [(licence, f"{rule}_statement", (f"The program is licensed under the {n}.",)) for licence, rule, x in licenses.NAMES for n in x]
    for i, (licence, rule, sentences) in enumerate((*licenses.RULES, *names)):
        pairs += [(2 * i, "Some words first.\n" + "\n".join(sentences) + "\nThe end."),
                  (2 * i + 1, re.sub(" ", "\n  ", "Intro text here. " + " ".join(sentences) + " And more."))]
        want += [(2 * i, licence, rule), (2 * i + 1, licence, rule)]
    assert [r[:3] for r in found(spark, pairs)] == sorted(want, key=str)


MIT = """MIT License

Copyright (c) 2020 Jane Doe

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
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """A program that does one thing
Copyright (C) 2020  Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
ISC = """ISC License

Copyright (c) 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """Copyright 2020 Jane Doe
/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_published_files(spark):
    gpl2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    files = [(MIT, "MIT", 3), (APACHE, "Apache-2.0", 3), (GPL, "GPL-3.0-or-later", 3), (gpl2, "GPL-2.0-or-later", 3), (ISC, "ISC", 1), (MPL, "MPL-2.0", 3)]
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"),
             lambda t: re.sub("(?m)^", "# ", t), lambda t: "/*\n" + re.sub("(?m)^", " * ", t) + "/\nint main(void);\n",
             lambda t: re.sub(r"(?<!\n)\n(?!\n)", " ", t) if t != MPL else t,  # paragraphs as one line each
             lambda t: re.sub(r"\n\n+", "\n", t)]  # no blank line after the copyright line
    pairs = [(i, form(t)) for i, (form, (t, _, _)) in enumerate((f, x) for f in forms for x in files)]
    want = [(i, licence, n) for i, (licence, n) in enumerate((x[1], x[2]) for _ in forms for x in files)]
    assert [(r[0], r[1], r[3]) for r in sorted(found(spark, pairs))] == want


BSD = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY JANE DOE AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL JANE DOE BE LIABLE FOR ANY DIRECT, INDIRECT DAMAGES.
"""


def test_texts_with_slots(spark):
    bsd3 = BSD.replace("Example Inc.", "the Example Company")
    bsd2 = re.sub(r"3\. .*?permission\.\n", "", BSD, flags=re.S)
    lgpl = GPL.replace("program", "library").replace("General", "Lesser General").replace("version 3", "version 2.1")
    agpl = GPL.replace("This program", "Foo Bar").replace("General", "Affero General")
    for form in (lambda t: t, lambda t: re.sub(r"(?m)^(\d)\.", "*", t), lambda t: re.sub("(?m)^", " * ", t)):
        rows = found(spark, list(enumerate(map(form, (bsd3, bsd2, lgpl, agpl)))))
        assert [r[:3] for r in rows if r[1] != "Proprietary"] == [
            (0, "BSD-3-Clause", "bsd3_text"), (1, "BSD-2-Clause", "bsd2_text"),
            (2, "LGPL-2.1-or-later", "lgpl2.1_header"), (3, "AGPL-3.0-or-later", "agpl3_header")]


STATEMENTS = {
    "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "/* SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause) */": "BSD-3-Clause GPL-2.0-or-later",
    "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only", "<!-- SPDX-License-Identifier: CC-BY-NC-SA-4.0 -->": "CC-BY-NC-SA-4.0",
    "This code is under the MIT license.": "MIT", "Foo is released under the MIT License.": "MIT", "License: Apache-2.0": "Apache-2.0",
    "The project is licensed under the Apache License, Version 2.0.": "Apache-2.0", "Foo Bar is distributed under the terms of the GPLv3.": "GPL-3.0-only",
    "It is licensed under either the MIT License or the Apache License 2.0, see LICENSE for details.": "Apache-2.0 MIT",
    "Dual licensed under MIT and GPL v2 or later.": "GPL-2.0-or-later MIT", "All text is available under the Creative Commons Attribution-Share Alike 3.0 Unported license": "CC-BY-SA-3.0",
    "Published under CC BY-ND 2.5.": "CC-BY-ND-2.5", "Released under MIT.": "MIT", "The library is released under the new\nBSD\nlicence.": "BSD-3-Clause",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0", "Released under the\nMozilla Public License, version 2.0.": "MPL-2.0",
    "Licensed under the GNU Lesser General Public License v2.1 only.": "LGPL-2.1-only", "The fonts are covered by nothing. They are shared under the Boost Software License 1.0.": "BSL-1.0"}
PROSE = ["The MIT License is short, and many firms like it.", "If the project is licensed under the MIT License, you may sell it.",
         "Many projects are licensed under the MIT License.", "The project is not licensed under the MIT License.",
         "He was licensed under the state law of Ohio to drive a bus.", "In 2015 parts of it were released under the Apache License, Version 2.0.",
         "She asked whether the code is released under the GPL.", "The bar is licensed under the rules of the town.", "Our MIT course is open.",
         "BSD and GPL licences differ in how they treat derived works.", "They argued under the MIT dome about copyright and permission.",
         "Is this licensed under the MIT License?", "The driving licence costs 40 euros.", "The film was published under the title Apache 2."]


def test_statements_and_prose(spark):
    pairs = [*enumerate(STATEMENTS), *[(100 + i, x) for i, x in enumerate(PROSE)]]
    rows = found(spark, pairs)
    assert {i: " ".join(sorted(r[1] for r in rows if r[0] == i)) for i, _ in pairs} == {
        i: x for i, x in [*enumerate(STATEMENTS.values()), *[(100 + i, "") for i in range(len(PROSE))]]}


def test_oracle_on_rules_of_several_sentences(spark):
    pairs = [(i, ("Some words.\n" if i % 2 else "") + re.sub(" ", "\n" if i % 3 else " ", " ".join(x)) + " And more.")
             for i, (_, _, x) in enumerate(licenses.RULES)]
    pairs += [(1000 + i, x) for i, x in enumerate([*STATEMENTS, *PROSE])]
    a, b, c = licenses.RULES[1][2]
    pairs += [(2001, f"{b} {a} {c}"), (2002, f"{a} something else. {b} {c}"), (2003, f"{a} All rights reserved. {b} {c}"), (2004, None), (2005, "")]
    docs = frame(spark, pairs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = con.sql(oracles.ORACLES["op8_license_scan"]).select("doc_id, licence, rule, n_sentences").fetchall()
    assert sorted(map(tuple, licenses.scan(docs).collect())) == sorted(want)
    assert len(want) > len(licenses.RULES)


def test_order_and_gaps(spark):
    a, b, c = licenses.RULES[1][2]
    pairs = [(1, f"{a} {b} {c}"), (2, f"{b} {a} {c}"), (3, f"{a} something else. {b} {c}"), (4, f"{a} All rights reserved. {b} {c}"),
             (5, "no line\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license!"),
             (6, "It was released under the mit license. Really"), (7, "Unreleased under the MIT License."), (8, "ALL RIGHTS RESERVED")]
    assert found(spark, pairs) == [(1, "Apache-2.0", "apache_header", 3), (3, "Apache-2.0", "apache_header", 3),
                                   (4, "Proprietary", "all_rights_reserved", 1), (5, "CC-BY-NC-4.0", "cc_statement", 1),
                                   (5, "MIT", "mit_statement", 1), (8, "Proprietary", "all_rights_reserved", 1)]


def test_awkward(spark):
    pairs = [*awkward(), (None, "All rights reserved."), (77_777, "All rights reserved."), (77_777, "All rights reserved."),
             (99_999, "x " * 200_000 + ".\nAll rights reserved.")]
    hits = [r for r in found(spark, pairs)]
    assert sorted([r[0] for r in hits], key=str) == [77_777, 77_777, 99_999, None]
    assert licenses.scan(frame(spark, pairs).limit(0)).count() == 0


def test_native(spark):
    plan = queries.op8_license_scan(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)


def test_oracle(spark):
    columns = "doc_id, licence, rule, n_sentences"
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    want = duckdb.sql(oracles.ORACLES["op8_license_scan"]).select(columns).fetchall()
    got = queries.op8_license_scan(spark, SF0001).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
