"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences three times: at line ends and sentence ends (for statements
that stand on a line of their own), at sentence ends alone (for wrapped licence texts),
and at sentence ends, paragraph ends (lines without a letter or digit) and before lines
that begin as a rule does (for wrapped texts under titles and copyright lines without a
full stop). Rule sentences that go on over a paragraph end of the published text are
known whole and by their paragraphs; either may stand in a text.
A sentence is normalised (lower case, anything but letters and digits as one space) and
looked up among the known licence sentences; a document becomes the sequence of the
identifiers found. Rules are ordered identifier sequences: a rule matches where its
identifiers follow one another, with no other known sentence between. Rules are tried in
their order, longest first; the first that matches names a licence's evidence.

Statements name a licence in a sentence of their own: a subject of a few words or none, a
verb, "under", and names, joined by "or" or "and"; ``License: X`` and SPDX tags are
statements too. Such a sentence is known by the cleaned name alone ("The project is
licensed under the Apache License, Version 2.0." as "licensed under apache 2"). Clauses
that only ask or tell about licences ("if it is licensed under ...", "was released
under ...") are none. Sentences of licence texts with a slot for a name (the program, the
copyright holder) are known with any name there. A licence that is only a family's name
(BSD) goes where a member of the family is found. Statements without the word licence are
found where they name one of ``UNDER`` or a GPL.

The rules are a fixed table of bounded size that is part of the expressions, so a scan
is one pass without a shuffle. Only texts that hold one of the ``ANCHORS``, one of which
is in a sentence of every rule, or that match ``UNDER`` are cut at all; this leaves out no
match.

A null or empty text and a text without licence gives no row; a document with several
licences gives one row for each. Repeated rows are scanned each; null ids stay null. Other
columns are not read.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import text_of

# Sentences that several licence texts share.
_SOURCE = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.")
_BINARY = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
           "in the documentation and/or other materials provided with the distribution.")
_NEITHER = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
            "from this software without specific prior written permission.")
_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
               "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_FREEDOM_2 = "The licenses for most software are designed to take away your freedom to share and change it."
_FREEDOM_3 = ("The licenses for most software and other practical works are designed to take away your freedom to share and change the works.")
#: Licences of the GNU family: (short name, the names of its text, versions).
GNU = (("GPL", ("General Public",), ("2", "3")), ("LGPL", ("Lesser General Public", "Library General Public"), ("2", "2.1", "3")),
       ("AGPL", ("Affero General Public",), ("3",)))
#: The terms of the Creative Commons licences.
CC_TERMS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}


def _gnu_id(short: str, version: str, kind: str) -> str:
    return f"{short}-{version if '.' in version else f'{version}.0'}-{kind}"


def _gnu_headers() -> list[tuple[str, str, tuple[str, ...]]]:
    """The headers of the GNU licences: the whole header, then its grant alone."""
    whole, alone = [], []
    for short, names, versions in GNU:
        for name, v in product(names, versions):
            rule = f"{short.lower()}{v}"
            terms = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License"
            fsf = "as published by the Free Software Foundation"
            rest = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", f"See the GNU {name} License for more details.")
            for kind, grant in (("or-later", f"{terms} {fsf}, either version {v} of the License, or (at your option) any later version."),
                                ("only", f"{terms} {fsf}, version {v} of the License."), ("only", f"{terms} version {v} {fsf}."),
                                ("only", f"{terms}, version {v}, {fsf}; version {v}.")):
                whole.append((_gnu_id(short, v, kind), f"{rule}_header", (grant, *rest)))
                alone.append((_gnu_id(short, v, kind), f"{rule}_grant", (grant,)))
    return whole + alone


def _gnu_names() -> list[tuple[str, str, tuple[str, ...]]]:
    out = []
    for short, names, versions in GNU:
        low = short.lower()
        forms = [low, f"gnu {low}", *[f"{g}{n.lower()}" for n in names for g in ("", "gnu ")]]
        for v in versions:
            tail = v.replace(".", " ")
            numbered = [x for f in forms for x in (f"{f} {tail}", f"{tail} of {f}")]
            out.append((_gnu_id(short, v, "only"), f"{low}{v}", (*numbered, *[f"{x} only" for x in numbered])))
            out.append((_gnu_id(short, v, "or-later"), f"{low}{v}", tuple(f"{f} {tail} orlater" for f in forms)))
        if short != "AGPL":  # without a version, any version that there is
            out.append((_gnu_id(short, "1" if short == "GPL" else "2", "or-later"), f"{low}_any", tuple(forms)))
    return out


def _cc_names() -> list[tuple[str, str, tuple[str, ...]]]:
    out = []
    for terms, v in product(("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")):
        n = v.removesuffix(".0").replace(".", " ")
        long = " ".join(CC_TERMS[t] for t in terms.split())
        out.append((f"CC-{terms.upper().replace(' ', '-')}-{v}", "cc",
                    (f"cc {terms} {n}", f"creative commons {long} {n}", f"creative commons {terms} {n}", f"creative commons {long} cc {terms} {n}",
                     f"creative commons {long} {n} cc {terms} {n}")))
    return out


# Fixed values: (licence, rule, its sentences in order) from the licences' published texts and usual statements.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "mit_text", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("Apache-2.0", "apache_header", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.")),
    ("ISC", "isc_text", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",)),
    ("BSD-3-Clause", "bsd3_text", (_SOURCE, _BINARY, _NEITHER)),
    ("BSD-2-Clause", "bsd2_text", (_SOURCE, _BINARY, _DISCLAIMER)),
    ("BSD", "bsd_conditions", (_SOURCE, _BINARY)),
    ("BSD", "bsd_disclaimer", (_DISCLAIMER,)),
    ("MPL-2.0", "mpl_header", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")),
    ("Apache-2.0", "apache_text", (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly "
        "perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the "
        "Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent "
        "licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed.",
        "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except "
        "as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.")),
    ("Unlicense", "unlicense_text", (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
    ("Zlib", "zlib_text", (
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.")),
    ("GPL-3.0-only", "gpl3_text", (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.", _FREEDOM_3)),
    ("AGPL-3.0-only", "agpl3_text", (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to "
        "ensure cooperation with the community in the case of network server software.", _FREEDOM_3)),
    ("GPL-2.0-only", "gpl2_text", (
        _FREEDOM_2,
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure "
        "the software is free for all its users.")),
    ("LGPL-2.1-only", "lgpl2.1_text", (
        _FREEDOM_2,
        "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make "
        "sure the software is free for all its users.")),
    ("LGPL-3.0-only", "lgpl3_text", (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public "
        "License, supplemented by the additional permissions listed below.",)),
    *_gnu_headers(),
    ("Proprietary", "all_rights_reserved", ("All rights reserved.",)),
)
# Fixed values: (licence, rule, the names that statements use, cleaned).
NAMES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "mit", ("mit", "expat", "mit expat", "mit x11")),
    ("MIT-0", "mit0", ("mit 0", "mit no attribution")),
    ("Apache-2.0", "apache", ("apache 2", "asl 2")),
    ("BSD-2-Clause", "bsd2", ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd")),
    ("BSD-3-Clause", "bsd3", ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("BSD", "bsd", ("bsd", "bsd style")),
    ("0BSD", "0bsd", ("0bsd", "zero clause bsd")),
    ("MPL-2.0", "mpl", ("mozilla public 2", "mpl 2")),
    ("EPL-1.0", "epl1", ("eclipse public 1", "epl 1")),
    ("EPL-2.0", "epl2", ("eclipse public 2", "epl 2")),
    ("EUPL-1.2", "eupl", ("european union public 1 2", "eupl 1 2")),
    ("ISC", "isc", ("isc",)),
    ("Zlib", "zlib", ("zlib", "zlib libpng")),
    ("Unlicense", "unlicense", ("unlicense",)),
    ("BSL-1.0", "boost", ("boost 1", "boost", "bsl 1")),
    ("WTFPL", "wtfpl", ("wtfpl",)),
    ("Artistic-2.0", "artistic", ("artistic 2",)),
    ("CC0-1.0", "cc0", ("cc0 1", "cc0", "creative commons zero 1", "creative commons zero", "creative commons cc0 1")),
    *_gnu_names(), *_cc_names(),
)
#: Licences that are only a family's name.
FAMILIES = ("BSD",)
#: One of these words is in a sentence of every rule (lower case); single words, as lines may be wrapped.
ANCHORS = ("licen", "permission", "warrant", "copyright", "reserved", "redistribut", "mozilla", "unencumbered", "gpl")
#: Licence names that statements use without the word licence, in lower case.
UNDER = r"under[\x20\x09-\x0D]+(?:the[\x20\x09-\x0D]+)?(?:mit|apache|[023]?-?bsd|cc0|cc|isc|mpl|epl|zlib|wtfpl|boost|creative)\b"
# The patterns below are written for Java and RE2 alike and meet normalised sentences.
_VERB = "(?:licen[sc]ed|released|distributed|published|available|made available|provided|offered|covered|shared)"
#: A statement; its group holds the names.
STATEMENT = ("^(?:(?:(?:[^ ]+ ){1,8}(?:is|are)(?: (?:also|now|dual|both|currently))?(?: " + _VERB + ")?|(?:dual )?" + _VERB + ") under (?:both )?"
             "(?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the )?|(?:dnl |rem )?spdx license identifier |(?:project )?licen[sc]e )"
             "([^ ]+(?: [^ ]+){0,24}?)(?: as published by the free software foundation)?(?: (?:see|read|refer to) .*)?$")
#: Clauses that state nothing.
CLAUSE = ("^(?:that|many|most|some|few|several|no|not|none|once|before|after) |"
          "(?:^| )(?:if|whether|when|because|since|although|which|what|who|how|why|while|until) .*under ")
BETWEEN = " (?:and or|or|and) "
#: What cleans a statement before its names are parted, and then each name, in order.
CLEANING = ((" or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?", " orlater"),)
WORDS = (("\\b(gpl|lgpl|agpl|mpl|epl|apache|asl)v?([0-9])", "$1 $2"), ("\\bv([0-9])", "$1"), (" with .*$", ""),
         ("\\b(?:the|a|an|licen[sc]es?|version|v|international|universal|unported|generic|software)\\b", ""), (" +", " "),
         ("share alike", "sharealike"), ("non commercial", "noncommercial"), ("(?:no derivatives|no derivs|noderivs)", "noderivatives"),
         ("([0-9]) 0( |$)", "$1$2"))
#: Slots of the texts' sentences and what stands there in the known sentences.
SLOTS = (("^(?:[^ ]+ ){1,8}is free software you can redistribute it and or modify it under", "this program is free software you can redistribute it and or modify it under"),
         ("^(?:[^ ]+ ){1,8}is distributed in the hope that", "this program is distributed in the hope that"),
         ("^neither the names? of .{1,100} nor the names of (?:its|their|the) contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
         ("^this software is provided by .{1,100} as is and any express or implied warranties", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
         ("^in no event shall .{1,100} be liable for any claim damages or other liability whether", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether"))
#: Sentence ends: a mark followed by white space.
_END = r"([.!?])[\x20\x09-\x0D]+"
#: Places inside the rules' sentences where the published texts end a paragraph.
_GAP = r"(?<=the following conditions:) |(?<=a copy of the License at) |(?<=licenses/LICENSE-2\.0) "
#: Words by which a line that begins a rule is known.
OPENING_WORDS = 4
#: Cut mark of paragraphs: the character for it.
_PARAGRAPH = "\u2029"


def plain(sentence: str) -> str:
    """A known sentence, normalised as ``normal`` does."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


def _known(sentence: str) -> list[str]:
    """The pieces into which the scan cuts a rule's sentence."""
    return [plain(x) for x in re.sub(_END, "\\1\n", sentence).split("\n")]


def rule_table() -> tuple[list[str], list[tuple[str, str, list[int]]]]:
    """Known sentences (identifier: place + 1) and rules as identifier sequences."""
    known: dict[str, int] = {}
    rules = []
    for licence, rule, sentences in RULES:
        rules.append((licence, rule, [known.setdefault(p, len(known) + 1) for x in sentences for p in _known(x)]))
    for licence, rule, names in NAMES:
        rules += [(licence, f"{rule}_statement", [known.setdefault(f"licensed under {n}", len(known) + 1)]) for n in names]
    return list(known), rules


def joined(parts: list[str]) -> list[list[str]]:
    """All ways to join neighbouring parts."""
    if len(parts) < 2:
        return [parts]
    rest = joined(parts[1:])
    return [[parts[0], *r] for r in rest] + [[f"{parts[0]} {r[0]}", *r[1:]] for r in rest]


def sequences() -> tuple[list[str], list[tuple[str, str, int, str]]]:
    """Known sentences, those cut at paragraph ends included, and (licence, rule, its
    sentences, pattern of its identifier sequence)."""
    known, rules = rule_table()
    places = {k: i + 1 for i, k in enumerate(known)}
    ways = {k: str(i) for k, i in places.items()}
    for s in [p for _, _, x in RULES for y in x for p in re.sub(_END, "\\1\n", y).split("\n")]:
        found = [",".join(str(places.setdefault(plain(p), len(places) + 1)) for p in way) for way in joined(re.split(_GAP, s))]
        ways[plain(s)] = f"(?:{'|'.join(found)})" if len(found) > 1 else found[0]
    return list(places), [(licence, rule, len(ids), f",{','.join(ways[known[i - 1]] for i in ids)},") for licence, rule, ids in rules]


def openings() -> str:
    """Pattern of the line ends before lines that begin as a rule does."""
    words = sorted({tuple(re.findall(r"\w+", x[0])[:OPENING_WORDS]) for _, _, x in RULES})
    return rf"(?i)\n[^\p{{L}}\p{{N}}\n]*+(?=(?:{'|'.join('[^\\p{L}\\p{N}]+'.join(w) for w in words)})(?![\p{{L}}\p{{N}}]))"


def normal(sentence: Column) -> Column:
    low = F.regexp_replace(F.lower(sentence), r"([0-9])\+", "$1 orlater")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def clean_name(name: Column) -> Column:
    for pattern, by in WORDS:
        name = F.regexp_replace(name, pattern, by)
    return F.trim(name)


def listed(values: list[str]) -> Column:
    """A fixed array as one string, so plans stay small; it is parted once, when the plan is made."""
    return F.split(F.lit("\n".join(values)), "\n")


def canonical(s: Column, known: Column) -> Column:
    """The known forms of a normalised sentence: itself with the known names in its
    slots, or one for each licence that a statement names."""
    whole = s
    for pattern, by in CLEANING:
        whole = F.regexp_replace(whole, pattern, by)
    names = F.split(F.regexp_extract(whole, STATEMENT, 1), BETWEEN)
    filled = s
    for pattern, by in SLOTS:
        filled = F.regexp_replace(filled, pattern, by)
    states = (F.length(s) <= 300) & (F.contains(s, F.lit("under ")) | F.contains(s, F.lit("licen"))) & F.rlike(whole, F.lit(STATEMENT))
    return F.when(F.array_contains(known, filled), F.array(filled)).when(states & ~F.rlike(s, F.lit(CLAUSE)), F.transform(names, lambda n: F.concat(F.lit("licensed under "), clean_name(n)))
                  ).otherwise(F.array().cast("array<string>"))


def identifiers(text: Column, known: Column, by: str) -> Column:
    """The identifiers of the known sentences of a text, in order; cut at sentence ends and
    at each 'line', each 'paragraph' or no other place ('end')."""
    mark = _PARAGRAPH if by == "paragraph" else "\n"
    if by == "paragraph":
        text = F.regexp_replace(F.regexp_replace(text, r"\n[^\p{L}\p{N}\n]*+(?=\n)", mark), openings(), mark)
    whole = text if by == "line" else F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    cut = F.split(F.regexp_replace(whole, _END, f"$1{mark}"), mark)
    forms = F.flatten(F.transform(cut, lambda s: canonical(normal(s), known)))
    return F.filter(F.transform(forms, lambda s: F.array_position(known, s).cast("int")), lambda i: i > 0)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, licence, rule and n_sentences: one row for each licence of a document."""
    known, rules = sequences()
    raw = text_of(docs, text)
    low = F.lower(raw)
    any_anchor = F.lit(False)
    for a in ANCHORS:
        any_anchor = any_anchor | F.contains(low, F.lit(a))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), raw.alias("text")).where(any_anchor | F.rlike(low, F.lit(UNDER)))
    cuts = ("line", "end", "paragraph")
    seen = rows.select("doc_id", *[identifiers(F.col("text"), listed(known), by).alias(by) for by in cuts])
    seen = seen.where(" or ".join(f"size({by}) > 0" for by in cuts))
    # one string: no sequence goes on over the blank between two cuts
    ids = F.concat_ws(" ", *[F.concat(F.lit(","), F.array_join(F.col(by).cast("array<string>"), ","), F.lit(",")) for by in cuts])
    seen = seen.select("doc_id", ids.alias("ids"), F.array_distinct(F.concat(*cuts)).alias("each"))
    single = {int(p[1:-1]): i for i, (_, _, _, p) in reversed(list(enumerate(rules))) if p[1:-1].isdigit()}
    single_rules = listed([str(single.get(k, -1)) for k in range(1, len(known) + 1)])
    alone = F.filter(F.transform("each", lambda k: F.get(single_rules, k - 1).cast("int")), lambda i: i >= 0)
    ordered = F.array_compact(F.array(*[
        F.when(F.rlike("ids", F.lit(p)) if "(" in p else F.contains("ids", F.lit(p)), F.lit(i))
        for i, (_, _, _, p) in enumerate(rules) if not p[1:-1].isdigit()]))
    of_rules = [listed([str(r[at]) for r in rules]) for at in range(3)]
    found = seen.select("doc_id", F.transform(F.array_sort(F.concat(ordered, alone)), lambda i: F.struct(
        F.get(of_rules[0], i).alias("licence"), F.get(of_rules[1], i).alias("rule"), F.get(of_rules[2], i).cast("long").alias("n_sentences"))).alias("m"))
    first = F.filter("m", lambda x, i: ~F.exists(F.slice("m", F.lit(1), i), lambda y: y["licence"] == x["licence"])
                     & ~(x["licence"].isin(*FAMILIES) & F.exists("m", lambda y: F.startswith(y["licence"], F.concat(x["licence"], F.lit("-"))))))
    return found.select("doc_id", F.explode(first).alias("m")).select("doc_id", "m.licence", "m.rule", "m.n_sentences")
