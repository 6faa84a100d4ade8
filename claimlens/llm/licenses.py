"""Licence texts by canonical digest lookup (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Public licence texts and the usual notices that name one.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ('BSD-2-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ('BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ('Unlicense', 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ('MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.'),
    ('GPL-3.0', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ('LGPL-3.0', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
)
#: Spellings that licence texts use alike, as (one, the other).
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("organisation", "organization"), ("favour", "favor"), ("copyright owner", "copyright holder"), ("whilst", "while"), ("authorised", "authorized"),
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def without_notices(text):
    """The text without its copyright lines: those that begin with the word, (c) or the sign."""
    return F.regexp_replace(text, r"(?imd)^[ \t]*(?:copyright\b|\(c\)|©).*(?:\n|$)", "")


def canonical(text):
    """Lower case, marks and blanks as single blanks, spellings unified.

    Words stand two blanks apart while spellings are replaced, so neighbours that are spelt alike are all replaced.
    """
    text = F.translate(text, CAPITALS + MARKS + "\t\n\x0b\f\r", SMALL + " " * (len(MARKS) + 5))
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, " +", "  ")), F.lit(" "))
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other} "))
    return F.trim(F.regexp_replace(text, " +", " "))


def digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts; as many rows as the list has texts."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known])))
    c = canonical(without_notices(F.col("text")))
    return rows.select("license_id", F.sha2(c, 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Every text of KNOWN holds this, so a text or line without it needs no canonical form.
CUE = "(?i)licen[cs]e|permission|redistribution"
#: What begins a comment line, and a run of such lines.
COMMENT = r"[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)"
COMMENTS = rf"(?m)(?:^{COMMENT}[^\n]*(?:\n|\z))+"
PARAGRAPHS = r"\n[ \t\r]*\n"


def scan(docs: DataFrame, known: DataFrame | None = None, cue: str | None = "") -> DataFrame:
    """(doc_id, unit, license_id, n), matches of entire canonical texts: unit is `document`, `paragraph`, `comment` or `line`.

    Looked up are a document as a whole, its paragraphs (between empty lines), its comment blocks (neighbouring lines
    that begin with a comment mark, without it), each without copyright lines, and each line as a text of its own; n
    counts equal units. known: (digest, license_id), by default the digests of KNOWN; a list of any size may be given,
    and is sent to the tasks only if it is small enough for the session's own bound. `cue` is a pattern that every
    known text holds (None: look everything up); it defaults to CUE for KNOWN and to None for a list that is given.
    Null and empty texts match nothing; null ids stay null; rows that repeat an id add up. Other columns are ignored.
    """
    own = known is None
    cue = (CUE if own else None) if cue == "" else cue
    known = F.broadcast(digests(docs.sparkSession)) if own else known
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = lambda df: df.filter(F.rlike("text", F.lit(cue))) if cue else df
    rows = held(rows)
    bare = canonical(without_notices(F.col("text")))
    part = lambda name, pieces, c: held(rows.select("doc_id", F.explode(pieces).alias("text"))).select("doc_id", F.lit(name).alias("unit"), c.alias("c"))
    block = canonical(without_notices(F.regexp_replace("text", rf"(?m)^{COMMENT}[ \t]?", "")))
    units = rows.select("doc_id", F.lit("document").alias("unit"), bare.alias("c"))
    for p in (part("paragraph", F.split("text", PARAGRAPHS), bare), part("comment", F.regexp_extract_all("text", F.lit(COMMENTS), F.lit(0)), block),
              part("line", F.split("text", "\n"), canonical(F.col("text")))):
        units = units.unionByName(p)
    hits = units.filter("c <> ''").select("doc_id", "unit", F.sha2("c", 256).alias("digest")).join(known.select("digest", "license_id"), "digest")
    return hits.groupBy("doc_id", "unit", "license_id").agg(F.count(F.lit(1)).alias("n"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(text):
        text = f"translate({text}, {q(CAPITALS + MARKS)} || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), {q(SMALL + ' ' * (len(MARKS) + 5))})"
        text = f"(' ' || trim(regexp_replace({text}, ' +', '  ', 'g')) || ' ')"
        for one, other in SPELLINGS:
            text = f"replace({text}, ' {one.replace(' ', '  ')} ', ' {other} ')"
        return f"trim(regexp_replace({text}, ' +', ' ', 'g'))"

    plain = f"regexp_replace(text, '(?m)^{COMMENT}[ \\t]?', '', 'g')"
    bare = "regexp_replace(text, '(?im)^[ \\t]*(?:copyright\\b|\\(c\\)|©).*(?:\\n|$)', '', 'g')".replace("\\\\", "\\")
    known = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, sha256({canon(bare)}) AS digest FROM (VALUES {known}) k(license_id, text) GROUP BY digest),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM docs),
paragraphs AS (SELECT doc_id, unnest(string_split_regex(text, '{PARAGRAPHS}')) AS text FROM docs),
comments AS (SELECT doc_id, {plain} AS text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{COMMENTS}')) AS text FROM docs) x),
units AS (SELECT doc_id, 'document' AS unit, {canon(bare)} AS c FROM docs UNION ALL SELECT doc_id, 'line', {canon('text')} FROM lines
 UNION ALL SELECT doc_id, 'paragraph', {canon(bare)} FROM paragraphs UNION ALL SELECT doc_id, 'comment', {canon(bare)} FROM comments)
SELECT doc_id, unit, license_id, count(*) AS n FROM units JOIN known ON sha256(c) = digest WHERE c <> '' GROUP BY ALL
"""


SQL = _sql()
