"""Operator 1, licence scans, by canonical digest lookup. DataFrame operations only.

A text is canonical once A-Z are lower-cased, copyright statements dropped, punctuation and white space made single spaces
and equivalent spellings made one. Known licence texts and notices have known digests; a text's digest is joined with
them. Looked up are each document's whole text and, for notices that stand in a text, each of its sentences as a whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.llm.common import LOWER, UPPER, ascii_lower

#: Spellings that count as one (the first becomes the second), whole words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"),
    ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("v2", "version 2"), ("v3", "version 3"), ("the software licensed", "software licensed"), ("http", "https"),
)
#: Names under which licences are granted in notices, by SPDX identifier.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
#: What is licensed, and how a notice says so.
THINGS = ("", "this work is", "this software is", "this program is", "this project is", "this file is", "this document is", "this code is", "this content is", "this text is", "it is")
GRANTS = ("licensed under", "released under", "distributed under", "available under", "made available under")
#: Short licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
}
#: Texts with redistribution clauses, and the standard headers of files, which stand without a title.
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT, _MIT_REST = TEXTS["MIT"].split(", subject to the following conditions: ", 1)
TEXTS |= {
    "BSD-2-Clause": _CLAUSES + _DISCLAIMER,
    "BSD-3-Clause": _CLAUSES + _THIRD + _DISCLAIMER,
    "MIT-0": f"{_MIT_GRANT}. {_MIT_REST[_MIT_REST.index('THE SOFTWARE IS') :]}",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be
included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
derivative works are solely in the form of machine-executable object code generated by a source language processor. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details. You
should have received a copy of the GNU {} Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_FAMILY = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
HEADERS |= {name: _GPL.format(kind, version, kind, kind) for name, kind, version in _FAMILY}
#: Titles above full texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "Zlib": ("zlib License", "The zlib License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"), "Unlicense": ("The Unlicense",),
}
#: Statements that name a copyright's holder, in lower case, to the end of their line or to where a licence's body begins
#: in it; and what counts as punctuation or white space.
_BODIES = (
    "permission is hereby", "permission to use", "redistribution and use", "this software is provided", "this is free and unencumbered",
    "this program is free", "this source code form", "licensed under the", "released under the", "distributed under the",
)
_COPYRIGHT = rf"(^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)(?:[^\n]*?[^0-9a-z\n]({'|'.join(_BODIES)})|[^\n]*)"
_PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f‘’“”–—…«»]+"
_SENTENCE = r"\n|[.!?] +"
_WIDE = [(f" {old} ".replace(" ", "  ")[1:-1], f" {new} ".replace(" ", "  ")[1:-1]) for old, new in SPELLINGS]


def canonical(low: Column) -> Column:
    """The canonical form of a text whose A-Z are lower-cased.

    Spellings are made equal over doubled blanks, so that words that stand side by side don't share one.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, _COPYRIGHT, "$1$2"), _PUNCTUATION, " "), F.lit(" "))
    out = F.replace(plain, F.lit(" "), F.lit("  "))
    for old, new in _WIDE:
        out = F.replace(out, F.lit(old), F.lit(new))
    # One search for all the spellings: most texts have none and go through as they are.
    return F.trim(F.when(plain.rlike(f" ({'|'.join(old for old, _ in SPELLINGS)}) "), F.regexp_replace(out, " +", " ")).otherwise(plain))


def canonical_text(text: str) -> str:
    """canonical() for one text in Python, for the table of known texts."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    out = f" {re.sub(_PUNCTUATION, ' ', re.sub(_COPYRIGHT, lambda m: m[1] + (m[2] or ''), low))} ".replace(" ", "  ")
    for old, new in _WIDE:
        out = out.replace(old, new)
    return re.sub(" +", " ", out).strip(" ")


def known() -> dict[str, str]:
    """Digest -> licence, of the licence texts and of every notice that names, things and grants make."""
    out = {canonical_text(text): name for name, text in TEXTS.items()}
    out |= {canonical_text(text): name for name, text in HEADERS.items()}
    for name, titles in TITLES.items():  # a title alone is a notice, above its text a part of it
        out |= {canonical_text(x): name for title in titles for x in (title, f"{title} {TEXTS[name]}")}
    for name, spelled in NAMES.items():
        out[canonical_text(f"SPDX-License-Identifier: {name}")] = name
        for title in spelled:
            for article in ("", "the ", "a "):
                for thing in THINGS:
                    for grant in GRANTS:
                        out[canonical_text(f"{thing} {grant} {article}{title}")] = name
                out[canonical_text(f"License: {article}{title}")] = name
    return {hashlib.sha256(k.encode()).hexdigest(): v for k, v in out.items()}


def known_table(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """Rows (digest, license_id): a fixed table, with the digests of further texts {text: licence} if given."""
    rows = known() | {hashlib.sha256(canonical_text(t).encode()).hexdigest(): v for t, v in (extra or {}).items()}
    return spark.createDataFrame(sorted(rows.items()), T.StructType([T.StructField("digest", T.StringType()), T.StructField("license_id", T.StringType())]))


def license_scan(docs: DataFrame, extra: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, license_id, n_notices, notice_ids), one for each row of docs.

    license_id is that of the whole text (null: none); n_notices counts its sentences that are known texts, notice_ids
    are their licences, sorted, joined by commas (empty: none). Null texts count as empty and match nothing. Rows that
    repeat an identifier, or have none, have each their own result. An empty table gives no rows; other columns are
    ignored. One pass over the texts; what is shuffled is a digest for each row and each notice.
    """
    table = F.broadcast(known_table(docs.sparkSession, extra))  # a few thousand fixed rows
    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), low.alias("low"))
    # Piece 0 is the whole text, the others are its sentences. The join is an outer one: from an inner one Spark would
    # infer that digests aren't null, and compute each twice to find out.
    pieces = rows.select("row", "id", F.posexplode(F.concat(F.array("low"), F.split("low", _SENTENCE))).alias("at", "piece")).where((F.col("at") == 0) | (F.length("piece") > 2))
    found = pieces.select("row", "id", "at", F.sha2(F.encode(canonical(F.col("piece")), "UTF-8"), 256).alias("digest")).join(table, "digest", "left")
    whole, notice = F.col("at") == 0, F.when(F.col("at") > 0, F.col("license_id"))
    return found.where(whole | F.col("license_id").isNotNull()).groupBy("row").agg(
        F.max("id").alias(id_col), F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("license_id"))).alias("license_id"),
        F.count(notice).alias("n_notices"), F.array_join(F.array_sort(F.collect_set(notice)), ",").alias("notice_ids"),
    ).drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence that its text is, and the notices that it has."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def sql(text: str) -> str:
        out = f"' ' || regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{_COPYRIGHT}', '\\1\\2', 'g'), '{_PUNCTUATION}', ' ', 'g') || ' '"
        out = f"replace({out}, ' ', '  ')"
        for old, new in _WIDE:
            out = f"replace({out}, '{old}', '{new}')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"

    values = ", ".join(f"('{d}', '{name}')" for d, name in sorted(known().items()))
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {sql("text")} AS digest FROM d),
s AS (SELECT doc_id, unnest(string_split_regex(text, '{_SENTENCE}')) AS sentence FROM d),
h AS (SELECT doc_id, license_id FROM (SELECT doc_id, {sql("sentence")} AS digest FROM s WHERE length(sentence) > 2) JOIN known USING (digest)),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, w.digest, license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(ids, '') AS notice_ids
FROM w LEFT JOIN known USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id
"""


ORACLE = _oracle()
