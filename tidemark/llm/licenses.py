"""License scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines, spellings that mean the same, white space), digested, and the
digest joined with those of known licenses. Whole documents are looked up, and
each of their lines as well, since notices stand alone on a line.

Defined results: null text is empty text; a text whose canonical form is empty matches nothing; a document with
several notices lists each license once, sorted; lines of any length are looked up; repeated rows get equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
#: The notice of the three GNU licenses, for a name and a version.
GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\nYou should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
# Short license texts and notices, as published.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    (
        "MIT",
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + NO_WARRANTY),
    ("BSD-2-Clause", BSD + NO_WARRANTY),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"{tag}-{version}.0", GNU.format(what=what, name=name, version=version)) for tag, name, version in (("GPL", "General Public License", 3), ("GPL", "General Public License", 2), ("LGPL", "Lesser General Public License", 3), ("AGPL", "Affero General Public License", 3)) for what in ("program", "library", "file")),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "LGPL-3.0", "AGPL-3.0", "Unlicense", "Zlib", "CC-BY-4.0", "CC0-1.0")),
)
#: Spellings that mean the same, fixed values, applied in this order.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("copyright holder", "copyright owner"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("https", "http"), ("per cent", "percent"), ("organis", "organiz"), ("acknowledgement", "acknowledgment"))
#: A line that starts so is a copyright line.
COPYRIGHT = r"(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, spellings unified, single spaces."""
    out = F.regexp_replace(ascii_lower(text), COPYRIGHT, "$1")
    out = F.trim(F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def with_digest(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text_digest`` of a text column. The form has a projection of its own, so it is computed once, not in test and value; the row number keeps the joins' null filters above it."""
    form = F.col("_form")
    formed = df.withColumns({"_form": canonical(F.col(text)), "_row": F.monotonically_increasing_id()}).where("_row >= 0")
    return formed.withColumn("text_digest", F.when(form != "", F.sha2(F.encode(form, "UTF-8"), 256))).drop("_form", "_row")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license, text_digest): one row a distinct canonical text; a given list, so small."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return with_digest(rows, "text").select("license", "text_digest").distinct()


def scan(documents: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, text_digest, license, notices, n_notices) for every row of ``documents``."""
    spark = documents.sparkSession
    table = F.broadcast(known_digests(spark, known))  # a list that the caller holds: its size doesn't depend on the documents
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    lines = docs.select("doc_id", "key", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("at", "line"))
    hits = with_digest(lines, "line").select("doc_id", "key", "at", "text_digest").join(table, "text_digest")
    notices = hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("license")).alias("notices"), F.count_distinct("at").alias("n_notices"))
    notices = notices.withColumnsRenamed({"doc_id": "nd", "key": "nk"})
    whole = with_digest(docs, "text").drop("text").join(table, "text_digest", "left")
    out = whole.join(notices, whole["doc_id"].eqNullSafe(F.col("nd")) & (whole["key"] == F.col("nk")), "left")
    return out.select("doc_id", "text_digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """License of every whole document and the notices on its lines."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text_digest", "license", F.array_join("notices", ",").alias("notices"), "n_notices")


def _sql_form(x: str) -> str:
    out = f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|\\n)[ \\t]*(?:copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _sql_digest(x: str) -> str:
    return f"CASE WHEN {_sql_form(x)} <> '' THEN sha256({_sql_form(x)}) END"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH known AS (SELECT DISTINCT license, {_sql_digest("text")} AS text_digest FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS t(license, text)),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
hits AS (SELECT doc_id, k.license FROM lines JOIN known k ON k.text_digest = {_sql_digest("line")}),
notices AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM hits GROUP BY doc_id)
SELECT d.doc_id, {_sql_digest("d.text")} AS text_digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0)::BIGINT AS n_notices
FROM docs d LEFT JOIN known k ON k.text_digest = {_sql_digest("d.text")} LEFT JOIN notices n ON n.doc_id = d.doc_id
"""
