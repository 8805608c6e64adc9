"""License scans: canonical digests of whole texts and of their notice lines, hash-joined to known ones.

A text is made canonical with built-in functions only: lower case, copyright notices dropped (lines with a sign or a
year, wherever else a text is wrapped), equivalent spellings folded, everything but letters and digits one space. Its SHA-256 is looked up among the digests
of known licence texts, so a match is the whole text and never a part of it. Single lines are looked up
likewise, where they contain the letters that every known notice has; so a document that closes with a
notice is found as well as one that is a licence. The table of known digests is a small parameter, and its
size is checked before it is broadcast. Short licences are here as texts, long ones as digests of their canonical form.

Null texts count as empty. Rows with the same id and text give one row, rows with the same id and different texts
one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked

# Public licence texts and notices, by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2, BSD_3 = _BSD_OPENING + _BSD_END, _BSD_OPENING + _BSD_THIRD + _BSD_END
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_TITLED = [("MIT", "MIT License", MIT), ("ISC", "ISC License", ISC), ("BSD-2-Clause", "BSD 2-Clause License", BSD_2), ("BSD-3-Clause", "BSD 3-Clause License", BSD_3), ("Zlib", "zlib License", ZLIB), ("0BSD", "BSD Zero Clause License", ZERO_BSD)]
TEXTS = [*((i, t) for i, _, t in _TITLED), *((i, f"{title}\n\n{t}") for i, title, t in _TITLED), ("Apache-2.0", APACHE_HEADER)]
#: SHA-256 of the canonical form of whole published texts.
DIGESTS: dict[str, str] = {
    "0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61": "MPL-1.1",
    "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56": "MPL-2.0",
}
#: Licence names as notices write them.
NAMES = {
    "MIT": ["the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
OPENINGS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under"]
#: Spellings that count as the same.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("recognised", "recognized"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("copyright owner", "copyright holder")]
#: What every canonical notice has; lines without it can't match one.
NEEDED = "licen[cs]|released under|distributed under"
#: A line that begins with a copyright sign, or with the word and then a sign or a year; or that reserves all rights.
_COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n©]*(copyright[^\n]*(\(c\)|©|(19|20)[0-9][0-9])|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the public texts and notices above."""
    rows = [*TEXTS, *((i, f"{o} {n}.") for i, names in NAMES.items() for n in names for o in OPENINGS)]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan_licenses(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id and text: canonical_sha256 of the whole text, license_id that it is (null: none), and n_notices
    and notice_ids of its lines that are known, ids sorted and joined by commas ('' without any)."""
    given, known = known, known_licenses(df.sparkSession) if known is None else known
    rows = known.select("license_id", digest(F.col("text")).alias("digest_"))
    if given is None:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(i, d) for d, i in DIGESTS.items()], "license_id string, digest_ string"))
    table = rows.groupBy("digest_").agg(F.min("license_id").alias("license_"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.lower(x).rlike(NEEDED))
    found = df.select(F.col(id_col).alias("id_"), F.sha2(text, 256).alias("text_"), F.concat(F.array(digest(text)), F.transform(lines, digest)).alias("digests_"))
    units = found.select("id_", "text_", F.element_at("digests_", 1).alias("whole_"), F.posexplode("digests_").alias("at_", "digest_"))
    hits = join_checked(units, table, "digest_", "left")
    line = (F.col("at_") > 0) & F.col("license_").isNotNull()
    # Rows alike have their lines at the same places, which count once.
    return hits.groupBy("id_", "text_").agg(
        F.first("whole_").alias("whole_"),
        F.max(F.when(F.col("at_") == 0, F.col("license_"))).alias("license_id"),
        F.size(F.collect_set(F.when(line, F.col("at_")))).cast("long").alias("n_notices_"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license_")))), ",").alias("notice_ids"),
    ).select(F.col("id_").alias(id_col), F.col("whole_").alias("canonical_sha256"), "license_id", F.col("n_notices_").alias("n_notices"), "notice_ids")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same result over documents in DuckDB SQL."""

    def canon(x: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({x}), {_sql_text(_COPYRIGHT_LINE)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    rows = [*TEXTS, *((i, f"{o} {n}.") for i, names in NAMES.items() for n in names for o in OPENINGS)]
    values = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in rows)
    digests = ", ".join(f"('{i}', '{d}')" for d, i in DIGESTS.items())
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license FROM (SELECT license_id, sha256({canon('text')}) AS digest FROM (VALUES {values}) AS k(license_id, text) UNION ALL FROM (VALUES {digests}) AS d(license_id, digest)) GROUP BY 1),
docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT doc_id, text, sha256({canon('text')}) AS digest FROM docs),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM whole),
notices AS (SELECT l.doc_id, l.text, count(*) AS n, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS ids
  FROM lines l JOIN known k ON k.digest = sha256({canon('l.line')}) WHERE regexp_matches(lower(l.line), '{NEEDED}') GROUP BY ALL)
SELECT w.doc_id, w.digest AS canonical_sha256, k.license AS license_id, coalesce(n.n, 0) AS n_notices, coalesce(n.ids, '') AS notice_ids
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notices n ON n.doc_id IS NOT DISTINCT FROM w.doc_id AND n.text = w.text
"""
