"""License scans by canonical digest.

A text is put into canonical form: case, punctuation, copyright lines and equivalent spellings
no longer count.  Whole texts, their paragraphs, lines and runs of lines are then looked up, each
as an entire text, among the digests of known licences and notices: an equi-join on SHA-256, no search.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licences by SPDX identifier and the names they go by.
NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}

# Sentences that give a name.
FORMS = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the {}.")

# Entire texts of short public licences.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = (
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_TWO} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_TWO} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
)

#: Steps of the canonical form, in order: pattern and what replaces it; they run on lower case.
# Spellings that count as the same.
_STEPS = (
    (r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9a-z]|©|all rights reserved)[^\n]*", ""),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"\b(sub|non|re) (licen[cs]e|infringement|distribut)", r"\1\2"),
    (r"licence", "license"),
    (r"copyright owner", "copyright holder"),
    (r"acknowledgement", "acknowledgment"),
    (r"([ao]r?gan|author|real|recogn)is(e|ation|ing)", r"\1iz\2"),
    (r"favour", "favor"),
    (r"whilst", "while"),
    (r"(?m)^ | $", ""),
)


# Words that give a licence; a copyright line is cut before them.
_GIVEN = "licen[cs]ed under|released under|distributed under|this work is licen[cs]ed|permission is hereby|permission to use|redistribution and use|this software is provided|spdx[ -]licen[cs]e[ -]identifier"
_BARE = "|".join(re.sub("[^a-z0-9]+", r"[^\\p{L}\\p{N}\\n]+", name.lower()) for names in NAMES.values() for name in names)
_CLAUSE = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9a-z]|©|all rights reserved)(?:(?!\b(?:" + _GIVEN + r")\b|\b(?:the )?(?:" + _BARE + r")[^\p{L}\p{N}\n]*$)[^\n])*+"
_OWN_STEPS = ((_CLAUSE, ""), *_STEPS[1:])

# What starts the appendix on how to use a licence.
_APPENDIX = re.compile(r"\n[ \t]*(?:APPENDIX: How to apply|How to Apply These Terms|Exhibit A - Form of|Exhibit A [-–] Form of)", re.I)


def _canonical_sql(text: str, dialect: str) -> str:
    """The canonical form with its lines kept, as SQL."""
    out = f"lower({text})"
    for pattern, put in _OWN_STEPS if dialect == "spark" else _STEPS:
        if dialect == "spark":
            out = f"regexp_replace({out}, r'{pattern}', '{put.replace(chr(92), '$')}')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return out


def _one_line_sql(text: str, dialect: str) -> str:
    return f"trim(regexp_replace({text}, r'\\s+', ' '))" if dialect == "spark" else f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def canonical(text: str) -> Column:
    """Canonical form of a text column, its lines kept."""
    return F.expr(_canonical_sql(text, "spark"))


def known_texts() -> list[tuple[str, str]]:
    """Licence and text of notices and short licences; a fixed list, and all that the SQL has."""
    notices = [(key, form.format(name)) for key, names in NAMES.items() for name in names for form in FORMS]
    return [*TEXTS, *notices, *((key, f"SPDX-License-Identifier: {key}") for key in NAMES)]


def full_texts() -> list[tuple[str, str]]:
    """Licence and whole text: TEXTS and the files in ``licenses``, these also without the appendix
    on their use and with either scheme of links, and each of both under its usual titles."""
    filed = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text()
        for cut in {text, _APPENDIX.split(text)[0]}:
            filed += [(path.stem, cut), (path.stem, cut.replace("http://", "https://")), (path.stem, cut.replace("https://", "http://"))]
    out = [*TEXTS, *filed]
    for key, text in (*TEXTS, *(x for x in filed if len(x[1]) < 2000)):
        short = "BSD" if key.startswith("BSD") else key
        out += [(key, f"{the}{name}{said}\n\n{text}") for name in NAMES[key] for the in ("", "The ") for said in ("", f" ({key})", f" ({short})")]
    return sorted(set(out))


class Known(NamedTuple):
    """Canonical texts: rows (digest, license, length), and (first words, length) of whole ones."""

    digests: tuple[tuple[str, str, int], ...]
    runs: tuple[tuple[str, int], ...]


@lru_cache(maxsize=4)
def _known(spark: SparkSession) -> Known:
    bare = [(key, f"{the}{name}") for key, names in NAMES.items() for name in names for the in ("", "The ")]
    made = json.dumps([{"license": k, "text": t, "full": full} for full, texts in ((False, [*known_texts(), *bare]), (True, full_texts())) for k, t in texts])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<license: string, text: string, full: boolean>>")).alias("m")).select("m.*")
    flat = rows.withColumn("lines", canonical("text")).withColumn("flat", F.expr(_one_line_sql("lines", "spark")))
    got = flat.select("license", "full", "flat", F.sha2("flat", 256).alias("digest"), F.length("flat").alias("n")).collect()
    names: dict[tuple[str, int], str] = {}
    for r in got:
        names[r.digest, r.n] = min(r.license, names.get((r.digest, r.n), r.license))
    runs = {(" ".join(r.flat.split()[:5]), r.n) for r in got if r.full}
    return Known(tuple(sorted((d, k, n) for (d, n), k in names.items())), tuple(sorted(runs)))


def known_digests(spark: SparkSession) -> DataFrame:
    """Rows (digest, license), one for each distinct canonical text."""
    made = json.dumps([{"digest": d, "license": k} for d, k, _ in _known(spark).digests])
    return spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<digest: string, license: string>>")).alias("m")).select("m.*")


def _runs_sql(known: Known) -> str:
    """Digests of whole known texts that start and end with lines of ``flat``, however their lines
    and paragraphs are cut: from each line that has a text's first words, as much as the text is long."""
    first = "|".join(sorted({p.replace(" ", "[ \\n]") for p, _ in known.runs}))
    starts = f"""aggregate(split(flat, r'(?m)^(?=(?:{first})\\b)'), named_struct('at', 1, 'out', cast(array() as array<int>)),
        (a, x) -> named_struct('at', a.at + length(x), 'out', concat(a.out, array(a.at))), a -> a.out)"""
    texts = "array(" + ", ".join(f"named_struct('p', '{p}', 'n', {n})" for p, n in known.runs) + ")"
    fits = "translate(substring(flat, at, length(k.p)), '\\n', ' ') = k.p and substring(flat, at + k.n, 1) in ('', '\\n')"
    digests = f"flatten(transform({starts}, at -> transform(filter({texts}, k -> {fits}), k -> sha2(translate(substring(flat, at, k.n), '\\n', ' '), 256))))"
    return f"if(flat rlike r'(?m)^(?:{first})\\b', {digests}, cast(array() as array<string>))"


def license_scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, license, n_notices, notices), one for each row of ``docs`` (doc_id, text).

    ``license``: the licence whose text the whole text is, else null.  ``notices``: the licences
    whose texts are a paragraph, a line or a run of lines of it, sorted and joined by commas.  Null,
    empty and blank texts have neither.  Rows with equal ids and different texts are told apart;
    repeated rows are all returned; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = _known(spark)
    lengths = ", ".join(map(str, sorted({n for _, _, n in known.digests})))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    lined = rows.select("doc_id", "mark", canonical("text").alias("lines"))
    # Blanks are single already, but for line ends.
    flat = lined.withColumn("flat", F.expr("trim(both '\\n' from regexp_replace(lines, r'\\n\\s+', '\\n'))"))
    whole = f"if(length(flat) in ({lengths}), array(sha2(translate(flat, '\\n', ' '), 256)), cast(array() as array<string>))"
    paragraphs = f"transform(filter(transform(split(lines, r'\\n[ \\t]*\\n\\s*'), x -> trim(translate(x, '\\n', ' '))), x -> length(x) in ({lengths})), x -> sha2(x, 256))"
    lines = f"transform(filter(split(flat, '\\n'), x -> length(x) in ({lengths})), x -> sha2(x, 256))"
    tagged = lambda part, made: F.transform(made, lambda d: F.struct(F.lit(part).alias("part"), d.alias("digest")))
    units = F.concat(tagged(0, F.expr(whole)), tagged(1, F.expr(f"concat({paragraphs}, {lines}, {_runs_sql(known)})")))
    short = flat.select("doc_id", "mark", F.explode(units).alias("u")).select("doc_id", "mark", "u.part", "u.digest")
    hits = short.join(F.broadcast(known_digests(spark)), "digest")  # a fixed list of some 600 rows
    named = F.array_sort(F.collect_set(F.when(F.col("part") == 1, F.col("license"))))
    found = hits.groupBy("doc_id", "mark").agg(F.min(F.when(F.col("part") == 0, F.col("license"))).alias("license"), F.size(named).cast("long").alias("n"), F.array_join(named, ",").alias("names"))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.mark") == F.col("h.mark"))
    return rows.select("doc_id", "mark").alias("d").join(found.alias("h"), same, "left").select("d.doc_id", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("names", F.lit("")).alias("notices"))


def license_scan_sql() -> str:
    """DuckDB SQL with the rows of ``license_scan`` over ``documents``, if doc_id is unique and no
    text has what only the operator knows: full or titled texts, bare names, texts over several
    paragraphs, and notices after a copyright clause."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in known_texts())
    return f"""
WITH given(license, text) AS (VALUES {values}),
known AS (SELECT {_one_line_sql(_canonical_sql("text", "duckdb"), "duckdb")} AS unit, min(license) AS license FROM given GROUP BY 1),
lined AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')", "duckdb")} AS lines FROM documents),
units AS (
    SELECT doc_id, 0 AS part, lines AS unit FROM lined
    UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(lines, '\\n[ \\t]*\\n\\s*')) FROM lined
    UNION ALL SELECT doc_id, 1, unnest(string_split(lines, chr(10))) FROM lined),
hits AS (SELECT DISTINCT doc_id, part, license FROM (SELECT doc_id, part, {_one_line_sql("unit", "duckdb")} AS unit FROM units WHERE length(unit) > 0) JOIN known USING (unit)),
found AS (SELECT doc_id, min(license) FILTER (WHERE part = 0) AS license, count(*) FILTER (WHERE part = 1) AS n, string_agg(license, ',' ORDER BY license) FILTER (WHERE part = 1) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, f.license, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices, coalesce(f.names, '') AS notices
FROM documents d LEFT JOIN found f USING (doc_id)"""
