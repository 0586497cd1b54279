"""Licence scans by canonical digest lookup.  DataFrame functions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import table, texts

#: Public licence texts and notices, with the identifiers they stand for.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
_ISC_WRAPPED = KNOWN[1][1].replace("above copyright notice and this permission notice appear in all copies. ", "above\ncopyright notice and this permission notice appear in all copies.\n")
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {3} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BODIES = (
    *KNOWN[:4],
    ("ISC", _ISC_WRAPPED),
    *(("BSD-2-Clause", _BSD.format(*m[:2], "", h)) for m in (("1. ", "2. "), ("", "")) for h in ("HOLDER", "HOLDERS", "OWNER")),
    *(("BSD-3-Clause", _BSD.format(*m[:2], m[2] + _NAMES, h)) for m in (("1. ", "2. ", "3. "), ("", "", "")) for h in ("HOLDER", "HOLDERS", "OWNER")),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + " For more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + " For more information, please refer to <http://unlicense.org/>"),
)
#: Title lines that stand before a licence's text, if any.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License"), "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License"), "Unlicense": ("The Unlicense",),
}


def listed() -> tuple[tuple[str, str], ...]:
    """KNOWN, the usual licences with and without their titles, and the long ones as they are distributed."""
    short = tuple((i, f"{title}\n{rights}\n{body}") for i, body in _BODIES for title in ("", *_TITLES[i]) for rights in ("", "All rights reserved."))
    long = tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
    return (*KNOWN, *short, *long)


#: Spellings that count as one.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("favour", "favor"), ("whilst", "while"),
)

#: What all listed licences have in any of their spellings.
_COMMON = "(?i)licen|permission|software"


#: A copyright line begins with the word or the mark and has a mark, a year or a place for one.
_RIGHTS = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4}|\(?(year|yyyy)\b)|(\(c\)|©))[^\n]*"
_NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, letters (of any script), marks and digits alone, one space between words, one
    spelling for equivalent ones, between two spaces."""
    c = F.regexp_replace(F.lower(text), _RIGHTS, " ")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, _NO_WORD, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return c


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license_id and digest of each known text: as many rows as the caller lists."""
    return spark.createDataFrame(list(known), "license_id string, known string").select("license_id", F.md5(canonical(F.col("known"))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license_id (null if the text as a whole is no known licence), n_lines
    (lines that as a whole are a known licence text or notice) and line_licenses (their identifiers, sorted, comma-joined).

    A null text counts as empty and matches nothing; repeated rows come back as often as they are given; other columns are
    ignored; an empty table gives an empty result.  The known digests are the caller's list, so they are broadcast;
    an empty list matches nothing, and without a list the licences are those of listed().
    Line matches are found with one lookup in a map of the known line digests; nothing is shuffled.
    """
    spark = docs.sparkSession
    known = listed() if known is None else known
    digests = known_digests(spark, known)
    rows = {r["digest"]: r["license_id"] for r in digests.collect()}
    table_ = F.create_map(*(F.lit(x) for pair in sorted(rows.items()) for x in pair)).cast("map<string,string>")
    lines = F.split("text", "\n")
    if all(re.search(_COMMON, t) for _, t in known):  # then a line without these words can't be one of them
        lines = F.filter(lines, lambda x: x.rlike(_COMMON))
    hits = F.filter(F.transform(lines, lambda x: F.try_element_at(table_, F.md5(canonical(x)))), lambda x: x.isNotNull())
    found = texts(docs).select("doc_id", F.md5(canonical(F.col("text"))).alias("digest"), hits.alias("hits"))
    return found.join(F.broadcast(digests), "digest", "left").select("doc_id", "digest", "license_id", F.size("hits").cast("long").alias("n_lines"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("line_licenses"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    c = f"regexp_replace(lower({x}), '{_RIGHTS}', ' ', 'g')"
    c = f"' ' || trim(regexp_replace({c}, '{_NO_WORD}', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return c


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
with known as (select md5({_sql_canonical('t')}) as digest, min(i) as license_id from (values {values}) k(i, t) group by 1),
docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
hits as (select doc_id, count(*) as n, string_agg(distinct license_id, ',' order by license_id) as ids
         from lines join known on md5({_sql_canonical('line')}) = digest group by doc_id)
select d.doc_id, md5({_sql_canonical('d.text')}) as digest, k.license_id, coalesce(h.n, 0)::bigint as n_lines, coalesce(h.ids, '') as line_licenses
from docs d left join known k on k.digest = md5({_sql_canonical('d.text')}) left join hits h on h.doc_id = d.doc_id"""
