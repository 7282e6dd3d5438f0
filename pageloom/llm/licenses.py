"""License scans by canonical digests.

A text is made canonical: lower case, lines of copyright notices out, equivalent spellings made one, all marks
and white space turned into single blanks. The SHA-256 of the result is looked up by a hash join among
the digests of known licences (whole licence texts) and of known notices (the one-line statements that
name a licence). Whole texts are matched to both; every whole line of a text is matched to the notices,
so a notice inside a longer document is found, too.

The list of licences is fixed and short; it is broadcast only up to SMALL rows and joined by shuffle beyond.

Defined results: null, empty and mark-only texts have an empty canonical form, a null digest and no licence. Repeated rows
get equal results; notices are those of a row's own text, whatever its id; of two licences with one digest the
smaller name stands. Empty tables give empty results. Columns named digest, license or notices are replaced;
all others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import free_names

SMALL = 10_000
#: Patterns and their replacements, in order (fixed values; without look-around, so that SQL engines agree).
COPYRIGHT_LINES = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "non-commercial": "noncommercial",
    "non-infringement": "noninfringement",
    "organisation": "organization",
    "favour": "favor",
    "judgement": "judgment",
    "acknowledgement": "acknowledgment",
    "merchantibility": "merchantability",
    "per cent": "percent",
    "web site": "website",
    "https://": "http://",
    "&": " and ",
    "copyright owner": "copyright holder",
}
MARKS = r"[^\p{L}\p{N}]+"
LINE_MARKS = r"[^\p{L}\p{N}\n]+"
#: Every copyright line has one of these.
NOTICED = ("copyright", "(c)", "©", "all rights reserved")

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Whole licence texts: (licence, text).
LICENSES = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", "\n".join((BSD_HEAD, BSD_1, BSD_2, BSD_TAIL))),
    ("BSD-2-Clause", "\n".join(("BSD 2-Clause License", BSD_HEAD, BSD_1, BSD_2, BSD_TAIL))),
    ("BSD-3-Clause", "\n".join((BSD_HEAD, BSD_1, BSD_2, BSD_3, BSD_TAIL))),
    ("BSD-3-Clause", "\n".join(("BSD 3-Clause License", BSD_HEAD, BSD_1, BSD_2, BSD_3, BSD_TAIL))),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", APACHE_HEADER),
]
#: Longer licences by the digest of the canonical form of their whole text, as the Free Software Foundation, the Apache Software Foundation,
#: Creative Commons and Mozilla give it out (fixed values).
DIGESTS = [
    ("Apache-2.0", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f"),
    ("GFDL-1.3", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"),
    ("LGPL-2.0", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
]
#: One-line notices: (licence, text).
NOTICES = [
    *[("MIT", f"{verb} under the MIT License.") for verb in ("Released", "Licensed", "Distributed")],
    *[("Apache-2.0", f"{verb} under the Apache License, Version 2.0.") for verb in ("Released", "Licensed", "Distributed")],
    *[(f"GPL-{v}.0", f"This {what} is licensed under the GNU General Public License, version {v}.") for v in (2, 3) for what in ("work", "program", "software")],
    *[(f"CC-{c.upper()}-4.0", f"{verb} under CC {c.upper()} 4.0.") for c in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for verb in ("Licensed", "Released")],
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "CC-BY-4.0", "CC0-1.0", "Zlib")],
]


def with_form(rows: DataFrame, text: str, form: str) -> DataFrame:
    """rows with the canonical form of a text, in which ends of lines are still to be seen.

    Each step that a later one reads twice is a column of its own, so that Spark works it out once; texts
    without any word of a copyright line skip the search for such lines.
    """
    (lower,) = free_names(rows, "lower")
    low = rows.withColumn(lower, F.lower(F.coalesce(F.col(text), F.lit(""))))
    noticed = F.contains(F.col(lower), F.lit(NOTICED[0]))
    for word in NOTICED[1:]:
        noticed = noticed | F.contains(F.col(lower), F.lit(word))
    out = F.when(noticed, F.regexp_replace(F.col(lower), COPYRIGHT_LINES, " ")).otherwise(F.col(lower))
    for spelling, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return low.withColumn(form, F.regexp_replace(out, LINE_MARKS, " ")).drop(lower)


def with_digest(rows: DataFrame, text: str, digest: str = "digest") -> DataFrame:
    """rows with the digest of the whole canonical form of a text, null where that is empty."""
    (form,) = free_names(rows, "form")
    out = with_form(rows, text, form).withColumn(form, F.trim(F.regexp_replace(F.col(form), "[ \\n]+", " ")))
    return out.withColumn(digest, F.when(F.col(form) != "", F.sha2(F.col(form), 256))).drop(form)


def known(spark: SparkSession, rows: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license) of licences and their texts, and of those whose digest is given."""
    found = with_digest(spark.createDataFrame(rows, "license string, text string"), "text").where("digest is not null").select("digest", "license")
    if digests:
        found = found.union(spark.createDataFrame([(d, name) for name, d in digests], "digest string, license string"))
    found = found.groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(found) if len(rows) + len(digests) <= SMALL else found


def lengths(spark: SparkSession, rows: list[tuple[str, str]]) -> tuple[int, int]:
    """The least and the greatest length of the canonical forms of texts; two numbers, whatever the list."""
    forms = with_form(spark.createDataFrame(rows, "license string, text string"), "text", "form").select(F.length(F.trim(F.regexp_replace("form", "[ \\n]+", " "))).alias("n"))
    least, most = forms.agg(F.min("n"), F.max("n")).first()
    return max(least or 0, 1), most or 0


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", licenses: list[tuple[str, str]] = LICENSES, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """docs with digest, license (of the whole text, or null) and notices (licences of whole lines, sorted and joined by commas, or null)."""
    spark = docs.sparkSession
    docs = docs.drop("digest", "license", "notices")
    own, raw, mine, form = free_names(docs, "own", "raw", "mine", "form")
    raw_digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    # only lines as long as some notice can be one, and only these are hashed; lines without a known digest end here, before any shuffle
    least, most = lengths(spark, notices)
    lines = with_form(docs.select(F.col(doc_id).alias(own), raw_digest.alias(raw), F.col(text).alias("text")), "text", form)
    lines = lines.select(own, raw, F.explode(F.split(form, "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.length("line").between(least, most))
    named = lines.withColumn("digest", F.sha2("line", 256)).join(known(spark, notices), "digest")
    named = named.groupBy(own, raw).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    whole = with_digest(docs.withColumn(mine, raw_digest), text).join(known(spark, licenses + notices, digests), "digest", "left")
    return whole.join(named, F.col(doc_id).eqNullSafe(F.col(own)) & (F.col(mine) == F.col(raw)), "left").drop(own, raw, mine)
