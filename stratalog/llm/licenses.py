"""Licence scan by canonical digests.

A text is made canonical: ASCII lower case, lines that claim copyright left out, equivalent
spellings made one, everything but letters and digits a blank.  The digests of entire
documents, and of each of their lines as a whole notice, are hash-joined to the digests of
known licences and notices, which are made canonical in the same way.  The known table is
part of the code, so its broadcast has a fixed size.  Every known text has one of the words in
`TRIGGERS`, so other lines need no digest.

Defined results: a null text is empty, and an empty canonical text matches nothing; repeated
rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import settle

#: Equivalent spellings, made the second of each pair in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub licens", "sublicens"),
    ("non infring", "noninfring"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    (" v 2 0", " version 2 0"),
    (" version 2 0 0", " version 2 0"),
)

#: Entire licences, and notices of one line.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: The BSD licences, in parts: clauses may be numbered or not, a title or "All rights reserved" may come first.
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {owner} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {holder} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {one} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd() -> list[tuple[str, str]]:
    out = []
    for n in (2, 3):
        titles = ("", f"BSD {n}-Clause License\n", *(('BSD 3-Clause "New" or "Revised" License\n',) if n == 3 else ('BSD 2-Clause "Simplified" License\n',)))
        for title in titles:
            for rights in ("", "All rights reserved.\n"):
                for numbered in (False, True):
                    for owner in ("the copyright holder", "the copyright owner")[: n - 1]:
                        for holder, one in (("HOLDERS", "HOLDER"), ("HOLDERS", "OWNER"), ("HOLDERS", "HOLDERS")):
                            clauses = [f"{k + 1}. " * numbered + c.format(owner=owner) for k, c in enumerate(_BSD_CLAUSES[:n])]
                            out.append((f"BSD-{n}-Clause", "\n".join([title + rights + _BSD_GRANT, *clauses, _BSD_END.format(holder=holder, one=one)])))
    return out


#: Texts beside KNOWN, which the SQL does not know.
MORE = (
    *_bsd(),
    *((x, f"SPDX-License-Identifier: {x}") for x in (
        "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
    )),
)
#: Digests of entire licences too long to be here, as canonical() makes them: whole, and where terms have a marked end, up to it with the mark and without.
DIGESTS = (
    ("Apache-2.0", "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e"),
    ("Apache-2.0", "cf7c26411074d941b42afe8baac32788531f003acea32d25ead49048c329c78d"),
    ("Apache-2.0", "b7bb6b2416cb5fc4e3acd34d1283c66e6228adab995f1c959405a3978193462c"),
    ("Artistic-1.0-Perl", "93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3", "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-3.0", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("GPL-3.0", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975"),
    ("GPL-3.0", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee"),
    ("LGPL-2.0", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.0", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "35f82aa0956f78c6101000ae9662fa0b3da3f2baf46c72fa9abdf5f68325097c"),
    ("MPL-2.0", "0a827e96fc123bd937ca51329bc5a3ded577524e37d1c4eb5ace3dab3fe078d5"),
)
#: A line that claims copyright, after lower-casing; it may be the first or the last.
CLAIM = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*"
#: Parts of words, one of which every known text has, whatever its spelling.
TRIGGERS = ("licen", "permission", "redistribution")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), CLAIM, "$1")
    plain = F.trim(F.regexp_replace(plain, "[^a-z0-9\x80-\U0010ffff]+", " "))
    for a, b in SPELLINGS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def digest(text: Column) -> Column:
    """sha256 of the canonical text."""
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession) -> DataFrame:
    """known (digest), license of the known licences and notices."""
    texts = spark.createDataFrame([*KNOWN, *MORE], "license string, text string").select("license", digest(F.col("text")).alias("known"))
    return texts.union(spark.createDataFrame(DIGESTS, "license string, known string")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest and license (null if unknown) of the entire text, n_notices and notices of its lines.

    notices: the licences of the lines that are known notices as a whole, distinct, sorted, comma-joined.
    """
    table = F.broadcast(known(docs.sparkSession))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)" + "|".join(TRIGGERS)))
    rows = settle(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(text).alias("digest"), lines.alias("lines")))
    hits = rows.select("row", F.explode("lines").alias("line")).select("row", digest(F.col("line")).alias("known")).join(table, "known")
    notices = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("notices"))
    found = rows.drop("lines").join(table, F.col("digest") == F.col("known"), "left").join(notices, "row", "left")
    return found.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_canonical(text: str) -> str:
    x = f"regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{CLAIM}', '\\1', 'g')".replace("\\n", "\n")
    x = f"trim(regexp_replace({x}, '[^a-z0-9\x80-\U0010ffff]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    rows = ", ".join(f"({_literal(name)}, {_literal(text)})" for name, text in KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT license, sha256({_sql_canonical('text')}) AS known FROM (VALUES {rows}) AS t(license, text)),
    whole AS (SELECT d.doc_id, d.text, k.license, d.digest FROM (SELECT doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents) d LEFT JOIN known k ON d.digest = k.known),
    lines AS (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
    hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON digest = known GROUP BY doc_id)
    SELECT w.doc_id, w.digest, w.license, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices FROM whole w LEFT JOIN hits h ON w.doc_id = h.doc_id
    """
