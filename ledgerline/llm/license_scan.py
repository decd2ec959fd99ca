"""Canonical digests of whole texts, looked up among those of known licences.

DataFrame functions only.  Every step is written so that Spark and DuckDB read
it alike: ASCII classes, no look-around, ``\\n`` as the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{condition}

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Public licence texts, without their copyright lines.
KNOWN = {
    "MIT": "MIT License\n\n" + _MIT_BODY.format(condition=", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MIT-0": "MIT No Attribution\n\n" + _MIT_BODY.format(condition="."),
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(third="\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}

#: Titles under which the texts stand; a text also stands without one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib License (Zlib)"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Spellings that count as one; the right-hand one is canonical.  They apply in
#: this order to lower-case words.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("recognise", "recognize"),
    ("https", "http"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("59 temple place suite 330 boston ma 02111 1307", "51 franklin street fifth floor boston ma 02110 1301"), ("franklin st", "franklin street"),
)

#: A line that says whose a work is: the word or sign with a sign, a year or a
#: place to fill in behind it, or that all rights are reserved.  A line of the
#: text itself may begin with "copyright", too, wherever it was wrapped.
COPYRIGHT_LINE = "(^|\\n)[ \\t#*/;%!-]*(copyright[ \\t]*[:,]?[ \\t]*(\\(c\\)|©|[0-9]{4}|[<\\[{])|\\(c\\)[ \\t]*(copyright|[0-9]{4}|[<\\[{])|©|all rights reserved)[^\\n]*"
#: What parts words, marks of comments and bullets among them; no line end has a
#: meaning of its own, so a text may be wrapped anywhere.
SEPARATORS = "[\\x00-\\x20#*/;%!-]+"
#: The number or letter of a clause, or a bullet, between separators.
CLAUSE = " (\\(?([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)]|o) "
NOT_WORDS = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f‘’“”–—…]+"
#: Each in turn, and what stands for it.
_STEPS = ((COPYRIGHT_LINE, "\n"), (SEPARATORS, "  "), (CLAUSE, "  "), (NOT_WORDS, "  "))


#: Digests of the canonical forms of long public licences, each as
#: its publisher's file has it, and cut where its terms end (with and without the
#: line that says so).
LONG = {
    "Apache-2.0": ("23e39ff3f48b6cbfd561928dfcb02eea5de7fffa2b943a1ea32c4158a9d95a6f", "9d095f66fe47a04d5d33b87718aa8e4429643b7504298828a16ab3fb5707252b", "9ab7ea36742801863b1b475fae75ecd9dfaaf6d455c7cdaaf3c1d10132d00d1d"),
    "Artistic-1.0-Perl": ("b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",),
    "CC0-1.0": ("1ed636e12cf722e6c9b6e716475802baa60f4dc12bd171ccc5aef9ade5ca9c2e",),
    "GFDL-1.2": ("4141e467daf0aa581ba77c8d00b6ee02ffa8f6d4e50128253783b77cb5542c67", "fc56b40f8ec45df545cfe12dd772a16f337dd87075155183c91108995a974bf4"),
    "GFDL-1.3": ("2ef68a5baaededf3c05b95be84ce02a8cd39cd397eaece5ac187c1e7fc8b92ed", "f06f2f50a3c9456cdb895dcbf2d7c57b16f084a61718e20b6041af727f6b41a5"),
    "GPL-1.0": ("805b86868428957407c3f6e3933785e8ca7a2c8f65af4a6bdaebbdb5eefe5917", "eac357664c3910fc12a85904797fb8766c25fefc81b946b5dd62c35b1a182413", "57ce1497d531e66ac327e0d754b3b23b28566ca5534806b71b2c586f1bea070d"),
    "GPL-2.0": ("9091b3188640d6723b461e8e012a229d5f77219e2083a669135a30d2b1b4297f", "bd6fe699aba54af00211328202a46bcd64d091de072919194ff7215db0e1935a", "f5f444394912ae2bc65e44425f0a3a8071b2f7f2ad2df371789e0f95c5382893"),
    "GPL-3.0": ("fa0e7d40ef94cf64d9b7c0ab21b7a82627143767e902a38eaaf5c703821c57b8", "fe37a7ddff1e1b85ef10919a3a4bbaa88eb6f6b574e3757140f92a3edaa8e628", "50861e8ddaa22b0a4e33b4d32b1e75a2a9d9949b5074bb0c40f927db93cdd7b0"),
    "LGPL-2.0": ("2a6ac921e4c62568a2b266e6164cb6819d2a06f7007ad9e187ada8d4770702d2", "391a1c21b45812119f35229a938fd294df86c19a5819e4946b03d84cd62e03fc", "f6dc5cd2f8d56b80dacf0b5f4412099e7029d054beea86e0ce0dcd3098e9f5c1"),
    "LGPL-2.1": ("0ca5c17aaa8deceea63b6afae195c7b8e4c2457d104e2a35bb62009f9d4d603b", "29399b1b7600dab97483ef661ed9e394094f2e80e6084574ed84480b90b1d501", "6ad660ce7213b3936d685c9ada84361135e273f79189cf0cd0a298e16764def8"),
    "LGPL-3.0": ("6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0",),
    "MPL-1.1": ("3bf9cb350668d9a58f8ba35d50c52aa926f142cc19358d4fbb88693df1ff20c3", "30e888c6ac77b392dfe91cd62d8344bb3966b75ea08804ecb09db851cb60b678"),
    "MPL-2.0": ("5c0269a4931aac7ea7207dd7fd6733bf93886ff2f920b9e801acb3b6e0d15f0a", "93758842d856651b01f3c1538fee52ea12b928aec9055693231912f97a530f51"),
}


def forms(known: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """``(license_id, text)``: each text without a title and under each of its titles."""
    out = []
    for name, text in (known or KNOWN).items():
        titles = TITLES.get(name, ()) if known is None else ()
        body = next((text[len(t) :].lstrip() for t in titles if text.startswith(t)), text)
        out += [(name, text), (name, body), *((name, f"{t}\n\n{body}") for t in titles)]
    return list(dict.fromkeys(out))


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, clause numbers, bullets and
    punctuation, in one spelling, with single spaces.  Null counts as empty.

    Clause numbers and spellings are replaced between doubled spaces, so that
    neighbours share none.
    """
    made = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    for pattern, by in _STEPS:
        made = F.regexp_replace(made, pattern, by)
    made = F.concat(F.lit(" "), F.trim(made), F.lit(" "))
    for other, chosen in SPELLINGS:
        made = F.replace(made, F.lit(_between(other)), F.lit(_between(chosen)))
    return F.trim(F.replace(made, F.lit("  "), F.lit(" ")))


def _between(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def known_digests(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """license_id, canonical_sha256, one row for each distinct digest of the
    given texts (without: of all :func:`forms` of :data:`KNOWN`, and those of
    :data:`LONG`); of ids that share one, the least stays."""
    rows = docs.sparkSession.createDataFrame(forms(known), "license_id string, text string")
    rows = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    if known is None:
        rows = rows.unionByName(docs.sparkSession.createDataFrame(_long(), "license_id string, canonical_sha256 string"))
    return rows.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def _long() -> list[tuple[str, str]]:
    return [(name, digest) for name, digests in LONG.items() for digest in digests]


def lookup(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, canonical_sha256, canonical_chars, license_id of every row: the id
    of the licence that is the whole text, null where none is.

    ``known(canonical_sha256, license_id)``: digests to look up, each once.
    Without it the built-in list is used, whose few rows are broadcast.  A
    given table joins by Spark's choice.  Null text and one of punctuation only
    have the empty canonical form; null and repeated keys are kept; other
    columns are not looked at; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), canonical(F.col(text)).alias("form"))
    rows = rows.select("key", F.sha2("form", 256).alias("canonical_sha256"), F.length("form").cast("long").alias("canonical_chars"))
    table = F.broadcast(known_digests(docs)) if known is None else known.select("canonical_sha256", "license_id")
    return rows.join(table, "canonical_sha256", "left").select(F.col("key").alias(key), "canonical_sha256", "canonical_chars", "license_id")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """:func:`canonical` in DuckDB's SQL."""
    made = f"(chr(10) || lower(coalesce({text}, '')) || ' ')"
    for pattern, by in _STEPS:
        made = f"regexp_replace({made}, {_literal(pattern)}, {_literal(by)}, 'g')"
    made = f"' ' || trim({made}) || ' '"
    for other, chosen in SPELLINGS:
        made = f"replace({made}, '{_between(other)}', '{_between(chosen)}')"
    return f"trim(replace({made}, '  ', ' '))"


def lookup_sql() -> str:
    """The query of :func:`lookup` over ``documents`` in DuckDB's SQL."""
    known = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in forms())
    long = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in _long())
    return f"""WITH a AS (SELECT i, sha256({canonical_sql("t")}) AS canonical_sha256 FROM (VALUES {known}) v(i, t) UNION ALL FROM (VALUES {long}) w(i, canonical_sha256)),
k AS (SELECT canonical_sha256, min(i) AS license_id FROM a GROUP BY 1),
d AS (SELECT doc_id, {canonical_sql("text")} AS form FROM documents)
SELECT doc_id, sha256(form) AS canonical_sha256, CAST(length(form) AS BIGINT) AS canonical_chars, license_id
FROM d LEFT JOIN k ON sha256(d.form) = k.canonical_sha256"""
