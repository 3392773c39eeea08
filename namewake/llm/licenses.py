"""License scans by canonical digests: texts that say the same in other case, punctuation or spelling get one digest.

A unit of text - a whole document, a paragraph or a line - is normalised, hashed and joined to the digests of known
licenses, which are normalised by the same expression. Only native functions take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public license notices and short license texts by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Whole license texts, without the copyright lines that come before them.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_TEXT = f'''{MIT_GRANT}

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'''
ISC_TEXT = '''Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'''
ZERO_BSD_TEXT = ISC_TEXT.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_HEAD = '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'''
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''
UNLICENSE_TEXT = f'''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>'''
ZLIB_TEXT = '''This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.'''
TEXTS = [
    ("MIT", "MIT License", MIT_TEXT),
    ("ISC", "ISC License", ISC_TEXT),
    ("0BSD", "BSD Zero Clause License", ZERO_BSD_TEXT),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{BSD_HEAD}\n\n{BSD_TAIL}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{BSD_HEAD}\n\n{BSD_THIRD}\n\n{BSD_TAIL}"),
    ("Unlicense", "The Unlicense", UNLICENSE_TEXT),
    ("Zlib", "zlib License", ZLIB_TEXT),
]
#: A text is known with its title and without, and with "the" before the title.
KNOWN += [(name, f"{title}{text}") for name, heading, text in TEXTS for title in ("", f"{heading}\n\n", f"The {heading}\n\n")]

# Spellings that mean the same, as whole words after case and punctuation are gone.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("v 2 0", "version 2 0"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
    ("https", "http"),
]

# A line that names a copyright by a year or a mark, after any signs of a comment; "copyright notice" at the start of a wrapped line is none.
COPYRIGHT_LINE = r"^[#*;%!/ \t-]*(?:copyright\b[^\n]*(?:[0-9]{4}|\(c\)|\x{a9})|\(c\)|\x{a9}|all rights reserved)[^\n]*$"
MARKS = ("copyright", "(c)", "\u00a9", "all rights reserved")


def marked(lower: Column) -> Column:
    """Whether a text in lower case may hold a copyright line."""
    return F.contains(lower, F.lit(MARKS[0])) | F.contains(lower, F.lit(MARKS[1])) | F.contains(lower, F.lit(MARKS[2])) | F.contains(lower, F.lit(MARKS[3]))


def canonical(text: Column) -> Column:
    """Lower case; no copyright lines; every run of other characters one space; equivalent spellings made one."""
    lower = F.lower(text)
    plain = F.when(marked(lower), F.regexp_replace(lower, f"(?dm){COPYRIGHT_LINE}", " ")).otherwise(lower)
    spaced = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest, first), one row a digest, with the first word of its canonical form; the list is part of the program, so its size is bounded."""
    rows = spark.createDataFrame(known or KNOWN, "license_id string, text string")
    first = F.substring_index(canonical(F.col("text")), " ", 1)
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(first).alias("first"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, position, license_id, digest): units of whole texts that are a known license, for ``docs`` (doc_id, text).

    ``unit`` is ``document`` (position 0), ``paragraph`` (between blank lines, numbered from 0) or ``line``; a text of one
    line is reported as a document only, and a paragraph of one line as a line only. A null or empty text, or a unit
    without letters and digits, never matches. Rows with a null or repeated doc_id are scanned and reported each. Empty tables
    give no rows. Columns besides doc_id and text are not read. ``known`` (digest, license_id, first) is broadcast: it is a list of
    licenses that is written in the program or kept by hand.

    A unit without copyright marks whose first word begins no known text is not normalised at all: its canonical form begins with that word.
    """
    firsts = {r["first"] for r in known.select("first").distinct().collect()}
    firsts |= {old.split()[0] for old, new in SPELLINGS if " " in old or new.split()[0] in firsts}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    text = F.regexp_replace("text", r"\r\n?", "\n")
    whole = F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("position"), text.alias("body")))

    def units(name: str, parts: Column, keep) -> Column:
        numbered = F.transform(parts, lambda part, i: F.struct(F.lit(name).alias("unit"), i.cast("int").alias("position"), part.alias("body")))
        return F.filter(numbered, keep)

    several = F.contains(F.trim(text), F.lit("\n"))
    paragraphs = units("paragraph", F.split(text, r"\n[ \t]*\n"), lambda u: F.contains(F.trim(u["body"]), F.lit("\n")))
    lines = units("line", F.split(text, "\n"), lambda u: F.length(u["body"]) > 0)
    blank = F.rlike(text, F.lit(r"\n[ \t]*\n"))
    parts = F.when(several & blank, F.concat(whole, paragraphs, lines)).when(several, F.concat(whole, lines)).otherwise(whole)
    exploded = rows.select("doc_id", F.explode(parts).alias("u")).select("doc_id", "u.*")
    begins = F.lower(F.regexp_extract("body", r"[\p{L}\p{N}]+", 0)).isin(*sorted(firsts))
    exploded = exploded.where(begins | marked(F.lower("body")))
    hashed = exploded.withColumn("digest", digest(F.col("body"))).drop("body")
    return hashed.join(F.broadcast(known), "digest").select("doc_id", "unit", "position", "license_id", "digest")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"' ' || regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


ORACLE = f"""
WITH k AS (
  SELECT sha256({_canonical_sql("t")}) AS digest, min(l) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}) v(l, t) GROUP BY 1
), d AS (
  SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT *, contains(trim(t, ' '), chr(10)) AS several FROM d
), u AS (
  SELECT doc_id, 'document' AS unit, 0 AS position, t AS body FROM s
  UNION ALL
  SELECT doc_id, 'paragraph', CAST(unnest(range(len(p))) AS INTEGER), unnest(p) FROM (SELECT doc_id, regexp_split_to_array(t, '\\n[ \\t]*\\n') AS p FROM s WHERE several AND regexp_matches(t, '\\n[ \\t]*\\n'))
  UNION ALL
  SELECT doc_id, 'line', CAST(unnest(range(len(p))) AS INTEGER), unnest(p) FROM (SELECT doc_id, string_split(t, chr(10)) AS p FROM s WHERE several)
)
SELECT u.doc_id, u.unit, u.position, k.license_id, k.digest
FROM u JOIN k ON k.digest = sha256({_canonical_sql("u.body")})
WHERE unit = 'document' OR unit = 'line' AND length(body) > 0 OR unit = 'paragraph' AND contains(trim(body, ' '), chr(10))
"""
