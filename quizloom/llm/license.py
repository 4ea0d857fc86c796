"""License scan by canonical digest, in DataFrame operations only.

A text is normalised (lower case, spellings that mean the same, copyright statements dropped,
punctuation of any script's quotes and dashes, and white space, to single spaces) and the digest of the whole of it is hash-joined to the digests of
known licences: `KNOWN` and the whole texts in the folder `licenses`, each also below its usual titles, or a table of the caller's. The
fixed ones are few, so they are broadcast. How a text is cut into lines doesn't matter.

Nulls: a null text is empty; an empty canonical text matches nothing. Rows with a null id and
repeated rows are scanned like all others. Extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, replacement), in this order. Patterns mean the same to Java and to RE2.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-licens", "sublicens"),
    ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("https?://", ""),
    ("&", " and "),
)
#: The SQL's pattern for lines that name the owner or the year. It also takes lines of a licence's body.
COPYRIGHT_LINE = "(?md)^[^a-z0-9\\n]*(copyright |\\(c\\) |© |all rights reserved)[^\\n]*$"
#: Where licences begin after their owner.
OPENING = "(?:" + "|".join(
    x.replace(" ", "\\s+")
    for x in ("permission is hereby granted", "permission to use", "redistribution and use", "this software is provided", "licensed under", "everyone is permitted", "this program is free software", "this library is free software", "this program comes with", "gnomovision comes with", "this is free and unencumbered")
) + ")"
#: What follows the word copyright, or an enumerating (c), in a licence's body. Java's patterns from here.
_BODY = "(?:notices?|patents?|ownership|owners?|holders?|laws?|licenses?|statements?|interests?|rights?|treat(?:y|ies)|protection|disclaimers?|claims?|and|or|in|of|on|to|is|are|that|as|under|may|shall|which|infringement|permission)\\b"
_LISTED = "(?:you|under|the|an?|any|all|if|to|for|in|it|on|by|with|where|when|that|this|and|or|make|give|retain|use)\\b"
_OWNER = "(?:(?:portions |parts )?(?:are )?copyright(?:[ \\t:]+|,[ \\t]*(?=[0-9(©]))(?!" + _BODY + ")|©\\s*|\\(c\\)[ \\t]+(?!" + _LISTED + "))"
_CLAUSE = "\\b(?:licenses?|may|must|not|you|shall|only|warrant(?:y|ies)|provided)\\b|\\n[ \\t]*\\n"
STATEMENTS = (
    # Up to a licence's begin: with a sign or a year anywhere, else from a line's begin; no clause is dropped with it.
    "(?md)(?:copyright\\s+(?:\\(c\\)|©|[<\\[]|[0-9]{4})|^[^a-z0-9\\n]*(?:" + _OWNER + "|all rights reserved))(?:(?!" + OPENING + ")(?!" + _CLAUSE + ")[\\s\\S]){0,300}+(?=" + OPENING + ")",
    # Whole lines, where none begins.
    "(?md)^[^a-z0-9\\n]*(?:" + _OWNER + "|all rights reserved)(?:(?!" + OPENING + ")[^\\n])*$",
)
#: A line that names the licence to tools.
SPDX = "(?md)^[^a-z0-9\\n]*spdx-license-identifier:[^\\n]*$"
#: Punctuation and spaces beyond ASCII.
MARKS = "\u00a0\u00ab\u00b7\u00bb\u2002\u2003\u2009\u200b\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u2022\u2026\u2032\u2033\u2039\u203a\u3000\ufeff"
#: Lines that may stand above a licence's text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "License: ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
PUNCTUATION = "[\\x00-/:-@\\[-`{-\\x7f]+"

#: Short public licence texts and notices by SPDX name.
KNOWN = (
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
)


def canonical(text: Column) -> Column:
    """The normalised text; ASCII capitals only are lowered, so that every engine agrees."""
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS, "abcdefghijklmnopqrstuvwxyz" + " " * len(MARKS))
    out = F.regexp_replace(out, F.lit("\\r\\n?"), F.lit("\n"))
    for pattern, replacement in EQUIVALENT:
        # The plain patterns don't need a regular expression.
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement)) if "?" in pattern else F.replace(out, F.lit(pattern), F.lit(replacement))
    out = F.regexp_replace(out, F.lit(SPDX), F.lit(""))
    # A statement up to a licence's begin takes long to look for in texts of many owners: only where one begins.
    out = F.when(out.rlike(OPENING), F.regexp_replace(out, F.lit(STATEMENTS[0]), F.lit(""))).otherwise(out)
    out = F.regexp_replace(out, F.lit(STATEMENTS[1]), F.lit(""))
    out = F.trim(F.regexp_replace(out, F.lit(PUNCTUATION), F.lit(" ")))
    return F.replace(out, F.lit("copyright holder"), F.lit("copyright owner"))  # also where a line ended between them


def whole_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN and the texts of the folder licenses, by their names."""
    return KNOWN + tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


def titled_texts() -> tuple[tuple[str, str], ...]:
    """The whole texts, plain and below each of their titles."""
    return tuple((name, head + text) for name, text in whole_texts() for head in ("", *(f"{t}\n\n" for t in TITLES.get(name, ()))))


def known_digests(spark, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """license, known_digest of each known text."""
    rows = F.inline(F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known or titled_texts())))
    return spark.range(1).select(rows).select("license", F.sha2(canonical(F.col("text")), 256).alias("known_digest"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """id, canonical_digest, license (null if the text is no known licence) of every row."""
    fixed = known is None
    known = (known_digests(docs.sparkSession) if known is None else known).groupBy("known_digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("plain"))
    rows = rows.select("id", F.sha2("plain", 256).alias("canonical_digest"), (F.col("plain") != "").alias("some"))
    rows = rows.join(F.broadcast(known) if fixed else known, F.col("some") & (F.col("canonical_digest") == F.col("known_digest")), "left")
    return rows.select(F.col("id").alias(id_col), "canonical_digest", "license")
