"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, lines that state a copyright
left out (copyright before a year, (c), a placeholder or a holder's name, but not
a wrapped "copyright notice and ..."), every run of other characters than letters
and digits one blank, equivalent spellings written alike. The digests of the
whole canonical text and of each of its lines are hash-joined to the digests of
known licence texts and notices, which went through the same expressions.
Everything is a built-in function. The known licences are a table that ``scan``
takes; the one it has by itself is ``known_texts()``, a fixed list, so
broadcasting it is bounded.

Defined results: null and empty texts, and texts of punctuation alone, have the
digest of the empty text and match nothing; texts of any length are digested
whole; repeated rows and null ids are answered row by row; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm._tables import stored

#: Public licence texts and notices, by SPDX name; ``license_texts`` has the longer ones.
KNOWN = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <owner>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE."),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE."),
    "notice:MIT": "Released under the MIT License.",
    "notice:MIT-licensed": "Licensed under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:GPL-3.0-released": "Released under the GNU General Public License, version 3.",
    "notice:CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice:CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

#: Spellings that licence texts use for each other.
EQUIVALENT = (
    ("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("and or", "and or"),
)

#: A line that states a copyright: the word before (c), a year, a placeholder or a name, or a sign before a year.
STATEMENT = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:"
    r"(?i:copyright)[ \t:,.]*(?:(?i:\(c\)|&copy;)|©|[<\[{]|\(?(?:19|20)\d\d)"
    r"|(?i:copyright)[ \t]+(?:(?i:by)[ \t]+)?(?:(?i:the)[ \t]+)?(?!(?i:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|acts?|"
    r"rights?|interests?|and|or|in|of|is|to|on|for|as|protection|treat(?:y|ies)|infringements?|claims?|information|disclaimers?|"
    r"permissions?|terms?|status|years?)\b)\p{Lu}"
    r"|©|(?i:\(c\)[ \t]*copyright)|(?i:\(c\))[ \t]*(?:©|[<\[{]|(?:19|20)\d\d|[^\n]*(?:19|20)\d\d[^\p{L}\p{N}\n]*$))[^\n]*")

#: Titles under which a text is published, none among them, and the number of title lines that the file has.
TITLES = {
    "MIT": (0, "", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": (0, "", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": (0, "", "Zero-Clause BSD", "BSD Zero Clause License", "0BSD", "BSD Zero-Clause License"),
    "BSD-2-Clause": (0, "", "BSD 2-Clause License", "The 2-Clause BSD License", "BSD License", "The BSD License",
                     "Simplified BSD License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": (0, "", "BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "The BSD License",
                     "New BSD License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": (0, "", "The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
    "Apache-2.0": (3, ""), "MPL-2.0": (2, ""), "GPL-2.0": (2, ""), "GPL-3.0": (2, ""), "LGPL-2.1": (2, ""), "LGPL-3.0": (2, ""),
    "CC0-1.0": (2, "", "CC0 1.0 Universal"),
}


def _without_lines(text: str, n: int) -> str:
    """``text`` without its first ``n`` lines that are not blank."""
    rows = text.split("\n")
    for _ in range(n):
        rows = rows[next(i for i, x in enumerate(rows) if x.strip()) + 1:]
    return "\n".join(rows)


def variants(name: str, text: str) -> set[str]:
    """The text with and without its titles, appendix, list numbers and ``All rights reserved``, with either kind of URL."""
    n, *titles = TITLES[name]
    if name in ("MIT", "ISC"):
        n = 1  # KNOWN has them with one
    body = _without_lines(text, n)
    out = {text} | {f"{t}\n\n{body}" for t in titles}
    if "END OF TERMS AND CONDITIONS" in text:
        out |= {t.split("END OF TERMS AND CONDITIONS")[0] + end for t in out for end in ("", "END OF TERMS AND CONDITIONS")}
    if name.startswith("BSD"):
        out |= {t.replace("All rights reserved.", "") for t in out}
        out |= {re.sub(r"(?m)^\d\. ", "* ", t) for t in out}
    return out | {t.replace("http://", "https://") for t in out} | {t.replace("https://", "http://") for t in out}


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): the notices of ``KNOWN``, and its texts and those of ``license_texts`` in all variants."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    texts = dict(KNOWN)
    for f in sorted(os.listdir(folder)):
        with open(os.path.join(folder, f), encoding="utf-8") as file:
            texts[f.removesuffix(".txt")] = file.read()
    return sorted((k, v) for k, t in texts.items() for v in (variants(k, t) if k in TITLES else {t}))


def canonical_lines(text: Column) -> Column:
    """The canonical text, line by line (lines joined by a line feed)."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), STATEMENT, ""))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    for a, b in EQUIVALENT:
        if a != b:
            t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def whole(lines: Column) -> Column:
    return F.trim(F.translate(lines, "\n", " "))


def digest(t: Column) -> Column:
    return F.sha2(t.cast("binary"), 256)


def scan(docs: DataFrame, known: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, canonical_digest, license_id`` (of the whole text, else
    null) and ``line_licenses``, the sorted names of what its lines are.
    ``known`` is a table with ``license_id`` and ``text``, any number of texts a
    name; of several names for one text the smallest is the ``license_id``."""
    spark = docs.sparkSession
    fixed = not isinstance(known, DataFrame)
    if fixed:
        known = spark.createDataFrame(sorted(known.items()) if known else known_texts(), "license_id string, text string")
    names = known.select("license_id", whole(canonical_lines(F.col("text"))).alias("c")).filter("c != '' AND license_id IS NOT NULL")
    every = stored(names.select(digest(F.col("c")).alias("digest"), "license_id").distinct(), "licenses")
    bounded = F.broadcast if fixed else (lambda x: x)
    names = bounded(every.groupBy("digest").agg(F.min("license_id").alias("license_id")))
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("c"))
    # 16 bytes of a line's digest are enough to look it up
    rows = lines.select("doc_id", digest(whole(F.col("c"))).alias("digest"),
                        F.array_distinct(F.transform(F.split("c", "\n"), lambda x: F.unhex(F.substring(digest(F.trim(x)), 1, 32)))).alias("keys"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "license-rows")
    keyed = every.select(F.unhex(F.substring("digest", 1, 32)).alias("key"), F.col("license_id").alias("name"))
    hits = (rows.select("row", F.explode("keys").alias("key")).join(bounded(keyed), "key")
            .groupBy("row").agg(F.concat_ws(",", F.sort_array(F.collect_set("name"))).alias("line_licenses")))
    return (rows.join(names, "digest", "left").join(hits, "row", "left")
            .select("doc_id", F.col("digest").alias("canonical_digest"), "license_id",
                    F.coalesce("line_licenses", F.lit("")).alias("line_licenses")))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql(table: str = "documents") -> str:
    """The same scan in DuckDB's SQL."""
    canon = "lower(coalesce(text, ''))"
    canon = rf"regexp_replace({canon}, '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|©)[^\n]*', '', 'g')"
    canon = rf"regexp_replace({canon}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    canon = rf"regexp_replace({canon}, ' ?\n[ \n]*', chr(10), 'g')"
    for a, b in EQUIVALENT:
        if a != b:
            canon = f"replace({canon}, {_sql_text(a)}, {_sql_text(b)})"
    values = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in sorted(KNOWN.items()))
    return rf"""
WITH k AS (SELECT name, sha256(trim(replace(trim({canon}, ' '), chr(10), ' '), ' ')) AS digest FROM (VALUES {values}) t(name, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, trim({canon}, ' ') AS c FROM {table}),
w AS (SELECT r, doc_id, sha256(trim(replace(c, chr(10), ' '), ' ')) AS canonical_digest FROM d),
l AS (SELECT r, sha256(trim(unnest(string_split(c, chr(10))), ' ')) AS digest FROM d),
h AS (SELECT r, string_agg(name, ',' ORDER BY name) AS line_licenses
      FROM (SELECT DISTINCT r, name FROM l JOIN k USING (digest)) GROUP BY r)
SELECT w.doc_id, w.canonical_digest, k.name AS license_id, coalesce(h.line_licenses, '') AS line_licenses
FROM w LEFT JOIN k ON w.canonical_digest = k.digest LEFT JOIN h ON h.r = w.r
"""
