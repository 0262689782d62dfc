"""License scans: canonical digests of whole texts and of their lines, joined to those of known licenses, in SQL functions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known texts by name: full short licenses and the notices by which others are declared. The registered query adds
#: full_texts(); the SQL has these alone, which are all that the test tables hold. A caller may pass more.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = _ISC.split(", provided")[0] + ".\n\n" + _ISC.split("\n\n")[1]
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _ZERO),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Titles that a text has or has not above it; those of the others are in their files.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "The BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Where the terms end in texts that have an appendix on how to apply them.
_END = "END OF TERMS AND CONDITIONS"
#: Spellings that count as one, after case and punctuation are gone; longer ones first where they overlap.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("https", "http"))
#: Words that go on after "copyright" in running text, which a line may begin with wherever it is wrapped.
_PROSE = r"(?:notices?|holders?|owners?|laws?|licen[cs]es?|and|or|on|in|of|is|are|if|disclaimer|interests?|treaty|permission|statement|doctrines?)\b|the(?:[ \t\r]*$|[ \t]+(?:software|library)\b)"
#: A line that is a notice: a sign, a year, a placeholder or a name after "copyright", a year after the sign.
_NOTICE = rf"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©)|copyright[ \t:]+(?!{_PROSE})[\p{{L}}\p{{N}}<\[{{]|\(c\)[ \t]*(?:copyright\b|\d{{4}})|©|all rights reserved[. \t\r]*$)[^\n]*$"
#: The SQL's own, wider form: it drops every line that begins so. Both agree on the test tables.
_SQL_NOTICE = r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case without copyright notices, each run of other characters than letters and digits a space, spellings made one."""
    out = F.regexp_replace(F.lower(text), _NOTICE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def digests(known: DataFrame) -> DataFrame:
    """(digest, letters, license) of known (license, text): one row for each canonical text and name."""
    form = known.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.select(F.sha2(F.col("form").cast("binary"), 256).alias("digest"), F.length("form").alias("letters"), "license").distinct()


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole licenses of license_texts and above, with and without titles, list numbers and appendix."""
    out = []
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    for name, text in [("MIT", _MIT), ("ISC", _ISC), ("0BSD", _ZERO), *((f.stem, f.read_text("utf-8")) for f in files)]:
        forms = [text]
        if _END in text:
            terms = text[: text.index(_END)]
            forms += [terms, terms + _END]
        if name in TITLES:
            forms += [re.sub(r"(?m)^\d\. ", "* ", text)]
        out += [(name, head + form) for form in forms for head in ("", *(f"{t}\n\n" for t in TITLES.get(name, ())))]
    return out


def known_licenses(spark) -> DataFrame:
    """(license, text): KNOWN and full_texts()."""
    known = list(dict.fromkeys([*KNOWN, *full_texts()]))
    rows = ", ".join(f"(:n{i}, :t{i})" for i in range(len(known)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, text)", args={f"{k}{i}": x for i, pair in enumerate(known) for k, x in zip("nt", pair)})


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, scope, line, license): a row for each whole text or line that is a known license.

    scope is `text` (line 0) if the whole text is one, `line` (its number from 1) if a line of a longer text is.
    Documents without any give no row; null and empty texts have none. Repeated rows are scanned each; a null doc_id
    stays null. What is shorter than the shortest known text isn't digested, as no match can be. Known licenses are a
    table of stated texts; it is joined by digest, and broadcast only if Spark finds it below its threshold.
    """
    table = digests(known)
    least = F.lit(table.agg(F.min("letters")).first()[0])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def part(scope: str, line, form) -> Column:
        return F.struct(F.lit(scope).alias("scope"), line.cast("int").alias("line"), form.alias("form"))

    rows = docs.select("doc_id", text.alias("text")).withColumn("lines", F.split("text", "\n"))
    lines = F.when(F.size("lines") > 1, F.transform("lines", lambda x, i: part("line", i + 1, x))).otherwise(F.array().cast("array<struct<scope:string,line:int,form:string>>"))
    parts = rows.select("doc_id", F.explode(F.concat(F.array(part("text", F.lit(0), F.col("text"))), lines)).alias("p"))
    parts = parts.where(F.length("p.form") >= least).select("doc_id", "p.scope", "p.line", canonical(F.col("p.form")).alias("form")).where(F.length("form") >= least)
    return parts.withColumn("digest", F.sha2(F.col("form").cast("binary"), 256)).join(table, "digest").select("doc_id", "scope", "line", "license")


def oracle() -> str:
    """The same as DuckDB SQL over documents, but for full_texts() and lines in running text that begin with "copyright" (see _SQL_NOTICE)."""
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({text}), {quote(_SQL_NOTICE)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))".replace("\\\\", "\\")
        for other, one in SPELLINGS:
            out = f"replace({out}, {quote(other)}, {quote(one)})"
        return out

    known = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {form("text")} AS form FROM (VALUES {known}) t(license, text)),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
parts AS (
  SELECT doc_id, 'text' AS scope, 0 AS line, text FROM documents
  UNION ALL
  SELECT doc_id, 'line', i::INT, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines WHERE len(l) > 1))
SELECT doc_id, scope, line, license FROM (SELECT doc_id, scope, line, {form("text")} AS form FROM parts) JOIN known USING (form)
"""
