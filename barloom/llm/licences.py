"""Licence scan by canonical digests.

A text is made canonical line by line: lower case, equivalent spellings replaced, everything but letters and digits turned into
single spaces, copyright lines (`copyright_line`) and empty lines dropped; the lines are joined by spaces, so line breaks do not matter,
also where a clause of the licence goes on with "copyright" in the next line. The
SHA-256 of that is looked up among the digests of known licences by a hash join: whole texts against licence texts, single
lines against licence notices. Known texts are a table (licence, kind, text), so others can be added; it is broadcast after its
rows are counted. The query's table is KNOWN and `known_licences.jsonl`, one licence wording a line: {licence, titles, rights_line,
text} stands for the text under each of its titles ("" for none), with and without "All rights reserved."; {licence, names, spdx}
for the usual one-line notices with these names and identifiers.

Null, empty and punctuation-only texts have the digest of the empty string, which no licence has. Repeated rows are reported
alike, known texts with equal digests once, under the first name. Empty tables give an empty result. Only the id is carried.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.registry import query, table

BROADCAST_ROWS = 100_000

#: Equivalent words of the published matching guidelines, as regular expressions on lower-case text, the form kept, and
#: parts of which every match holds one.
SPELLINGS = (
    (r"https?://", "", "://"),
    (r"licence", "license", "licence"),
    (r"\b(analog|catalog)ue(s?)\b", "$1$2", "alogue"),
    (r"\banalys(e|ed|er|es|ing)\b", "analyz$1", "analys"),
    (r"\b(author|capital|categor|emphas|initial|maxim|optim|organ|real|recogn|util)is(e|ed|er|es|ing|ation|ations)\b", "$1iz$2", "ise|ising|isation"),
    (r"\b(calib|cent)re(s?)\b", "$1er$2", "calibre|centre"),
    (r"\b(cancel|label|model|signal)l(ed|ing)\b", "$1$2", "lled|lling"),
    (r"\b(fav|lab)our", "$1or", "favour|labour"),
    (r"\b(acknowledg|judg)ement", "$1ment", "dgement"),
    (r"\bfulfil(s|ment|)\b", "fulfill$1", "fulfil"),
    (r"\b(artefact)", "artifact", "artefact"),
    (r"\boffence", "offense", "offence"),
    (r"\bpractis", "practic", "practis"),
    (r"\bprogramme(s?)\b", "program$1", "programme"),
    (r"\bwhilst\b", "while", "whilst"),
    (r"\bwill?full?\b", "willful", "wilful|willful"),
)
#: The same for more than one word, after punctuation has become spaces; a line may break inside.
PHRASES = (
    (r"\bcopyright holder", "copyright owner", "copyright holder"),
    (r"\bnon (commercial|infring)", "non$1", "non commercial|non infring"),
    (r"\bsub licen[cs]", "sublicens", "sub licen"),
    (r"\bper cent\b", "percent", "per cent"),
    (r"\bversion 2 0\b", "version 2", "version 2 0"),
)
#: Words after "copyright" that go on with a clause; a name follows otherwise.
_CLAUSE = (
    r"notices?|holders?|owners?|ownership|laws?|licen[cs]e[sd]?|statements?|interests?|disclaimers?|lines?|permissions?|protection|rights?|treaty|treaties|"
    r"doctrines|registration|infringement|patents?|trademarks?|resulting|file|information|and|or|of|on|in|is|are|if|for|to|as|with|also|like|those|that|"
    r"which|under|may|shall|must|will|the\s+(software|library|program|work)"
)
_YEAR = r"((19|20)\d\d|\d\dyy|yyyy|year\b)"
_MARKED = rf"(\W*({_YEAR}|\(c\)|©)|\s*[\[<{{])"
#: A copyright line: © or the word or (c) before a year, a placeholder or another mark; the word before a name; (c) in a line that ends in a
#: year. Wrapped clauses ("copyright notice and ...", "COPYRIGHT HOLDERS BE LIABLE") and clauses lettered (c) are none.
_MARK = rf"^\W*(©|(\(c\)\W*)?copyright\b{_MARKED}|\(c\)({_MARKED}|\s.*\b(19|20)\d\d\W*$))"
_NAME = r"^\W*(\(c\)\W*)?copyright\b\s*:?\s+[\p{L}\p{N}]"
_GOES_ON = rf"^\W*(\(c\)\W*)?copyright\b\s*:?\s+({_CLAUSE})\b"

#: Public licence texts and notices. Only the words count, not their layout.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", "text", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "text", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("Zlib", "text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be "
     "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
     "product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
     "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
)
#: Lines that name a licence; {} is the name. The last is the first line of the usual header of the Apache License.
NOTICES = (
    *(f"{start}{how} under {the}{{}}" for start in ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ")
      for how in ("licensed", "released", "distributed") for the in ("", "the ", "the terms of the ", "a ")),
    'Licensed under the {} (the "License");',
)


def _replaced(items: Column, spellings: tuple[tuple[str, str, str], ...]) -> Column:
    """An array of texts with all replacements; a search for plain parts spares most texts the regular expressions."""

    def one(pattern: str, kept_form: str, parts: str) -> Callable[[Column], Column]:
        found = [F.lit(p) for p in parts.split("|")]
        return lambda x: F.when(reduce(or_, (F.contains(x, p) for p in found)), F.regexp_replace(x, pattern, kept_form)).otherwise(x)

    for spelling in spellings:
        items = F.transform(items, one(*spelling))
    return items


def copyright_line(line: Column) -> Column:
    return F.rlike(line, F.lit(_MARK)) | (F.rlike(line, F.lit(_NAME)) & ~F.rlike(line, F.lit(_GOES_ON)))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, before phrases are replaced."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1)
    lines = F.filter(lines, lambda x: ~copyright_line(x))

    lines = F.transform(_replaced(lines, SPELLINGS), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    return F.array_remove(lines, "")


def digest(canonical: Column) -> Column:
    """The digest of canonical lines joined by spaces, phrases replaced."""
    return F.sha2(_replaced(F.array(canonical), PHRASES)[0], 256)


def known_digests(known: DataFrame) -> DataFrame:
    """Columns kind, digest, licence of a table of known texts (licence, kind, text)."""
    found = digest(F.array_join(canonical_lines(F.col("text")), " "))
    return known.groupBy("kind", found.alias("digest")).agg(F.min("licence").alias("licence"))


def data_rows() -> list[dict]:
    return [json.loads(line) for line in (Path(__file__).parent / "known_licences.jsonl").read_text("utf-8").splitlines()]


def wordings() -> Iterator[tuple[str, str, str]]:
    """Rows (licence, kind, text) of the data file."""
    for row in data_rows():
        for title in row.get("titles", []):
            for rights in ("", "All rights reserved.")[: 1 + row["rights_line"]]:
                yield row["licence"], "text", f"{title}\n{rights}\n{row['text']}"
        for name in row.get("names", []):
            for notice in NOTICES:
                yield row["licence"], "notice", notice.format(name)
        for name in row.get("spdx", []):
            yield row["licence"], "notice", f"SPDX-License-Identifier: {name}"


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *wordings()], "licence STRING, kind STRING, text STRING")


def scan(docs: DataFrame, known: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: id, digest, licence (of the whole text, else null), notices (licences of its lines, sorted).

    Texts are made canonical once. The parts of a document meet in one task and are combined there, so one row of it is shuffled;
    repeated rows are counted by partition and written out again, so no group is larger than a partition of the input.
    """
    digests = known_digests(known)
    small = digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda x: x)
    rows = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("row"), F.spark_partition_id().alias("part"),
        canonical_lines(F.col(text_column)).alias("lines"),
    )
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.array_join("lines", " ").alias("x")))
    lines = F.transform("lines", lambda x: F.struct(F.lit("notice").alias("kind"), x.alias("x")))
    parts = rows.select("id", "row", "part", F.inline(F.concat(whole, lines)))
    parts = parts.select("id", "row", "part", "kind", digest(F.col("x")).alias("digest")).join(side(digests), ["kind", "digest"], "left")
    text = F.col("kind") == "text"
    found = parts.groupBy("id", "row", "part").agg(
        F.count_if(text).alias("times"), F.min(F.when(text, F.col("digest"))).alias("digest"), F.min(F.when(text, F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(~text, F.col("licence")))), ",").alias("notices"),
    )
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return found.select(F.col("id").alias(id_column), "digest", "licence", "notices")


def _sql() -> str:
    """The same over the same known wordings; titles, rights lines, names and notices are crossed in SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def values(rows: list[tuple[str, ...]]) -> str:
        return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) for x in row) + ")" for row in rows) + ")"

    def replaced(x: str, spellings: tuple[tuple[str, str, str], ...]) -> str:
        for pattern, kept_form, _ in spellings:
            x = f"regexp_replace({x}, '{pattern}', '{kept_form.replace('$', chr(92))}', 'g')"
        return x

    def canonical(x: str) -> str:
        line = rf"trim(regexp_replace({replaced('x', SPELLINGS)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        right = f"regexp_matches(y, '{_MARK}') OR (regexp_matches(y, '{_NAME}') AND NOT regexp_matches(y, '{_GOES_ON}'))"
        lines = f"list_filter(string_split(lower(coalesce({x}, '')), chr(10)), lambda y: NOT ({right}))"
        return f"list_filter(list_transform({lines}, lambda x: {line}), lambda z: z <> '')"

    known = data_rows()
    whole = [(r["licence"], f"{title}\n", rights, r["text"]) for r in known for title in r.get("titles", []) for rights in ("\n", "All rights reserved.\n")[: 1 + r["rights_line"]]]
    texts_ = {t: str(k) for k, t in enumerate(dict.fromkeys(w[3] for w in whole))}
    heads = values([(n, title, rights, texts_[t]) for n, title, rights, t in whole])
    named = values([(r["licence"], name) for r in known for name in r.get("names", [])])
    spdx = values([(r["licence"], name) for r in known for name in r.get("spdx", [])])
    notices = values([(n.split("{}")[0], n.split("{}")[1]) for n in NOTICES])
    return f"""
WITH v AS (
  SELECT * FROM {values(KNOWN)} v(licence, kind, t)
  UNION ALL SELECT h.licence, 'text', h.title || h.rights || b.body FROM {heads} h(licence, title, rights, n)
    JOIN {values([(k, t) for t, k in texts_.items()])} b(n, body) USING (n)
  UNION ALL SELECT licence, 'notice', a || name || z FROM {named} l(licence, name), {notices} o(a, z)
  UNION ALL SELECT licence, 'notice', 'SPDX-License-Identifier: ' || name FROM {spdx} i(licence, name)
), k AS (
  SELECT kind, {replaced(f"array_to_string({canonical('t')}, ' ')", PHRASES)} AS c, min(licence) AS licence FROM v GROUP BY ALL
), d AS (SELECT doc_id, {canonical('text')} AS ls FROM documents
), w AS (SELECT doc_id, ls, {replaced("array_to_string(ls, ' ')", PHRASES)} AS c FROM d
), n AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, {replaced('l', PHRASES)} AS c FROM (SELECT doc_id, unnest(ls) AS l FROM d)) JOIN k USING (c) WHERE kind = 'notice' GROUP BY doc_id
)
SELECT w.doc_id, sha256(w.c) AS digest, k.licence, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN k ON k.kind = 'text' AND k.c = w.c LEFT JOIN n USING (doc_id)
"""


@query("op5_licence_digests", _sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical digest, licence and licence notices of every document."""
    return scan(table(spark, folder, "documents"), known_table(spark))
