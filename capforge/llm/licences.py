"""Licence scan by canonical digest (DataFrame functions only).

A text's canonical form: lower case, without copyright notices, punctuation as single spaces, equivalent
spellings made one. Its SHA-256 is hash-joined with those of the known licences: a text is a licence when
its whole canonical form is one. Lines that state a licence are found the same way, a line being a text.
Everything is one row's expression and a broadcast join with the known table (counted first; beyond the
bound a salted join takes its place); texts are not shuffled.

Defined results: null and empty texts, and texts of punctuation or copyright notices alone, have the empty
form and match nothing; of known licences with equal forms the smallest id is reported; rows that repeat
are all returned; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import pkgutil
import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capforge.llm.common import join_per_key, stored, text_or_empty, with_row_id

# Notices left out, marks that count as spaces, and spellings that count as equal.
# A notice begins a line or follows a licence's title there: marker, years, holder, reserved rights. The holder goes up to the
# end of its sentence, of the line, or to what begins a licence or statement, in 25 words; else only marker and years are one.
NEXT = (r"(?=(?:permission|redistribution|licensed|released|distributed|published|available|this|the software|all rights|everyone"
        r"|you may|spdx-license-identifier:?) )")
LAST = r"(?!(?:inc|ltd|co|corp|jr|sr|dr|mr|mrs|st|llc|no|vs)\.(?:\s|$))\S*[^\s.!?;][^\s.!?;][.!?;]+(?:\s+|$)"
NOTICE = (r"^((?:(?:the )?[a-z0-9 .,-]{0,40}licen[sc]e[^a-z0-9©(]*(?:\([a-z0-9 .-]{2,20}\)[^a-z0-9©(]*)?)?)[^a-z0-9]*(?:copyright|©|\(c\))"
          r"[^a-z]*(?:\(c\)|©|[0-9]{4})(?:[\s,;:–-]|(?:19|20)[0-9]{2}|\(c\)|©|present\b|by\b)*+"
          rf"(?:(?:(?!{NEXT})(?!{LAST})\S+(?:\s+|$)){{0,25}}?(?:(?!{NEXT}){LAST}|{NEXT}|$))?(?:all rights reserved[^a-z0-9]*)*")
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F«»“”„‘’‚…–—·•©®™]+"
PATTERNS = [
    (r" (author|capital|categor|character|emphas|initial|maxim|minim|optim|organ|real|recogn|util)is(e|ed|es|ing|ation|ations) ",
     " $1iz$2 "),
    (r" (behavi|col|fav|hon|lab)our", " $1or"),
    (r" (acknowledg|judg)ement", " $1ment"),
]
WORDS = [("licenc", "licens"), (" whilst ", " while "), (" centre ", " center "), (" catalogue ", " catalog "),
         (" programme ", " program "), (" artefact", " artifact"), (" copyright owner", " copyright holder"),
         (" per cent ", " percent "), (" sub licens", " sublicens"), (" non commercial ", " noncommercial "),
         (" https ", " http ")]

# Public licence texts and statements.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT (statement)": "Released under the MIT License.",
}


def line_form(line: Column) -> Column:
    """The canonical form of one line."""
    out = F.lower(line)
    out = F.regexp_replace(out, NOTICE, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, MARKS, "  "), F.lit(" "))  # each word with spaces of its own
    for pattern, to in PATTERNS:
        out = F.regexp_replace(out, pattern, to)
    return same_spelling(F.replace(out, F.lit("  "), F.lit(" ")), WORDS)


def same_spelling(words: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        words = F.replace(words, F.lit(old), F.lit(new))
    return F.trim(words)


def line_forms(text: Column) -> Column:
    lines = F.split(F.replace(F.replace(text_or_empty(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    return F.filter(F.transform(lines, line_form), lambda x: x != "")


def joined(forms: Column) -> Column:
    """The canonical form of a text from those of its lines: what spans two lines is spelled here."""
    spanning = [(old, new) for old, new in WORDS if " " in old.strip()]
    return same_spelling(F.concat(F.lit(" "), F.array_join(forms, " "), F.lit(" ")), spanning)


def form_digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((texts or KNOWN).items()), "licence string, text string")


def whole_texts(titles: list[str], text: str) -> list[str]:
    """A licence's text under each usual title or none, with or without reserved rights, with or without the appendix
    after its terms, list numbers and lines to be filled in."""
    ends = [text] + [text[:m.end()] for m in [re.search(r"END OF TERMS AND CONDITIONS", text)] if m]
    unfilled = [re.sub(r"(?im)^\s*copyright\b.*[\[<{](yyyy|year)\b.*$", "", t) for t in ends]
    numberless = [re.sub(r"(?m)^\s*[1-4][.)]\s", "", t) for t in ends + unfilled if t.startswith("Redistribution")]
    return [f"{head}\n{rights}\n{t}" for head, rights, t in product(
        ["", *titles], ["", "All rights reserved."], dict.fromkeys(ends + unfilled + numberless))]


def statements(name: str) -> list[str]:
    """One-line statements of the licence ``name``."""
    verbs, things = ("licensed", "released", "distributed", "published", "available"), (
        "work", "project", "software", "program", "code", "library", "file", "document", "package", "text", "dataset")
    heads = [f"{v} under" for v in verbs] + [f"this {t} is {v} under" for t in things for v in verbs]
    return [f"SPDX-License-Identifier: {name}"] + [f"{h} {the}{name}{end}" for h in heads for the in ("", "the ") for end in (
        "", *(() if "license" in name.lower() else (" license",)))]


def licence_table(spark: SparkSession) -> DataFrame:
    """KNOWN, and the texts and statements of ``licences.jsonl`` (read by the driver, so that tasks need no file): for each
    licence its usual titles, the names it is stated by and its texts (none: KNOWN's, if it is there)."""
    rows = list(KNOWN.items())
    for x in map(json.loads, pkgutil.get_data("capforge.llm", "licences.jsonl").decode().splitlines()):
        texts = x["texts"] or [KNOWN[k] for k in (x["licence"],) if k in KNOWN]
        rows += [(x["licence"], t) for text in texts for t in whole_texts(x["titles"], text)]
        rows += [(f"{x['licence']} (statement)", t) for name in [x["licence"], *x["names"]] for t in statements(name)]
    return spark.createDataFrame(sorted(set(rows)), "licence string, text string")


def scan_licences(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, canonical_sha256 (null: empty form), licence (of the whole text),
    n_stated (different licences that whole lines state) and first_stated (the smallest of them)."""
    table = known.select("licence", line_forms(F.col("text")).alias("forms")).select(
        "licence", form_digest(joined(F.col("forms"))).alias("digest")).filter(
        "digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))
    forms = docs.select(F.col(doc_id).alias("doc_id"), line_forms(F.col(text)).alias("forms"))
    rows = stored(with_row_id(forms.select(
        "doc_id", form_digest(joined(F.col("forms"))).alias("digest"),
        F.transform(F.array_distinct("forms"), lambda x: F.sha2(x, 256)).alias("lines")), "rid"), "forms")
    lines = rows.select("rid", F.explode("lines").alias("digest"))
    stated = join_per_key(lines, table, "digest").filter("licence is not null").groupBy("rid").agg(
        F.countDistinct("licence").alias("n_stated"), F.min("licence").alias("first_stated"))
    whole = join_per_key(rows.select("rid", "doc_id", "digest"), table, "digest")
    return whole.join(stated, "rid", "left").select(
        "doc_id", F.col("digest").alias("canonical_sha256"), "licence",
        F.coalesce("n_stated", F.lit(0)).cast("long").alias("n_stated"), "first_stated")
