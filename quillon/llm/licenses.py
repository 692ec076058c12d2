"""Licence recognition by known sentences and ordered rules over their identifiers.

A text is cut into sentences, each sentence is normalised and looked up among
known licence sentences; the identifiers found, in text order, are matched
against ordered licence rules, longest rules first, and a rule uses up the
identifiers it matches. Built-in functions only: no shuffle, no Python.

A sentence ends at closing marks before white space or the text's end and at
blank lines (lines without an ASCII letter or digit, so comment frames too). A
single line end may be a wrap: a known sentence is found over any number of
whole lines, if it begins and ends where a line or sentence does. Marks at the
beginning of a line (comment leaders, bullets) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences (identifier, wording), from the public licence texts and common notices.
# A wording stops where the sentence break does ("v. 2.0" breaks behind the "v").
SENTENCES = [
    ("all-rights", "All rights reserved"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice-full", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "This project is licensed under the MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd-notice", "Licensed under the BSD License"),
    ("bsd2-notice", "Licensed under the BSD 2-Clause License"),
    ("bsd3-notice", "Licensed under the BSD 3-Clause License"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-notice", "Licensed under the GNU General Public License v3.0"),
    ("gpl2-notice", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl2-notice", "Licensed under the GNU General Public License v2.0"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-see", "See the GNU General Public License for more details"),
    ("lgpl-notice", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-notice", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("mpl-notice", "Licensed under the Mozilla Public License 2.0"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-zero", "Licensed under CC0 1.0"),
]

# Ordered licence rules (licence, identifiers in the order they must stand).
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache-notice-full", "apache-copy", "apache-asis", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-notice-full"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD", ["bsd-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("LGPL-3.0", ["lgpl-notice"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC0-1.0", ["cc-zero"]),
    ("Proprietary", ["all-rights"]),
]

# In the marked form letters are lower case, so capitals are free: S ends a sentence, L a line.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD_FROM, _FOLD_TO = _UPPER + "\f", _LOWER + "S"
#: (pattern, replacement) that turn a folded text into its marked form, in order; they mean the same in Java's and in RE2's syntax.
MARKING = [
    (r"(\r\n?|\n)[^a-z0-9S\r\n]*", "L"),
    (r"[.!?]+([ \tL]|\z)", "S"),
    (r"[^a-z0-9SL]+", " "),
    (r"[ SL]*(S|L *L)[ SL]*", ">|<"),
    (r" ?L ?", "><"),
]


def normal(sentence: str) -> str:
    """The normal form a sentence is looked up by: ASCII letters in lower case and digits, runs of anything else one space."""
    kept = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence)
    return " ".join(kept.split())


def known_sentences() -> dict[str, int]:
    """Normal form -> number of the identifier; one identifier may have several wordings."""
    numbers: dict[str, int] = {}
    for name, _ in SENTENCES:
        numbers.setdefault(name, len(numbers) + 1)
    return {normal(text): numbers[name] for name, text in SENTENCES}


def _numbers() -> dict[str, int]:
    known = known_sentences()
    return {name: known[normal(text)] for name, text in SENTENCES}


def rule_patterns() -> list[tuple[str, str]]:
    """(licence, pattern over the identifier sequence ``<1><2>``), in rule order."""
    numbers = _numbers()
    return [(name, "".join(f"<{numbers[i]}>" for i in ids)) for name, ids in RULES]


def sentence_pattern() -> str:
    """Any known sentence in a marked text, longest first; its words may be parted by line ends."""
    forms = sorted(known_sentences(), key=lambda s: (-len(s), s))
    return "<(?:" + "|".join(f.replace(" ", "(?: |><)") for f in forms) + ")>"


def marker_words() -> list[str]:
    """A few words of which every known sentence holds one: again and again the word that most of the sentences left hold."""
    left, out = [set(f.split()) for f in known_sentences()], []
    while left:
        most = max(sorted({w for f in left for w in f if len(w) > 4}), key=lambda w: sum(w in f for f in left))
        out.append(most)
        left = [f for f in left if most not in f]
    return out


def _may_hold(text: Column) -> Column:
    """Whether the text holds a marker word in any case: cheap, and never false where a known sentence stands."""
    lower, out = F.lower(text), F.lit(False)
    for word in marker_words():
        out = out | F.contains(lower, F.lit(word))
    return out


def _marked(text: Column) -> Column:
    """The text as ``<piece>`` for each line of a sentence, with ``|`` between sentences."""
    out = F.translate(text, _FOLD_FROM, _FOLD_TO)
    for pattern, replacement in MARKING:
        out = F.regexp_replace(out, pattern, replacement)
    return F.concat(F.lit("<"), F.trim(out), F.lit(">"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence sentences and licences of every row.

    Returns doc_id, n_sentences (known sentences found), sentence_ids (their
    numbers as ``<1><2>``, in text order), licenses (comma-joined, in text
    order, a licence as often as it stands) and n_licenses. Null, empty and
    punctuation-only texts give zeros and empty strings; ids are passed through
    unchanged, null and repeated ones too; an empty table gives no rows.
    """
    numbers = F.create_map(*[x for k, v in known_sentences().items() for x in (F.lit(k), F.lit(v))])
    matches = F.regexp_extract_all(_marked(F.col(text_col)), F.lit(sentence_pattern()), F.lit(0))
    matches = F.when(_may_hold(F.col(text_col)), matches).otherwise(F.array().cast("array<string>"))
    found = F.transform(matches, lambda m: F.element_at(numbers, F.regexp_replace(F.translate(m, "<", " "), "^ |>", "")))
    out = docs.select(F.col(id_col).alias("doc_id"), F.transform(found, lambda n: n.cast("string")).alias("__ids"))
    out = out.select("doc_id", F.size("__ids").cast("long").alias("n_sentences"), F.when(F.size("__ids") > 0, F.concat(F.lit("<"), F.array_join("__ids", "><"), F.lit(">"))).otherwise("").alias("sentence_ids"))
    marked = F.col("sentence_ids")
    for name, pattern in rule_patterns():  # a rule's match becomes {licence}, which no later rule can use
        marked = F.replace(marked, F.lit(pattern), F.lit("{" + name + "}"))
    licenses = F.regexp_extract_all(marked, F.lit(r"\{([^}]*)\}"), F.lit(1))
    out = out.withColumn("__licenses", licenses)
    return out.select("doc_id", "n_sentences", "sentence_ids", F.array_join("__licenses", ",").alias("licenses"), F.size("__licenses").cast("long").alias("n_licenses"))


def oracle() -> str:
    """The same scan in DuckDB SQL over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    keys, values = ", ".join(quote(k) for k in known), ", ".join(str(v) for v in known.values())
    marked = "sentence_ids"
    for name, pattern in rule_patterns():
        marked = f"replace({marked}, {quote(pattern)}, {quote('{' + name + '}')})"
    text = f"translate(coalesce(text, ''), '{_UPPER}' || chr(12), '{_FOLD_TO}')"
    for pattern, replacement in MARKING:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return f"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all('<' || trim({text}) || '>', {quote(sentence_pattern())}, 0) AS matches FROM documents
), found AS (
  SELECT doc_id, list_transform(matches, lambda m: map([{keys}], [{values}])[regexp_replace(translate(m, '<', ' '), '^ |>', '', 'g')]) AS ids FROM pieces
), joined AS (
  SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences,
    CASE WHEN len(ids) > 0 THEN '<' || array_to_string(ids, '><') || '>' ELSE '' END AS sentence_ids FROM found
), named AS (
  SELECT doc_id, n_sentences, sentence_ids, regexp_extract_all({marked}, '\\{{([^}}]*)\\}}', 1) AS names FROM joined
)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(names, ',') AS licenses, CAST(len(names) AS BIGINT) AS n_licenses FROM named
"""
