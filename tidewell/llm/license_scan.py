"""License scans by sentence rules, in DataFrame functions alone.

Known licence sentences are looked for between breaks of the normalised text
(line ends, and stops before a blank), and may have breaks inside, as where
lines are wrapped; the identifiers found, in text order, are matched against
ordered rules.  A rule is a run of identifiers; the first rule whose run occurs
takes those identifiers out of the sequence, so longer, more specific rules
stand before the ones they contain.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names as they are written in grants, by identifier.
NAMES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero license", "CC0-1.0"),
}
# The parts and versions of the Creative Commons licences.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("2.0", "3.0", "4.0")
# Sentences that grant a licence by its name.
GRANTS = (
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "Distributed under the {}",
    "Distributed under the terms of the {}",
    "This work is licensed under {}",
    "This work is licensed under the {}",
    "This work is licensed under a {}",
    "This file is licensed under the {}",
    "This software is licensed under the {}",
    "This program is licensed under the {}",
    "This project is licensed under the {}",
    "SPDX-License-Identifier: {}",
    "License: {}",
)
# Sentences of licence texts, by identifier.
TEXT_SENTENCES = {
    "rights-reserved": "All rights reserved.",
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-text": "This is free and unencumbered software released into the public domain.",
}
# Rules over sentences of licence texts; earlier ones go first.
TEXT_RULES = (
    (("mit-grant", "mit-notice", "mit-as-is", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("isc-grant",), "ISC"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("gpl-free", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl2-free", "gpl-warranty"), "GPL-2.0-or-later"),
    (("agpl-free", "gpl-warranty"), "AGPL-3.0-or-later"),
    (("lgpl-free", "lgpl-warranty"), "LGPL-2.1-or-later"),
    (("lgpl3-free", "lgpl-warranty"), "LGPL-3.0-or-later"),
    (("agpl-free",), "AGPL-3.0-or-later"),
    (("lgpl-free",), "LGPL-2.1-or-later"),
    (("lgpl3-free",), "LGPL-3.0-or-later"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("mpl-terms",), "MPL-2.0"),
    (("unlicense-text",), "Unlicense"),
    (("grant-Apache-2.0", "apache-compliance", "apache-copy", "apache-as-is"), "Apache-2.0"),
    (("grant-Apache-2.0", "apache-compliance"), "Apache-2.0"),
)
LAST_RULES = ((("rights-reserved",), "all-rights-reserved"),)

# Each known sentence holds one of these within a word, so texts and sentences without any need no look-up.
CUES = ("licen", "reserved", "permission", "redistribut", "released", "distributed", "warrant", "endorse", "liable")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"([.!?;:])[ \t\x0B\f\r]+"
_GAP = r"[^\p{L}\p{N}]+"


def normalise(sentence: str) -> str:
    """A-Z lower-cased, other than letters and digits one space: what the DataFrame form gives."""
    import regex

    return regex.sub(_GAP, " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")


def licence_names() -> dict[str, tuple[str, ...]]:
    """Licence identifiers with the names that grants use, Creative Commons included."""
    out = {k: tuple(v) for k, v in NAMES.items()}
    for part, words in CC_PARTS.items():
        for version in CC_VERSIONS:
            out[f"CC-{part}-{version}"] = (f"CC {part} {version}", f"Creative Commons {words} {version} International License", f"Creative Commons {words} {version} License", f"CC-{part}-{version}")
    return out


def sentence_table() -> dict[str, str]:
    """Normalised sentence to sentence identifier."""
    table = {normalise(text): key for key, text in TEXT_SENTENCES.items()}
    for licence, names in licence_names().items():
        for name in names:
            for grant in GRANTS:
                table.setdefault(normalise(grant.format(name)), f"grant-{licence}")
    return table


def known_sentences() -> dict[str, str]:
    """The sentence table, and grants by a name that is then called "the License"."""
    table = sentence_table()
    return {f"{k} the license": v for k, v in table.items() if v.startswith("grant-")} | table


def sentence_pattern() -> str:
    """A pattern of all known sentences, the longest first, one blank or line end between words."""
    tree: dict = {}
    for sentence in known_sentences():
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def below(node: dict) -> str:
        ways = [word + (rest if len(more) == 1 and "" in more else f"[ \\n]{rest}" if "" not in more else f"(?:[ \\n]{rest})?") for word, more in node.items() if word for rest in [below(more)]]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""

    return rf"(?<=\n){below(tree)}(?=\n)"


def rule_list() -> list[tuple[tuple[str, ...], str]]:
    """All rules in order: runs of licence text, then grants by name, then reserved rights."""
    return [*TEXT_RULES, *(((f"grant-{x}",), x) for x in licence_names()), *LAST_RULES]


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _lines(text: Column) -> Column:
    """Words with one blank between them, one line end for a break, and two or more between paragraphs."""
    out = F.concat(F.lit("\n"), F.translate(text, _UPPER + "\r", _LOWER + " "), F.lit("\n"))
    for pattern, new in ((_BREAK, "$1\r"), (r"[^\p{L}\p{N}\n\r]+", " "), (r" ?\r[ \r]*", "\r"), (r"[ \r]?\n[ \r]?", "\n")):
        out = F.regexp_replace(out, pattern, new)
    return F.translate(out, "\r", "\n")


def _has_cue(text: Column) -> Column:
    out = F.lit(False)
    for cue in CUES:
        out = out | F.contains(text, F.lit(cue))
    return out


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_sentences, sentence_ids and licenses to df (columns of these names are replaced).

    n_sentences (long) counts the recognised licence sentences of the whole
    text, sentence_ids joins their identifiers in text order with commas, and
    licenses joins the distinct licences that the ordered rules find.  A null
    or empty text, or one without a licence sentence, has 0 and empty strings.
    Each row is judged alone: repeated rows get the same result, an empty table
    gives an empty one, and a very long text costs time in proportion.
    """
    names = ("n_sentences", "sentence_ids", "licenses")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    known = F.expr(f"map({', '.join(f'{_quoted(k)}, {_quoted(v)}' for k, v in known_sentences().items())})")
    out = df.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    # Documents without a cue, nearly all, stop at a plain substring search; lower() maps A-Z as _lines does.
    out = out.withColumn("_easy", F.lower("_text")).withColumn("_cue", _has_cue(F.col("_easy"))).drop("_easy")
    found = F.regexp_extract_all(_lines(F.col("_text")), F.lit(sentence_pattern()), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    out = out.withColumn("_ids", F.when(F.col("_cue"), ids).otherwise(F.array().cast("array<string>"))).drop("_text", "_cue")
    out = out.withColumn("_run", F.when(F.size("_ids") > 0, F.concat(F.lit(" "), F.array_join("_ids", "  "), F.lit(" "))).otherwise(""))
    rules = F.expr("array(" + ", ".join(f"named_struct('run', {_quoted(''.join(f' {i} ' for i in run))}, 'name', {_quoted(name)})" for run, name in rule_list()) + ")")
    start = F.struct(F.col("_run").alias("run"), F.array().cast("array<string>").alias("found"))
    step = lambda a, r: F.when(
        F.contains(a["run"], r["run"]),
        F.struct(F.replace(a["run"], r["run"], F.lit("|")).alias("run"), F.array_append(a["found"], r["name"]).alias("found")),
    ).otherwise(a)
    found = F.when(F.col("_run") == "", F.lit("")).otherwise(F.aggregate(rules, start, step, lambda a: F.array_join(F.array_distinct(a["found"]), ",")))
    return out.select(*kept, F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), found.alias("licenses"))


def oracle_sql(table: str = "documents", key: str = "doc_id") -> str:
    """The same scan as DuckDB SQL, for known sentences without a break inside and without (the "License")."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sentence_table().items())
    rules = ", ".join(f"({n}, {_quoted(''.join(f' {i} ' for i in run))}, {_quoted(name)})" for n, (run, name) in enumerate(rule_list(), 1))
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(k, run, name) AS (VALUES {rules}),
parts AS (
  SELECT {key}, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos
  FROM (SELECT {key}, string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BREAK}', '\\1' || chr(10), 'g'), chr(10)) AS s FROM {table})),
ids AS (
  SELECT {key}, pos, id FROM parts JOIN known
  ON known.sentence = trim(regexp_replace(parts.sentence, '{_GAP}', ' ', 'g'), ' ')),
runs AS (
  SELECT {key}, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS sentence_ids,
         ' ' || string_agg(id, '  ' ORDER BY pos) || ' ' AS run FROM ids GROUP BY {key}),
steps AS (
  SELECT {key}, 0 AS k, run, CAST([] AS VARCHAR[]) AS found FROM runs
  UNION ALL
  SELECT s.{key}, r.k,
    CASE WHEN contains(s.run, r.run) THEN replace(s.run, r.run, '|') ELSE s.run END,
    CASE WHEN contains(s.run, r.run) AND NOT list_contains(s.found, r.name) THEN list_append(s.found, r.name) ELSE s.found END
  FROM steps s JOIN rules r ON r.k = s.k + 1)
SELECT d.{key}, coalesce(r.n, 0) AS n_sentences, coalesce(r.sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(s.found, ','), '') AS licenses
FROM {table} d LEFT JOIN runs r USING ({key})
LEFT JOIN (SELECT * FROM steps WHERE k = (SELECT max(k) FROM rules)) s USING ({key})"""
