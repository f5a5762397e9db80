"""Licence scans by sentence rules (DataFrame functions only): sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Normalised sentences of well-known public licences, and the identifier of each.
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheRef",
    "licensed under the apache license version 2.0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this work is licensed under the gnu general public license version 3": "GPL3Ref",
    "this work is licensed under the gnu general public license version 2": "GPL2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "licensed under cc by nc 4.0": "CCBYNC4Ref",
    "licensed under cc by 4.0": "CCBY4Ref",
    "licensed under cc by sa 4.0": "CCBYSA4Ref",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL2Ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
}
# Licences and the sequence of identifiers that gives each, tried in this order; a rule uses up what it matches.
RULES = [
    ("MIT", "<MITGrant><MITNotice><MITWarranty><MITLiability>"),
    ("BSD-3-Clause", "<BSDGrant><BSDSource><BSDBinary><BSDEndorse>"),
    ("BSD-2-Clause", "<BSDGrant><BSDSource><BSDBinary>"),
    ("Apache-2.0", "<ApacheRef><ApacheUse><ApacheCopy>(<ApacheBasis>)?(<ApacheSee>)?"),
    ("GPL-3.0-or-later", "<GPL3Grant><GPLWarranty>(<GPLSee>)?(<GPLCopy>)?"),
    ("GPL-2.0-or-later", "<GPL2Grant><GPLWarranty>(<GPLSee>)?(<GPLCopy>)?"),
    ("Apache-2.0", "<ApacheRef>"),
    ("MIT", "<MITRef>|<MITGrant><MITNotice>"),
    ("GPL-3.0", "<GPL3Ref>|<GPL3Grant>"),
    ("GPL-2.0", "<GPL2Ref>|<GPL2Grant>"),
    ("CC-BY-NC-4.0", "<CCBYNC4Ref>"),
    ("CC-BY-4.0", "<CCBY4Ref>"),
    ("CC-BY-SA-4.0", "<CCBYSA4Ref>"),
    ("MPL-2.0", "<MPL2Ref>"),
    ("Unlicense", "<UnlicenseGrant>"),
]


def _prepared(text):
    """Lower-cased text of words and single spaces, with ``\\n`` at line ends and semicolons and ``\\x01`` where sentences and paragraphs end."""
    steps = [
        (r"[\r\x01]", " "),
        (r"(^|\n)[^a-z0-9\n]+", "$1"),  # comment marks and bullets
        (r"(^|\n)[0-9]{1,2}\)[^a-z0-9\n]+", "$1"),
        (r"\bv\.\s+(?=[0-9])", "v "),
        (r"(?<![.!?;]);++\s", "\n"),
        (r"(?<![.!?;])[.!?;]++\s", "\x01"),
        (r"[.]{2,}", " "),
        (r"[^a-z0-9.\n\x01]+", " "),
        (r"(?<![ .])[ .]*+\n[ .]*+", "\n"),
        (r"\n{2,}", "\x01"),
        (r"(?<![ .\n])[ .\n]*+\x01[ .\n\x01]*+", "\x01"),
        (r"^[ .]+|(?<![ .])[ .]+$", ""),
    ]
    text = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


#: A known sentence from a line's or sentence's start to such an end; its words may be wrapped at any place.
_KNOWN = r"(?<![^\n\x01])(?:" + "|".join(k.replace(".", r"\.").replace(" ", r"[ \n]") for k in SENTENCES) + r")(?![^\n\x01])"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_sentences, n_known, sequence, licenses, unmatched``.

    Sentences end at ``.``, ``!``, ``?`` or ``;`` before white space, and at line ends. A sentence is lower-cased, all but letters
    a-z, digits and full stops become single spaces, outer spaces and full stops go; ``n_sentences`` counts what is left.

    A known sentence is found whole in such a sentence, or over several successive ones: wrapped at line ends, with comment marks or a
    list number before its lines, or with semicolons in it; not across a full stop or an empty line. Known sentences give their
    identifiers in text order (``sequence``); the rules are tried in order, each using up all its matches; ``licenses`` lists the
    rules that matched, in rule order, each licence once; ``unmatched`` holds identifiers that no rule used.

    Null or empty text: no sentences and empty strings. Equal rows give equal results. No shuffle: a map over the table, in
    the JVM. Other columns play no part.
    """
    lines = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[.!?;]+\s", "\n"), "\n")
    plain = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, "[^a-z0-9.]+", " "), r"^[ .]+|[ .]+$", ""))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    out = docs.select(F.col(id_col).alias("doc_id"), F.size(F.filter(plain, lambda s: s != "")).alias("n_sentences"), F.transform(F.regexp_extract_all(_prepared(F.col(text_col)), F.lit(_KNOWN), F.lit(0)), lambda s: F.translate(s, "\n", " ")).alias("_k"))
    out = out.select("doc_id", "n_sentences", F.size("_k").alias("n_known"), F.array_join(F.transform("_k", lambda s: F.concat(F.lit("<"), F.element_at(known, s), F.lit(">"))), "").alias("sequence"))
    left, found = F.col("sequence"), []
    for name, rule in RULES:
        found.append(F.when(F.regexp_like(left, F.lit(rule)), F.lit(name)))
        left = F.regexp_replace(left, rule, "")
    scanned = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",")
    has = F.col("n_known") > 0
    return out.select("doc_id", "n_sentences", "n_known", "sequence", F.when(has, scanned).otherwise("").alias("licenses"), F.when(has, left).otherwise("").alias("unmatched"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quoted = "MAP {" + ", ".join(f"'{k}': '<{v}>'" for k, v in SENTENCES.items()) + "}"
    steps, left = [], "k0"
    for i, (name, rule) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT *, CASE WHEN regexp_matches({left}, '{rule}') THEN '{name}' END AS f{i}, regexp_replace({left}, '{rule}', '', 'g') AS k{i + 1} FROM {'q' if not i else f'r{i - 1}'})")
        left = f"k{i + 1}"
    found = "[" + ", ".join(f"f{i}" for i in range(len(RULES))) + "]"
    return rf"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[.!?;]+\s', chr(10), 'g'), chr(10)),
    lambda x: regexp_replace(regexp_replace(x, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')), lambda x: x <> '') AS s FROM documents
),
k AS (SELECT doc_id, len(s)::INT AS n_sentences, list_filter(list_transform(s, lambda x: element_at({quoted}, x)[1]), lambda x: x IS NOT NULL) AS k FROM s),
q AS (SELECT doc_id, n_sentences, len(k)::INT AS n_known, coalesce(array_to_string(k, ''), '') AS sequence, coalesce(array_to_string(k, ''), '') AS k0 FROM k),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, sequence,
  coalesce(array_to_string(list_transform(list_filter(list_zip({found}, range(1, {len(RULES) + 1})), lambda z: z[1] IS NOT NULL AND list_position({found}, z[1]) = z[2]), lambda z: z[1]), ','), '') AS licenses,
  {left} AS unmatched FROM r{len(RULES) - 1}
"""


ORACLE = _oracle()
