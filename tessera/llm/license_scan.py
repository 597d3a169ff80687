"""Licence recognition by sentences.

A text is cut into fragments at line ends and sentence ends; runs of normalised fragments
(sentences wrapped over any number of lines) that make up a known licence sentence are
found; the identifiers found, in text order, are matched against ordered rules, each a
sequence of identifiers. A rule takes the identifiers it matches, so later, shorter rules
name only what is left.

A fragment has a word or more, so a run that makes up a sentence of n words has at most n
fragments: there is no other limit to a wrap.

Everything is one projection over a row (no shuffle, no user functions). Texts without
any trigger word, one of which every known sentence has, skip the work.

Defined results: null, empty and unlicensed texts give no identifiers and no licences;
every row gets a result, repeated rows the same one; only the id and text columns are
read; a sentence twice in a text is two identifiers; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: known sentences by identifier (fixed values: the licences' own wording, normalised)
SENTENCES = {
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache2": "spdx license identifier apache 2 0",
    "spdx_gpl2": "spdx license identifier gpl 2 0 only",
    "spdx_gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "mit_name": "released under the mit license",
    "mit_name2": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_name": "licensed under the apache license version 2 0",
    "apache_notice": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_name": "this work is licensed under the gnu general public license version 3",
    "gpl2_name": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_nowarranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2_name": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}

#: SPDX identifiers and expressions known beside those above (fixed values: the list's own names)
SPDX = ("GPL-2.0-or-later", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "BSD-2-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
        "MIT OR Apache-2.0", "Apache-2.0 OR MIT")


def _spdx(name: str) -> tuple[str, str]:
    """(identifier, normalised sentence) of a line that names a licence or an expression."""
    norm = re.sub("[^a-z0-9]+", " ", name.lower())
    return "spdx_" + norm.replace(" ", "_"), "spdx license identifier " + norm


SENTENCES |= dict(map(_spdx, SPDX))

#: ordered rules: the first that matches takes its identifiers
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("Apache-2.0", ("apache_notice", "apache_comply", "apache_copy", "apache_basis", "apache_see")),
    ("Apache-2.0", ("apache_notice", "apache_comply")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_terms")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_terms")),
    ("LGPL-2.1-or-later", ("lgpl21_terms",)), ("LGPL-3.0-or-later", ("lgpl3_terms",)), ("AGPL-3.0-or-later", ("agpl3_terms",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant",)),
    ("MPL-2.0", ("mpl2_name",)),
    ("GPL-3.0", ("gpl3_name",)), ("GPL-2.0", ("gpl2_name",)),
    ("Apache-2.0", ("apache_name",)), ("Apache-2.0", ("apache_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)), ("CC-BY-SA-4.0", ("cc_by_sa4",)), ("CC-BY-4.0", ("cc_by4",)),
    ("MIT", ("mit_name",)), ("MIT", ("mit_name2",)), ("MIT", ("mit_grant",)),
    ("MIT", ("spdx_mit",)), ("Apache-2.0", ("spdx_apache2",)), ("GPL-2.0", ("spdx_gpl2",)),
    ("GPL-3.0-or-later", ("spdx_gpl3",)), ("BSD-3-Clause", ("spdx_bsd3",)),
    *((name, (_spdx(name)[0],)) for name in SPDX),
)

#: every known sentence has one of these
TRIGGER = "licens|warrant|permission|redistribut|free software"
_SPLIT, _NORMAL = r"([.!?;:])[ \t]+", "[^a-z0-9]+"
#: a wrap may stand between the words of a trigger
_TRIGGER = TRIGGER.replace(" ", _NORMAL)
_FIRST = sorted({s.split()[0] for s in SENTENCES.values()})


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), _NORMAL, " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array), fragment_at (array: where each begins), licences (array,
    in rule order, repeats kept)."""
    t = text_or_empty(F.col(text_col))
    has = F.lower(t).rlike(_TRIGGER)
    d = docs.select(F.col(id_col).alias("doc_id"), F.when(has, F.transform(
        F.split(F.regexp_replace(t, _SPLIT, "$1\n"), "\n"), _normal)).alias("f"))
    d = d.withColumn("f", F.filter("f", lambda x: x != ""))
    # of two sentences that begin at one fragment, the shorter comes first
    known = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("norm"), F.lit(len(v.split())).alias("words"))
                      for k, v in sorted(SENTENCES.items(), key=lambda kv: len(kv[1]))])

    def here(i: Column, x: Column, s: Column) -> Column:
        """The sentence s is made up by the run that begins with x, the fragment i."""
        run = F.array_join(F.slice("f", i + 1, s["words"]), "\n")
        return (F.startswith(s["norm"], x) & F.startswith(F.translate(run, "\n", " "), s["norm"])
                & (F.substring(F.concat(run, F.lit("\n")), F.length(s["norm"]) + 1, F.lit(1)) == "\n"))

    runs = F.flatten(F.transform("f", lambda x, i: F.when(
        F.substring_index(x, " ", 1).isin(_FIRST),
        F.transform(F.filter(known, lambda s: here(i, x, s)), lambda s: F.struct(i.alias("at"), s["id"].alias("id"))),
    ).otherwise(F.array().cast("array<struct<at:int,id:string>>"))))
    d = d.withColumn("m", runs)
    d = d.withColumn("sentence_ids", F.coalesce(F.transform("m", lambda x: x["id"]), F.array().cast("array<string>")))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(ids) + ",").alias("ids")) for name, ids in RULES])
    # each identifier stands between two commas of its own, so that neighbours do not share one
    start = F.struct(F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(",")).alias("s"),
                     F.array().cast("array<string>").alias("got"))
    step = lambda a, r: F.when(
        F.contains(a["s"], r["ids"]),
        F.struct(F.replace(a["s"], r["ids"], F.lit(",,")).alias("s"), F.concat(a["got"], F.array(r["name"])).alias("got"))).otherwise(a)
    lic = F.aggregate(rules, start, step, lambda a: a["got"])
    return d.select("doc_id", "sentence_ids", F.coalesce(F.transform("m", lambda x: x["at"]), F.array().cast("array<int>")).alias("fragment_at"),
                    F.when(F.size("sentence_ids") > 0, lic).otherwise(F.array().cast("array<string>")).alias("licences"))


def oracle() -> str:
    """DuckDB SQL of the query's rows."""
    known = ", ".join(f"('{v}', '{k}', {len(v.split())})" for k, v in SENTENCES.items())
    steps = ", ".join(f"r{i} AS (SELECT doc_id, n, ids, CASE WHEN contains(s, ',{','.join(q)},') THEN replace(s, ',{','.join(q)},', ',,') ELSE s END AS s, "
                      f"CASE WHEN contains(s, ',{','.join(q)},') THEN list_append(got, '{name}') ELSE got END AS got FROM r{i - 1})"
                      for i, (name, q) in enumerate(RULES, 1))
    return rf"""
WITH known(norm, id, words) AS (VALUES {known}),
f0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS f FROM documents
  WHERE regexp_matches(lower(text), '{TRIGGER}')),
f1 AS (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM f0),
h AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i, length(norm)) AS ids FROM f1 JOIN known ON starts_with(norm, f[i])
  AND len(list_filter(range(1, words + 1), lambda k: array_to_string(f[i:i + k - 1], ' ') = norm AND i + k - 1 <= len(f))) > 0 GROUP BY doc_id),
r0 AS (SELECT doc_id, n, ids, ',' || ids || ',' AS s, CAST([] AS VARCHAR[]) AS got FROM h), {steps}
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_sentences, coalesce(ids, '') AS sentence_ids,
  coalesce(array_to_string(got, ','), '') AS licences FROM documents d LEFT JOIN r{len(RULES)} r ON d.doc_id = r.doc_id"""
