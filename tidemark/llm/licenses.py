"""License scans by sentence rules.

A text is normalised, with marks where sentences end or may end, and known sentences in it, which may run over
lines, colons and comment marks, become identifiers. The sequence of a text's identifiers is then read from left to
right against ordered rules, the first (longest) that fits naming a licence and consuming its sentences. Identifiers no
rule takes are reported as unmatched, and sentences that speak of licences but are not known as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences (after normalising; ``*`` stands for any text within the sentence, one in front for
#: any beginning) and their identifiers; earlier ones win. The wording is that of the public licences.
SENTENCES = [
    ("licensed under the apache license version 2.0 (the license)", "apache2_under_the"),
    ("licensed under the apache license version 2.0*", "apache2_under"),
    ("licensed under the apache license version *", "apache_under"),
    ("you may not use this file except in compliance with the license", "apache_comply"),
    ("you may obtain a copy of the license at *", "apache_obtain"),
    ("unless required by applicable law or agreed to in writing*", "apache_as_is"),
    ("see the license for the specific language governing permissions and*", "apache_see"),
    ("released under the mit license", "mit_under"),
    ("licensed under the mit license", "mit_under"),
    ("permission is hereby granted free of charge to any person obtaining a copy*", "mit_grant"),
    ("the above copyright notice and this permission notice shall be included*", "mit_notice"),
    ("the software is provided as is without warranty of any kind*", "mit_as_is"),
    ("in no event shall the authors or copyright holders be liable*", "mit_liable"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted*", "isc_grant"),
    ("the software is provided as is and the author disclaims all warranties*", "isc_as_is"),
    ("in no event shall the author be liable*", "isc_liable"),
    ("*licensed under the gnu general public license version 3", "gpl3_under"),
    ("*licensed under the gnu general public license version 2", "gpl2_under"),
    ("*licensed under the gnu general public license*", "gpl_under"),
    ("this program is free software*gnu affero general public license*version 3 of the license or at your option any later version*", "agpl3_later_free"),
    ("this program is free software*gnu affero general public license*", "agpl_free"),
    ("this program is free software*gnu general public license*version 3 of the license or at your option any later version*", "gpl3_later_free"),
    ("this program is free software*gnu general public license*version 2 of the license or at your option any later version*", "gpl2_later_free"),
    ("this program is free software*gnu general public license version 3*", "gpl3_free"),
    ("this program is free software*gnu general public license version 2*", "gpl2_free"),
    ("this program is free software*gnu general public license*", "gpl_free"),
    ("this library is free software*gnu lesser general public license*version 3 of the license or at your option any later version*", "lgpl3_later_free"),
    ("this library is free software*gnu lesser general public license*version 2.1 of the license or at your option any later version*", "lgpl21_later_free"),
    ("this library is free software*gnu lesser general public license*", "lgpl_free"),
    ("this program is distributed in the hope that it will be useful*", "gpl_hope"),
    ("this library is distributed in the hope that it will be useful*", "lgpl_hope"),
    ("see the gnu general public license for more details", "gpl_see"),
    ("see the gnu affero general public license for more details", "agpl_see"),
    ("see the gnu lesser general public license for more details", "lgpl_see"),
    ("you should have received a copy of the gnu general public license*", "gpl_copy"),
    ("you should have received a copy of the gnu affero general public license*", "agpl_copy"),
    ("you should have received a copy of the gnu lesser general public license*", "lgpl_copy"),
    ("redistribution and use in source and binary forms*are permitted*", "bsd_redistribute"),
    ("redistributions of source code must retain the above copyright notice*", "bsd_source"),
    ("redistributions in binary form must reproduce the above copyright notice*", "bsd_binary"),
    ("neither the name of *", "bsd_endorse"),
    ("this software is provided by *as is*", "bsd_as_is"),
    ("this source code form is subject to the terms of the mozilla public license version 2.0", "mpl2_subject"),
    ("this source code form is subject to the terms of the mozilla public license*", "mpl_subject"),
    ("if a copy of the mpl was not distributed with this file*", "mpl_obtain"),
    ("this is free and unencumbered software released into the public domain", "unlicense_free"),
    ("all rights reserved", "all_rights"),
]
#: Ordered rules, longer before shorter; each names a licence for a run of identifiers.
RULES = [
    ("Apache-2.0", ["apache2_under_the", "apache_comply", "apache_obtain", "apache_as_is", "apache_see"]),
    ("Apache-2.0", ["apache2_under_the", "apache_comply", "apache_obtain", "apache_as_is"]),
    ("Apache-2.0", ["apache2_under", "apache_comply", "apache_obtain", "apache_as_is"]),
    ("BSD-3-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is"]),
    ("BSD-2-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_as_is"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is", "mit_liable"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is"]),
    ("ISC", ["isc_grant", "isc_as_is", "isc_liable"]),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("AGPL-3.0-or-later", ["agpl3_later_free", "gpl_hope", "agpl_see", "agpl_copy"]),
    ("GPL-3.0-or-later", ["gpl3_later_free", "gpl_hope", "gpl_see", "gpl_copy"]),
    ("GPL-2.0-or-later", ["gpl2_later_free", "gpl_hope", "gpl_see", "gpl_copy"]),
    ("GPL-3.0-only", ["gpl3_free", "gpl_hope", "gpl_see", "gpl_copy"]),
    ("GPL-2.0-only", ["gpl2_free", "gpl_hope", "gpl_see", "gpl_copy"]),
    ("LGPL-3.0-or-later", ["lgpl3_later_free", "lgpl_hope", "lgpl_see", "lgpl_copy"]),
    ("LGPL-2.1-or-later", ["lgpl21_later_free", "lgpl_hope", "lgpl_see", "lgpl_copy"]),
    ("GPL", ["gpl_free", "gpl_hope", "gpl_copy"]),
    ("MPL-2.0", ["mpl2_subject", "mpl_obtain"]),
    ("Apache-2.0", ["apache2_under_the"]),
    ("Apache-2.0", ["apache2_under"]),
    ("Apache", ["apache_under"]),
    ("MIT", ["mit_under"]),
    ("MIT", ["mit_grant"]),
    ("ISC", ["isc_grant"]),
    ("AGPL-3.0-or-later", ["agpl3_later_free"]),
    ("AGPL", ["agpl_free"]),
    ("GPL-3.0-only", ["gpl3_under"]),
    ("GPL-2.0-only", ["gpl2_under"]),
    ("GPL", ["gpl_under"]),
    ("GPL-3.0-or-later", ["gpl3_later_free"]),
    ("GPL-2.0-or-later", ["gpl2_later_free"]),
    ("GPL-3.0-only", ["gpl3_free"]),
    ("GPL-2.0-only", ["gpl2_free"]),
    ("GPL", ["gpl_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_later_free"]),
    ("LGPL-2.1-or-later", ["lgpl21_later_free"]),
    ("LGPL", ["lgpl_free"]),
    ("MPL-2.0", ["mpl2_subject"]),
    ("MPL", ["mpl_subject"]),
    ("Unlicense", ["unlicense_free"]),
    ("Proprietary", ["all_rights"]),
]
#: Identifiers that a tag line may name.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
SENTENCES += [(f"spdx license identifier {name.lower().replace('-', ' ')}", f"spdx_{name}") for name in SPDX] + [("spdx license identifier *", "spdx")]
RULES += [(name, [f"spdx_{name}"]) for name in SPDX] + [("SPDX", ["spdx"])]
#: Creative Commons licences, most conditions first, with and without a version.
for _kind in ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-SA", "BY-ND", "BY"):
    for _version in ("4.0", "3.0", "2.5", "2.0", ""):
        _name = "-".join(filter(None, ("CC", _kind, _version)))
        SENTENCES.append((f"*licensed under*{_name.lower().replace('-', ' ')}*", f"cc_{_name}"))
        RULES.append((_name, [f"cc_{_name}"]))
#: A text with a known sentence holds one of these stems; others are not normalised at all.
HINT = "licen[cs]|spdx|the mpl|permi(t|ssion)|warrant|redistribut|copyright|as is|rights reserved|cc by|cc-by|creative commons|neither the name|free software|useful|applicable law|public domain|liable".replace(" ", r"\W+")
#: A sentence that speaks of licences, known or not.
ABOUT = r"\b(licen[cs]|copyright|warrant|redistribut|rights reserved|permission is|spdx)"
#: Comment and list marks at the start of a line.
MARKS = r"(?m)^[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+|>+|(?:REM|dnl)\b|[-•]|\(?[0-9a-zA-Z]{1,2}[.)])[ \t]+|(?://+|/?\*+/?|#+|;+|--+|%+|>+)[ \t]*(?=\r?$))*"


def normalised(text: Column) -> Column:
    """Lower case, single spaces, ``|`` where a sentence ends for certain and ``;`` where it may (a line's end, colons).

    Sentences end for certain at a full stop or the like and at an empty line. Quotes and the marks at the start of
    lines go; all other marks become spaces.
    """
    s = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    s = F.regexp_replace(s, MARKS, "")
    s = F.regexp_replace(s, r"[\"'`*#|]+", "")
    s = F.regexp_replace(s, r"\bv(?:er(?:sion)?)?\.?\s*(?=\d)", "version ")
    s = F.regexp_replace(s, r"[.!?]+(?=\s|$)|\n\s*\n", " | ")
    s = F.regexp_replace(s, r"[:;](?=\s|$)|\n", " ; ")
    s = F.regexp_replace(s, r"[^a-z0-9.|;]+", " ")
    s = F.regexp_replace(s, r"\bcreative[ ;]+commons[ ;]+attribution\b", "cc by")
    for word, short in (("non ?commercial", "nc"), ("no ?deriv(?:ative)?s", "nd"), ("share[ ;]*alike", "sa")):
        s = F.regexp_replace(s, rf"\b(cc by(?: nc| nd)*)[ ;]+{word}\b", f"$1 {short}")
    # only sentences with a stem can be known ones, and no known one runs over a certain end
    return F.concat(F.lit("| "), F.array_join(F.filter(F.split(s, r" *\| *"), lambda x: x.rlike(HINT)), " | "), F.lit(" |"))


def _pattern(known: str) -> str:
    """A known sentence within a normalised text: it starts and ends where a sentence may, and possible ends within it don't count."""
    parts = [r"[ ;]+".join("".join(c if c.isalnum() or c == "." else " " for c in part).split()).replace(".", r"\.") for part in known.split("*")]
    body = r"\b[^|@]*?\b".join(p for p in parts if p)
    start = r"(?<=[|;] )" + (r"(?:[^|;@]*? )?" if known.startswith("*") else "")
    return start + body + (r"\b" if known.endswith("*") else r"(?= ?[|;])")


def marked(text: Column) -> Column:
    """A normalised text with ``@`` and the number of each known sentence in its place; earlier entries win."""
    s = normalised(text)
    return F.transform(F.array(s), _replaced)[0]


def _replaced(s: Column) -> Column:
    for i, (known, _) in enumerate(SENTENCES):
        s = F.regexp_replace(s, _pattern(known), f"@{i} ")
    return s


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every whole text: ``doc_id, sentence_ids, licenses, unmatched, unknown`` (arrays in text order).

    ``unknown`` has the normalised sentences that speak of licences and hold no known one. Every input row gives a row.
    Null and empty texts and texts without a known sentence give empty arrays; a licence named twice is listed twice;
    repeated rows and null ids stay; long texts are read whole; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(text.rlike(f"(?i){HINT}"), marked(text)).otherwise("").alias("_s"))
    known = F.array(*[F.lit(name) for _, name in SENTENCES])
    ids = F.transform(F.regexp_extract_all("_s", F.lit(r"@(\d+)"), F.lit(1)), lambda i: F.get(known, i.cast("int")))
    unknown = F.filter(F.transform(F.split("_s", r"\|"), lambda x: F.trim(F.regexp_replace(x, "[ ;]+", " "))), lambda x: ~x.contains("@") & x.rlike(ABOUT))
    rows = rows.select("doc_id", ids.alias("sentence_ids"), unknown.alias("unknown"))
    read = F.concat(F.lit(" "), F.array_join(F.col("sentence_ids"), "  "), F.lit(" "))
    for i, (_, rule) in enumerate(RULES):
        read = F.regexp_replace(read, " " + "  ".join(rule).replace(".", r"\.") + " ", f" ={i} ")
    rows = rows.withColumn("_read", F.when(F.size("sentence_ids") > 0, read).otherwise(""))
    marks = F.filter(F.split(F.trim(F.col("_read")), " +"), lambda x: x != "")
    names = F.array(*[F.lit(name) for name, _ in RULES])
    found = F.transform(F.filter(marks, lambda x: x.startswith("=")), lambda x: F.get(names, F.substring(x, 2, 9).cast("int")))
    return rows.select("doc_id", "sentence_ids", found.alias("licenses"), F.filter(marks, lambda x: ~x.startswith("=")).alias("unmatched"), "unknown")
