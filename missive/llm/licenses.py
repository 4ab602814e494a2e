"""License scans by sentence rules (operator 2), native.

Texts are cut at the ends of lines and sentences and normalised; a known licence sentence, wrapped over lines or not, has
an identifier, and other text between two of them, but for copyright lines, is a break. The identifiers and breaks of a
document, in order, are matched against licence rules, longer and more specific ones first; a rule takes up the
identifiers that it matches, which must follow each other without a break. The method is that of German, Manabe and Inoue, "A sentence-matching method for automatic license
identification of source code files" (2010).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Normalised sentences of public licences, each under its identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "gpl3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"),
    "ccbync4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "spdx license identifier cc by nc 4 0"),
    "ccby4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "spdx license identifier cc by 4 0"),
    "ccbysa4": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "spdx license identifier cc by sa 4 0"),
    "mit": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"),
    "mit_name": ("the mit license", "mit license", "the mit license mit"),
    "apache2": ("licensed under the apache license version 2 0", "released under the apache license version 2 0", "spdx license identifier apache 2 0"),
    "apache2_short": ("licensed under the apache license version 2 0 the license",),
    "apache2_comply": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "permission": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",),
    "notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied",),
    "bsd_redistribution": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd3": ("licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "gpl_or_later": ("either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "mpl2": ("this source code form is subject to the terms of the mozilla public license v 2 0", "spdx license identifier mpl 2 0"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "all_rights": ("all rights reserved",),
}
# Ordered rules, each a licence and the identifiers that must follow each other.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_name", "permission", "notice", "as_is")),
    ("MIT", ("permission", "notice", "as_is")),
    ("Apache-2.0", ("apache2_short", "apache2_comply", "apache2_copy")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2",)),
    ("Apache-2.0", ("apache2_short",)),
    ("GPL-3.0-or-later", ("gpl_or_later",)),
    ("GPL-3.0-only", ("gpl3",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("MPL-2.0", ("mpl2",)),
    ("MIT", ("mit",)),
    ("Unlicense", ("unlicense",)),
)
# What the SQL, which reads line by line, has no sentences and rules for. A "*" stands for up to 20 words.
_GNU = "{what}you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
_FREE = ("this program is free software ", "this library is free software ", "this file is free software ", "* is free software ", "")
WRAPPED: dict[str, tuple[str, ...]] = {
    "permission": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "notice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "apache2_copy": ("you may obtain a copy of the license at https www apache org licenses license 2 0",),
    "bsd_name": tuple(
        f"{who} {may} be used to endorse or promote products derived from this software without specific prior written permission"
        for who in ("neither the name of * nor the names of its contributors", "neither the name of * nor the names of other contributors", "neither the name of * nor the names of their contributors", "neither the names of * nor the names of its contributors", "neither the names of * nor the names of their contributors", "the name of * may not", "the names of * may not")
        for may in (("may",) if who.startswith("neither") else ("",))
    ),
    "bsd_advertising": tuple("all advertising materials mentioning features or use of this software must display the following acknowledgement" + x for x in ("", " *")),
    "gpl_or_later": tuple(_GNU.format(what=what, name="general public license", version=3) for what in _FREE),
    "gpl2_or_later": tuple(_GNU.format(what=what, name="general public license", version=2) for what in _FREE),
    "lgpl2_or_later": tuple(_GNU.format(what=what, name="library general public license", version=2) for what in _FREE),
    "lgpl21_or_later": tuple(_GNU.format(what=what, name="lesser general public license", version="2 1") for what in _FREE),
    "lgpl3_or_later": tuple(_GNU.format(what=what, name="lesser general public license", version=3) for what in _FREE),
    "agpl3_or_later": tuple(_GNU.format(what=what, name="affero general public license", version=3) for what in _FREE),
    "gpl2": ("licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only")
    + tuple(f"{what}you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation" for what in _FREE),
    "mpl2": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "isc": ("spdx license identifier isc",)
    + tuple(f"permission to use copy modify and {how}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for how in ("or ", "")),
    "cc0": ("licensed under cc0 1 0", "this work is licensed under cc0 1 0", "spdx license identifier cc0 1 0", "to the extent possible under law * has waived all copyright and related or neighboring rights to *", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
}
#: Identifiers of the SPDX list.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Older names of some of them.
SPDX_OLD = {
    "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later",
    "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later",
}
# Further sentences and titles of public licences.
TITLES: dict[str, tuple[str, ...]] = {
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "epl2": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",),
    "gpl2_text": ("gnu general public license version 2 june 1991",),
    "gpl3_text": ("gnu general public license version 3 29 june 2007",),
    "lgpl21_text": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3_text": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3_text": ("gnu affero general public license version 3 19 november 2007",),
    "apache2_text": ("apache license version 2 0 january 2004",),
    "mpl2_text": ("mozilla public license version 2 0",),
    "ccby4_text": ("creative commons attribution 4 0 international public license", "this work is licensed under a creative commons attribution 4 0 international license"),
    "ccbysa4_text": ("creative commons attribution sharealike 4 0 international public license", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "ccbync4_text": ("creative commons attribution noncommercial 4 0 international public license", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0": ("cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
}
TITLE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Zlib", ("zlib",)), ("BSL-1.0", ("boost",)), ("EPL-2.0", ("epl2",)), ("GPL-2.0", ("gpl2_text",)), ("GPL-3.0", ("gpl3_text",)), ("LGPL-2.1", ("lgpl21_text",)),
    ("LGPL-3.0", ("lgpl3_text",)), ("AGPL-3.0", ("agpl3_text",)), ("Apache-2.0", ("apache2_text",)), ("MPL-2.0", ("mpl2_text",)), ("CC-BY-4.0", ("ccby4_text",)),
    ("CC-BY-SA-4.0", ("ccbysa4_text",)), ("CC-BY-NC-4.0", ("ccbync4_text",)),
)


def _plain(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _spdx() -> dict[str, str]:
    """Sentences of SPDX lines and the licence that each names. Where an old name reads like a newer one ("GPL-2.0+"), it is
    told apart before texts lose their marks (``sentence_ids``)."""
    named = {_plain(name.replace("+", " or later")): name for name in SPDX}
    return named | {_plain(old.replace("+", " or later")): new for old, new in SPDX_OLD.items() if _plain(old.replace("+", " or later")) not in named}


WRAPPED_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_name")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_name")),
    ("GPL-2.0-or-later", ("gpl2_or_later",)),
    ("LGPL-2.0-or-later", ("lgpl2_or_later",)),
    ("LGPL-2.1-or-later", ("lgpl21_or_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_or_later",)),
    ("AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("ISC", ("isc",)),
    ("CC0-1.0", ("cc0",)),
)
#: The first two are more specific than one of RULES, the others share no identifier with those. Licences that SPDX lines
#: name need no rules of their own.
ALL_RULES = WRAPPED_RULES[:2] + RULES + WRAPPED_RULES[2:] + TITLE_RULES
#: A sentence that goes on in the licensor's own words, which are no break.
OPEN = "bsd_advertising"
#: What an identifier of an SPDX line begins with.
NAMED = "spdx:"
#: Every known sentence holds one of these, whatever its case; other texts (lines in the SQL) need not be cut.
HINT = r"(?i)licen[cs]e|permission|redistribut|warranty|copyright|public domain|rights reserved|compliance|cc0"
#: Text between known sentences that is a break: a word of two letters, copyright lines left out.
BREAK, NEUTRAL = "[a-z]{2}", "(?<=~ )(?:copyright|c) [^~]*"
#: Ends of sentences inside a line, and the same for Spark: a run of marks is tried once, at its first mark.
ENDS = r"[.!?;]+[ \t]+"
ENDS_ONCE = r"(?<![.!?;])[.!?;]++[ \t]+"


#: Marks of comments in letters, and those of lists, at the beginning of a line.
LEADS = r"(?m)^[^a-z0-9\n]*+(?:(?:rem|dnl)\b[^a-z0-9\n]*+)?(?:(?:[0-9]{1,2}|[a-z])\)[ \t]++)?"


def _known() -> dict[str, str]:
    forms = {" ".join(form.split()): name for table in (SENTENCES, WRAPPED, TITLES) for name, forms in table.items() for form in forms}
    return {f"spdx license identifier {named}": NAMED + name for named, name in _spdx().items()} | forms


def _forms() -> list[tuple[str, str]]:
    """Regular expressions of all known sentences and their identifiers, longer ones first."""
    forms = _known()
    words = {"*": "[a-z0-9]++(?:(?: ~)? [a-z0-9]++){0,19}?"}
    ordered = sorted(forms, key=lambda form: (-len(form.split()), form))
    return [("(?: ~)? ".join(words.get(w, w) for w in form.split()), forms[form]) for form in ordered]


#: The alternatives of an SPDX expression: each is read as a line of its own.
SPDX_LINE = r"(?m)(spdx-license-identifier:)[ \t]*\(?([a-z0-9.+-]++)[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]++)\)?"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, with "?" for each break before one.

    A "~" stands for every end of a line and every mark that may end a sentence (as in "v. 2.0"). A known sentence begins
    and ends at one and may have others inside; of those that begin at one place the longest counts.
    """
    forms = _forms()
    pattern = "(?<=~ )(?:" + "|".join(form for form, _ in forms) + ")(?= ~)"
    lowered = F.regexp_replace(F.translate(F.lower(text), "~", " "), "\r\n?", "\n")
    lowered = F.regexp_replace(lowered, SPDX_LINE, "$1 $2\n$1 $3")
    lowered = F.regexp_replace(lowered, r"(spdx-license-identifier:[ \t]*\(?[a-z0-9.-]+)\+", "$1-or-later")
    marked = F.regexp_replace(lowered, LEADS, "")
    marked = F.regexp_replace(F.regexp_replace(marked, ENDS_ONCE, "~"), "\n", "~")
    plain = F.regexp_replace(F.concat(F.lit("~"), marked, F.lit("~")), "[^a-z0-9~]+", " ")
    plain = F.regexp_replace(plain, " ?~[ ~]*+", " ~ ")
    found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(plain, pattern), lambda x: F.regexp_replace(x, NEUTRAL, "").rlike(BREAK))

    def identifier(sentence: Column) -> Column:
        words = F.replace(sentence, F.lit(" ~"), F.lit(""))
        exact = F.create_map(*[F.lit(x) for form, name in _known().items() if "*" not in form for x in (form, name)])
        open_forms = [F.when(words.rlike(f"^{form}$"), F.lit(name)) for form, name in forms if "a-z" in form]
        return F.coalesce(F.try_element_at(exact, words), *open_forms)

    # there is one piece more than there are sentences; both arrays are made once
    marked_id = lambda x, broken: F.when(x.isNotNull(), F.when(broken, F.array(F.lit("?"), identifier(x))).otherwise(F.array(identifier(x))))
    each = F.flatten(F.filter(F.zip_with(found, between, marked_id), lambda x: x.isNotNull()))
    return F.when(text.rlike(HINT), each)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, n_rules, licenses of each row of ``docs`` (doc_id, text).

    ``licenses`` names each licence whose rule matches, in the order of the rules, then those that SPDX lines name, in the
    order of the text, comma-joined, each once. A null, empty or plain text has no sentences and no licences ("" and 0).
    Repeated rows give repeated rows, other columns are left out; an empty table gives no rows. Time is linear in a text's
    length.
    """
    marked = F.coalesce(sentence_ids(F.col("text").cast("string")), F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long"), marked.alias("marked"))
    rest = F.concat(F.lit(" "), F.array_join("marked", "  "), F.lit(" "))
    rest = F.replace(rest, F.lit(f" {OPEN}  ? "), F.lit(f" {OPEN} "))
    rows = rows.withColumn("ids", F.filter("marked", lambda x: x != "?")).withColumn("rest0", rest)
    found = []
    for n, (license_id, sequence) in enumerate(ALL_RULES):
        wanted = " " + "  ".join(sequence) + " "
        after = F.replace(F.col(f"rest{n}"), F.lit(wanted), F.lit(" | "))
        rows = rows.withColumn(f"rest{n + 1}", after)
        found.append(F.when(F.col(f"rest{n}").contains(wanted), F.lit(license_id)))
    named = F.transform(F.filter("ids", lambda x: x.startswith(NAMED)), lambda x: F.substring(x, len(NAMED) + 1, 99))
    hits = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.array_distinct(named))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size(hits).cast("long").alias("n_rules"),
        F.array_join(F.array_distinct(hits), ",").alias("licenses"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The scan line by line for DuckDB: the same rows where no licence sentence is wrapped or only in WRAPPED."""
    known = ", ".join(f"'{form}': '{name}'" for name, forms in SENTENCES.items() for form in forms)
    steps, rest = [], "rest0"
    for n, (_, sequence) in enumerate(RULES):
        wanted = " " + "  ".join(sequence) + " "
        steps.append(f"r{n + 1} AS (SELECT *, replace(rest{n}, '{wanted}', ' | ') AS rest{n + 1}, contains(rest{n}, '{wanted}') AS hit{n} FROM r{n})")
    hits = ", ".join(f"CASE WHEN hit{n} THEN '{name}' END" for n, (name, _) in enumerate(RULES))
    word = "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known AS (SELECT MAP {{{known}}} AS m),
s AS (
  SELECT doc_id, CASE WHEN regexp_matches(text, '{HINT}') THEN [{word} for x in flatten([regexp_split_to_array(line, '{ENDS}')
           for line in regexp_split_to_array(text, '[\r\n]+')])] ELSE [] END AS sentences
  FROM documents),
t AS (
  SELECT doc_id, [coalesce(m[x], CASE WHEN regexp_matches(x, '{BREAK}') AND NOT regexp_matches(x, '^(copyright|c) ') THEN '?' END) for x in sentences] AS marked FROM s, known),
r0 AS (
  SELECT doc_id, [x for x in marked if x <> '?'] AS ids, ' ' || array_to_string([x for x in marked if x IS NOT NULL], '  ') || ' ' AS rest0 FROM t),
{", ".join(steps)},
f AS (SELECT doc_id, ids, [x for x in [{hits}] if x IS NOT NULL] AS hits FROM r{len(RULES)})
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, len(hits)::BIGINT AS n_rules,
       array_to_string([x for x, i in hits if list_position(hits, x) = i], ',') AS licenses FROM f
"""
