"""License scans: known licence sentences, then ordered rules over the sequence of their identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Known sentences (fixed values: wording of public licences and of common notices), normalised: lower case, one space between words.
SENTENCES: dict[str, str] = {
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is_software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_2": "licensed under the apache license version 2 0",
    "apache_2_the_license": "licensed under the apache license version 2 0 the license",
    "apache_compliance": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl_3": "this work is licensed under the gnu general public license version 3",
    "gpl_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_no_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "lgpl_redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl_2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "cc_by_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_sa_long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc_by_nc_long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "all_rights": "all rights reserved",
    "some_rights": "some rights reserved",
}

#: Rules in order: a licence and the sentences that must occur one after the other (others may lie between). A rule that
#: matches hides the rules named in the third place.
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"), ("BSD-2-Clause",)),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary"), ()),
    ("MIT", ("mit_grant", "mit_notice", "as_is_software"), ("MIT-reference", "Proprietary")),
    ("ISC", ("isc_grant",), ()),
    ("GPL-3.0-or-later", ("gpl_redistribute", "gpl_no_warranty", "gpl_see"), ("GPL-3.0-reference",)),
    ("LGPL-2.1-or-later", ("lgpl_redistribute",), ()),
    ("Apache-2.0", ("apache_2_the_license", "apache_compliance", "apache_copy"), ("Apache-2.0-reference",)),
    ("MPL-2.0", ("mpl_2",), ()),
    ("Unlicense", ("unlicense",), ()),
    ("CC0-1.0", ("cc0",), ()),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",), ()),
    ("CC-BY-NC-4.0", ("cc_by_nc_long",), ()),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",), ()),
    ("CC-BY-SA-4.0", ("cc_by_sa_long",), ()),
    ("CC-BY-4.0", ("cc_by_4",), ()),
    ("CC-BY-4.0", ("cc_by_long",), ()),
    ("MIT-reference", ("mit_released",), ()),
    ("MIT-reference", ("mit_licensed",), ()),
    ("Apache-2.0-reference", ("apache_2",), ()),
    ("Apache-2.0-reference", ("apache_2_the_license",), ()),
    ("GPL-3.0-reference", ("gpl_3",), ()),
    ("Some-rights-reserved", ("some_rights",), ()),
    ("Proprietary", ("all_rights",), ()),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentences: Column) -> Column:
    """Lower-case ASCII words of each sentence, with one space between."""
    return F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))


def sentences_of(text: Column) -> Column:
    """Sentences end at ``.``, ``!``, ``?`` or ``;`` before white space or the end, and at line breaks."""
    return F.split(F.regexp_replace(text, "[.!?;]+([ \t\r\n]|$)", "\n"), "\n")


def identifiers(sentences: Column, known: Mapping[str, str]) -> Column:
    """Identifiers of the known sentences in text order."""
    by_text = {}
    for name, words in known.items():
        if by_text.setdefault(words, name) != name:
            raise ValueError(f"{name} repeats a known sentence")
    table = F.create_map(*[F.lit(x) for kv in by_text.items() for x in kv])
    return F.filter(F.transform(normalised(sentences), lambda s: F.element_at(table, s)), lambda x: x.isNotNull())


def joined_identifiers(text: Column, known: Mapping[str, str]) -> Column:
    """Identifiers of the known sentences that begin and end at a boundary, in text order, whatever boundaries lie between.

    Boundaries are line breaks, the ends of sentences, ``:`` before white space, and list numbers like ``1)`` or ``(a)``. So a sentence is
    found wrapped over lines, under a heading or a copyright line, behind a colon, and with a ``;`` or an abbreviation inside.
    """
    marked = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\r\n]|[.!?;:]+(?=[ \t\r\n]|$)|(?<=(?:^|[( \t\r\n])[a-z0-9]{1,3})\)(?=[ \t])", "B")
    marked = F.trim(F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9B]+", " "), " ?B[ B]*", "B"))
    words = [w.replace(" ", "[ B]") for w in sorted(known.values(), key=len, reverse=True)]
    found = F.regexp_extract_all(marked, F.lit(f"(?<![^B])(?:{'|'.join(words)})(?![^B])"), F.lit(0))
    return identifiers(F.transform(found, lambda s: F.translate(s, "B", " ")), known)


def rule_pattern(names: Sequence[str]) -> str:
    """A pattern over ``,a,b,c,`` for the names in this order with any others between: the rule as SQL engines with linear patterns take it."""
    return ",(?:[a-z0-9_]+,)*".join(f",{n}" if i == 0 else n for i, n in enumerate(names)) + ","


def in_order(ids: Column, names: Sequence[str]) -> Column:
    """Whether ``names`` occur one after the other in ``ids``, others between or not: one pass that counts how many are found so far."""
    want = F.array(*[F.lit(n) for n in names])
    return F.aggregate(ids, F.lit(0), lambda k, x: F.when(F.get(want, k) == x, k + 1).otherwise(k)) == len(names)


def trigger(known: Mapping[str, str]) -> str:
    """A pattern that every text with a known sentence matches: the rarest-looking (longest) word of each."""
    words = sorted({max(s.split(), key=lambda w: (len(w), w)) for s in known.values()})
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


def scan(docs: DataFrame, known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple] = RULES) -> DataFrame:
    """doc_id, sentence_ids, licenses, n_known for every document; a map without a shuffle, in built-in functions only.

    Sentences are sought in the text as it stands, with line breaks taken as spaces, and from boundary to boundary (see
    ``joined_identifiers``), for licences wrapped over lines; a rule holds if one of the sequences has its sentences in order.
    ``sentence_ids`` is the longest sequence (the first of those as long), ``licenses`` the rules that hold, in their order, without those that a fuller rule hides; both comma-joined, empty if none. Null and empty texts have
    none; repeated rows are scanned each. The knowledge is a literal in the plan: its size is that of the two tables above.
    """
    unwrapped = F.translate(F.col("text"), "\r\n", "  ")
    d = docs.select("doc_id", F.when(F.col("text").rlike(trigger(known)), F.col("text")).alias("text"))
    ids = F.coalesce(identifiers(sentences_of(F.col("text")), known), F.array().cast("array<string>"))
    more = F.coalesce(identifiers(sentences_of(unwrapped), known), F.array().cast("array<string>"))
    whole = F.coalesce(joined_identifiers(F.col("text"), known), F.array().cast("array<string>"))
    d = d.select("doc_id", ids.alias("_a"), more.alias("_b"), whole.alias("_c"))
    holds = lambda names: F.exists(F.array("_a", "_b", "_c"), lambda ids: in_order(ids, names))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(holds(names), F.lit(name)) for name, names, _ in rules])))
    d = d.withColumn("_found", F.when((F.size("_a") + F.size("_b") + F.size("_c")) > 0, found).otherwise(F.array().cast("array<string>")))
    hides = {name: hidden for name, _, hidden in rules if hidden}
    gone = F.flatten(F.array(*[F.when(F.array_contains("_found", name), F.array(*[F.lit(h) for h in hidden])).otherwise(F.array().cast("array<string>")) for name, hidden in hides.items()]))
    most = F.greatest(F.size("_a"), F.size("_b"), F.size("_c"))
    own = F.when(F.size("_a") == most, F.col("_a")).when(F.size("_b") == most, F.col("_b")).otherwise(F.col("_c"))
    return d.select("doc_id", F.array_join(own, ",").alias("sentence_ids"), F.array_join(F.array_except("_found", gone), ",").alias("licenses"), F.size(own).cast("bigint").alias("n_known"))
