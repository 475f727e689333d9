"""Licence scans by sentences: known sentences become identifiers, and rules match their sequences.

A text is normalised with marks where a sentence ends or may end, and known licence sentences
are looked up from mark to mark. A sentence may run over marks of the second kind: single line
feeds with or without comment prefixes, colons, semicolons, abbreviations. The identifiers of a
text in order form a sequence, and the first of an ordered list of rules whose identifiers occur
in it, one after the other, names the licence.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import ascii_lower

# An identifier and the pattern of the normalised sentences that bear it. Normalised
# means a-z, 0-9 and single blanks; "{}" stands for a version or a name of any length.
WRITTEN = (
    ("apache2", "(this (work|software|file|project) is )?(licensed|released|distributed) under the apache license( |, )version 2 0( the license)?"),
    ("apache2-use", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at( http)?"),
    ("gpl3", "(this (work|software|file|project|program) is )?(licensed|released|distributed) under the gnu general public license( |, )version 3( 0)?"),
    ("gpl2", "(this (work|software|file|project|program) is )?(licensed|released|distributed) under the gnu general public license( |, )version 2( 0)?"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or at your option any later version"),
    ("lgpl", "(this (work|software|file|project|library) is )?(licensed|released|distributed) under the gnu lesser general public license( version {})?"),
    ("agpl3", "(this (work|software|file|project|program) is )?(licensed|released|distributed) under the gnu affero general public license( version 3( 0)?)?"),
    ("mit", "(this (work|software|file|project) is )?(licensed|released|distributed) under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind.*"),
    ("bsd", "(this (work|software|file|project) is )?(licensed|released|distributed) under the (new |modified |simplified )?bsd license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-names", "neither the name of .+ may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "(this (work|text|page) is )?(licensed|released) under (a )?(cc by nc|creative commons attribution noncommercial)( {})?( international license)?"),
    ("cc-by-sa", "(this (work|text|page) is )?(licensed|released) under (a )?(cc by sa|creative commons attribution sharealike)( {})?( international license)?"),
    ("cc-by", "(this (work|text|page) is )?(licensed|released) under (a )?(cc by|creative commons attribution)( [0-9] [0-9])?( international license)?"),
    ("cc0", "(this (work|text|page) is )?(licensed|released) under cc0( {})?"),
    ("spdx", "spdx license identifier {}"),
    ("reserved", "all rights reserved"),
    ("copyright", "(copyright )?(c )?copyright .+"),
)
# An identifier, its licence, and the names it goes by in "licensed under the ...". Versions are spelt by ``_spelt``.
NAMED = (
    ("agpl3", "AGPL-3.0", ("agpl", "gnu agpl", "affero general public"), "3 0"), ("lgpl3", "LGPL-3.0", ("lgpl", "gnu lgpl", "lesser general public"), "3 0"),
    ("lgpl21", "LGPL-2.1", ("lgpl", "gnu lgpl", "lesser general public"), "2 1"), ("gpl3", "GPL-3.0", ("gpl", "gnu gpl", "general public"), "3 0"),
    ("gpl2", "GPL-2.0", ("gpl", "gnu gpl", "general public"), "2 0"), ("apache2", "Apache-2.0", ("apache", "apache software"), "2 0"),
    ("apache11", "Apache-1.1", ("apache", "apache software"), "1 1"), ("mpl2", "MPL-2.0", ("mpl", "mozilla public"), "2 0"), ("mpl11", "MPL-1.1", ("mpl", "mozilla public"), "1 1"),
    ("epl2", "EPL-2.0", ("epl", "eclipse public"), "2 0"), ("epl1", "EPL-1.0", ("epl", "eclipse public"), "1 0"), ("eupl12", "EUPL-1.2", ("eupl", "european union public"), "1 2"),
    ("cddl1", "CDDL-1.0", ("cddl", "common development and distribution"), "1 0"), ("bsl1", "BSL-1.0", ("bsl", "boost software"), "1 0"),
    ("ofl11", "OFL-1.1", ("ofl", "sil ofl", "sil open font"), "1 1"), ("artistic2", "Artistic-2.0", ("artistic",), "2 0"), ("afl3", "AFL-3.0", ("afl", "academic free"), "3 0"),
    ("osl3", "OSL-3.0", ("osl", "open software"), "3 0"), ("cecill2", "CECILL-2.1", ("cecill",), "2 1"), ("odbl1", "ODbL-1.0", ("odbl", "open database"), "1 0"),
    ("by-nc-sa", "CC-BY-NC-SA", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), "4 0"),
    ("by-nc-nd", "CC-BY-NC-ND", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), "4 0"), ("by-nd", "CC-BY-ND", ("cc by nd", "creative commons attribution noderivatives"), "4 0"),
    ("mit", "MIT", ("mit", "expat", "mit x11"), ""), ("isc", "ISC", ("isc",), ""), ("zlib", "Zlib", ("zlib", "zlib libpng"), ""), ("unlicense", "Unlicense", ("unlicense",), ""),
    ("wtfpl", "WTFPL", ("wtfpl", "do what the fuck you want to public"), ""), ("postgresql", "PostgreSQL", ("postgresql",), ""), ("ncsa", "NCSA", ("ncsa", "university of illinois ncsa open source"), ""),
    ("ms-pl", "MS-PL", ("ms pl", "microsoft public"), ""), ("zero-bsd", "0BSD", ("0bsd", "zero clause bsd"), ""), ("psf", "Python-2.0", ("psf", "python software foundation"), ""),
    ("bsd3", "BSD-3-Clause", ("bsd 3 clause", "3 clause bsd", "revised bsd"), ""), ("bsd2", "BSD-2-Clause", ("bsd 2 clause", "2 clause bsd", "freebsd"), ""), ("beerware", "Beerware", ("beerware", "beer ware"), ""),
)
# Further sentences of licence texts and headers.
FURTHER = (
    ("lgpl-free", "(this (library|program) is )free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {} of the license or at your option any later version"),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {} of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zero-bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("wtfpl-grant", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("epl2-header", "this program and the accompanying materials are made available under the terms of the eclipse public license( v| version)? 2 0.*"),
    ("apache2-unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties.*"),
    ("cc0-waiver", "to the extent possible under law .+ has waived all copyright and related or neighboring rights to .+"),
    ("public-domain", "(this (work|software|file) is )(hereby )?(placed|released) in(to)? the public domain"),
    ("ofl-header", "this font software is licensed under the sil open font license version {}"),
)
SUBJECT = "(this (work|software|file|project|program|library|package|code) is )?"


def _spelt(names: Sequence[str], version: str) -> list[str]:
    """All spellings of a named licence: the name, the version as "v3", "version 3 0" and so on, and "license" before or after it."""
    if not version:
        return list(names)
    short = version.removesuffix(" 0")
    numbers = [version, short] if short != version else [version]
    return [f"{n}{link}{number}" for n in names for link in (" ", " v", "v", " version ", " license ", " license v", " license version ") for number in numbers]


def _named_form(names: Sequence[str], version: str) -> str:
    alts = "|".join(sorted(_spelt(names, version), key=lambda x: (-len(x), x)))
    return f"{SUBJECT}(licensed|released|distributed) under (the terms of )?(the )?(gnu )?({alts})( license| licence)?( or later| only)?"


_FORMS = tuple((name, _named_form(names, version)) for name, _, names, version in NAMED)
_WIDER = tuple(f for f in _FORMS if f[0].startswith("by-"))  # before the written forms, whose versions could be read as their last letters
SENTENCES = (*_WIDER, *WRITTEN, *FURTHER, *(f for f in _FORMS if f not in _WIDER))
# The licence and the identifiers that name it, in order; the first rule that matches counts.
WRITTEN_RULES = (
    ("AGPL-3.0", ("agpl3",)),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-2.0", ("gpl2",)),
    ("GPL", ("gpl-free",)),
    ("LGPL", ("lgpl",)),
    ("Apache-2.0", ("apache2", "apache2-use")),
    ("Apache-2.0", ("apache2",)),
    ("MPL-2.0", ("mpl2",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source")),
    ("BSD", ("bsd",)),
    ("CC-BY-NC", ("cc-by-nc",)),
    ("CC-BY-SA", ("cc-by-sa",)),
    ("CC-BY", ("cc-by",)),
    ("CC0", ("cc0",)),
    ("declared", ("spdx",)),
    ("proprietary", ("copyright", "reserved")),
    ("proprietary", ("reserved",)),
)
FURTHER_RULES = (
    ("AGPL", ("agpl-free",)), ("LGPL", ("lgpl-free",)), ("Unlicense", ("unlicense-free",)), ("ISC", ("isc-grant",)), ("0BSD", ("zero-bsd-grant",)), ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-grant",)), ("WTFPL", ("wtfpl-grant",)), ("EPL-2.0", ("epl2-header",)), ("OFL", ("ofl-header",)), ("CC0", ("cc0-waiver",)), ("public domain", ("public-domain",)),
)
NAMED_RULES = tuple((licence, (name,)) for name, licence, _, _ in NAMED)
_LAST = next(i for i, (licence, _) in enumerate(WRITTEN_RULES) if licence == "declared")
RULES = (*WRITTEN_RULES[:_LAST], *FURTHER_RULES, *NAMED_RULES, *WRITTEN_RULES[_LAST:])
NAME = "[a-z0-9 ]+"
# Marks are upper-case letters, which a lowered text does not have: H ends a sentence, S may lie within one.
BLANK_LINE = r"\n[^a-z0-9\n]*\n"  # comment prefixes may stand on it
SHORTENED = r"(?<![a-z0-9])(v|inc|ltd|corp|co)\.\s"
MARKS = ((BLANK_LINE, "H"), (SHORTENED, "$1S"), (r"[.!?](\s|$)", "H"), (r"\n|[;:](\s|$)", "S"), ("[^a-z0-9HS]+", " "))


def _pattern(form: str) -> str:
    return "^(" + form.replace("{}", NAME).replace("( |, )", " ") + ")$"


def _running(form: str) -> str:
    """``form`` over marked text: blanks, versions and names may hold the mark S, text of any length at the end may not.

    A form that is little more than any text, as that of copyright lines, stays on its line.
    """
    if form.endswith("copyright .+"):
        return form.replace(".+", "[a-z0-9 ]+")
    form = form.replace("( |, )", " ").replace("[0-9] [0-9]", "[0-9]{}[0-9]").replace(" ", "[ S]+").replace("[0-9]{}[0-9]", "[0-9][ S]+[0-9]")
    return form.replace("{}", "[a-z0-9 S]+?").replace(".+", "[a-z0-9 S]+?").replace(".*", "[a-z0-9 ]*")


def _hint(form: str) -> set[str]:
    """Words of which every text of ``form`` holds one, as long as possible; empty if it has none.

    Only what stands outside of groups counts, and groups of alternatives that are not optional.
    """
    groups, depth, start, plain = [], 0, 0, ""
    for i, c in enumerate(form):
        if c == "(":
            start = start if depth else i
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                plain += "|"
                if form[i + 1 : i + 2] not in ("?", "*", "{"):
                    groups.append(form[start + 1 : i].split("|"))
        elif not depth:
            if c == "|":
                return {""}
            plain += c
    longest = lambda t: max(re.findall("[a-z]+(?![?*{])", re.sub(r"\[.*?\]|\{.*?\}", "|", t)), key=len, default="")
    found = [{longest(plain)}] + [{longest(t) for t in group} for group in groups if not any("(" in t for t in group)]
    return max(found, key=lambda words: min(map(len, words)))


def hint(sentences: Sequence[tuple[str, str]] = SENTENCES) -> str:
    """Pattern of words of which a text with any of ``sentences`` holds one. Words have letters only, so normalisation keeps them."""
    return "|".join(sorted(set().union(*(_hint(form) for _, form in sentences))))


def marked(text: Column) -> Column:
    """Lower case, with marks, and every run of other characters than letters and digits as one blank."""
    out = ascii_lower(text)
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def _identifier(sentence: Column, sentences: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, form in reversed(sentences):
        out = F.when(sentence.rlike(_pattern(form)), F.lit(name)).otherwise(out)
    return out


def identifiers(text: Column, sentences: Sequence[tuple[str, str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order. Only texts with a word of licences are searched.

    Each mark is a start of its own, so a sentence within the lines of another one counts too.
    """
    forms = "|".join(f"(?:{_running(form)})" for _, form in sentences).replace("(?:", "(").replace("(", "(?:")
    hinted = F.when(ascii_lower(text).rlike(hint(sentences)), text).otherwise(F.lit(""))
    found = F.regexp_extract_all(marked(hinted), F.lit(f"(?:^|[HS]) ?(?=({forms}) ?(?:[HS]|$))"), F.lit(1))
    return F.transform(found, lambda s: _identifier(F.trim(F.regexp_replace(s, "[ S]+", " ")), sentences))


def first_rule(ids: Column, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> Column:
    """Licence of the first rule whose identifiers occur in ``ids`` in their order, with any others between."""
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    out = F.lit(None).cast("string")
    for licence, sequence in reversed(rules):
        out = F.when(line.rlike(" " + " (.* )?".join(sequence) + " "), F.lit(licence)).otherwise(out)
    return out


SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])"


def declared(text: Column) -> Column:
    """The first SPDX expression that a text declares, with single blanks; null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), SPDX, 1)
    return F.nullif(F.trim(F.regexp_replace(found, " +", " ")), F.lit(""))


def scan(docs: DataFrame, text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """Add ``sentence_ids``, ``licence`` (null when no rule matches) and ``spdx`` in one pass, without a shuffle.

    Null and empty texts have no sentences and no licence. Columns of these names are replaced.
    """
    found = docs.withColumn("sentence_ids", identifiers(F.col(text_col), sentences))
    return found.withColumns({"licence": first_rule(F.col("sentence_ids"), rules), "spdx": declared(F.col(text_col))})


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentences"), "licence", "spdx")


def _sql() -> str:
    """The same table and rules for DuckDB, over all sentences instead of hinted ones."""
    cases = " ".join(f"WHEN regexp_full_match(s, '{form.replace('{}', NAME).replace('( |, )', ' ')}') THEN '{name}'" for name, form in SENTENCES)
    rules = " ".join(f"WHEN regexp_matches(line, ' {' (.* )?'.join(seq)} ') THEN '{name}'" for name, seq in RULES)
    return f"""
WITH parts AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM
    (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\n|[.!?;:]([ \\t\\n\\f\\r\\x0B]|$)') AS p FROM documents)),
named AS (SELECT doc_id, i, CASE {cases} END AS id FROM (SELECT doc_id, i,
    trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts)),
lines AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, ' ' || string_agg(id, ' ' ORDER BY i) || ' ' AS line
    FROM named WHERE id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentences, CASE {rules} END AS licence,
  nullif(trim(regexp_replace(regexp_extract(coalesce(text, ''), '{SPDX}', 1), ' +', ' ', 'g')), '') AS spdx FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id
"""


SQL = _sql()
