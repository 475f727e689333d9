import re

import duckdb

from clearfold.llm import licences as lic


def brute(text):
    ids = []
    for s in re.split(r"\n|[.!?;:](?:\s|$)", text or "", flags=re.ASCII):
        s = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), s)).strip(" ")
        for name, form in lic.SENTENCES:
            if re.fullmatch(form.replace("{}", lic.NAME).replace("( |, )", " "), s):
                ids.append(name)
                break
    line = f" {' '.join(ids)} "
    for licence, sequence in lic.RULES:
        if re.search(" " + " (.* )?".join(sequence) + " ", line):
            return ids, licence
    return ids, None


TEXTS = [
    None, "", "nothing here", "Prose.\nLicensed under the Apache License, Version 2.0.\nMore.", "All rights reserved.", "Copyright (c) 2020 A Name. All rights reserved.",
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nNeither the name of X nor Y may be used to endorse or promote products derived from this software without specific prior written permission.",
    "SPDX-License-Identifier - EPL 2", "He licensed under the table.", "word " * 100_000 + "\nAll rights reserved.", "Released under the MIT License. " * 50,
]


def test_equals_brute_force(spark, documents):
    got = lic.scan(documents([(i, t, "s") for i, t in enumerate(TEXTS)])).collect()
    assert {r["doc_id"]: (r["sentence_ids"], r["licence"]) for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert {r["licence"] for r in got} >= {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC", "CC-BY", "BSD-3-Clause", "proprietary", "declared", None}


def test_empty_table_and_repeated_rows(spark, documents):
    assert lic.scan(documents([]).limit(0)).count() == 0
    assert lic.report(documents([(None, "All rights reserved.", None)] * 2)).count() == 2


# Usual headers, wrapped as in source files.
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, and to permit persons
to whom the Software is furnished to do so, subject to the following
conditions:

The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
3. Neither the name of Some Firm Inc. nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
HEADERS = [
    ("SPDX-License-Identifier: MIT", ["spdx"], "declared"),
    (GPL.format(":", ",", 3), ["gpl-free"], "GPL"), (GPL.format(";", ";", 2), ["gpl-free"], "GPL"), (MPL, ["mpl2"], "MPL-2.0"),
    (MIT, ["mit-grant", "mit-notice", "as-is"], "MIT"), (BSD, ["bsd-grant", "bsd-source", "bsd-names"], "BSD-3-Clause"),
    (APACHE, ["apache2", "apache2-use", "apache2-copy"], "Apache-2.0"), ("Licensed under the\nMIT License.", ["mit"], "MIT"),
    ("Licensed under Creative Commons Attribution\nShareAlike 4.0", ["cc-by-sa"], "CC-BY-SA"),
    ("Copyright 2020 Some Firm Inc. All rights reserved.", ["copyright", "reserved"], "proprietary"),
]
NOT_ONE_SENTENCE = ["Licensed under the\n\nMIT License.", "Licensed under the. MIT License.", "# Licensed under the\n#\n# MIT License."]


def test_wrapped_and_commented_headers(spark, documents):
    styles = [lambda t, p=p, e=e: e.join(p + line for line in t.split("\n")) for p in ("", "# ", " * ", "// ", "; ", "> ", "-- ") for e in ("\n", "\r\n")]
    docs = [(style(text), ids, licence) for text, ids, licence in HEADERS for style in styles]
    docs += [("Some code.\n\n" + text + "\n\nMore code.", ids, licence) for text, ids, licence in HEADERS] + [(t, [], None) for t in NOT_ONE_SENTENCE]
    got = {r["doc_id"]: (r["sentence_ids"], r["licence"]) for r in lic.scan(documents([(i, t, "s") for i, (t, _, _) in enumerate(docs)])).collect()}
    assert [got[i] for i in range(len(docs))] == [(ids, licence) for _, ids, licence in docs]


def test_many_marks_in_a_row(spark, documents):
    texts = [x * 50_000 + "\nAll rights reserved." for x in (": ", "\n", " \n", "v. ", "permission is hereby granted\n")]
    got = lic.scan(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert all(r["sentence_ids"] == ["reserved"] for r in got)


def samples(form):
    """Shortest texts of a form, with each alternative of its first group, and the longest one of the first alternatives."""
    form = form.replace("{}", "4 0").replace(".+", "Some Name").replace(".*", "").replace("[0-9]", "4").replace("( |, )", ", ")
    short = re.sub(r"\([^()]*(\([^()]*\)[^()]*)*\)\?", "", form)
    whole = re.sub(r"\(([^()|]*)(\|[^()]*)?\)\??", r"\1", re.sub(r"\(([^()|]*)(\|[^()]*)?\)\??", r"\1", form))
    group = re.search(r"\(([^()]*)\)", short)
    words = group[1].split("|") if group else [""]
    texts = [short[: group.start()] + w + short[group.end() :] for w in words] if group else [short]
    return [re.sub(r"\(([^()|]*)(\|[^()]*)?\)\??", r"\1", t).strip() for t in texts + [whole]]


def test_every_sentence_equals_the_sql(spark, documents):
    """The search of candidates leaves none out, whatever the blanks and the case."""
    texts, names = [], []
    for name, form in lic.SENTENCES:
        for t in samples(form):
            variants = [t, t.upper() + ".", t.replace(" ", "  "), f"Before. {t.title()}! After"]
            texts += variants
            names += [name] * len(variants)
    texts += ["Released under CC0 1.0.", "This work is released under CC BY-SA 4.0."]
    names += ["cc0", "cc-by-sa"]
    got = {r["doc_id"]: r["sentences"] for r in lic.report(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 's')", list(enumerate(texts)))
    assert got == {r[0]: r[2] for r in con.execute(lic.SQL).fetchall()}
    assert [got[i] for i in range(len(texts))] == names


def test_sentences_of_the_caller(spark, documents):
    docs = documents([(0, "Free for\nall.", "s"), (1, "Yours or mine", "s"), (2, "All rights reserved.", "s")])
    got = lic.scan(docs, sentences=(("free", "free for (all|some)"), ("own", "yours or mine|ours")), rules=(("X", ("free",)),)).collect()
    assert {r["doc_id"]: (r["sentence_ids"], r["licence"]) for r in got} == {0: (["free"], "X"), 1: (["own"], None), 2: ([], None)}


USUAL = [
    ("This project is licensed under the terms of the MIT license.", "MIT"), ("Licensed under GPLv3", "GPL-3.0"), ("Released under the MIT licence.", "MIT"),
    ("Released under the ISC license.", "ISC"), ("Licensed under the EPL-2.0.", "EPL-2.0"), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Licensed under the GNU LGPL v2.1 or later", "LGPL-2.1"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA"), ("Licensed under the Mozilla Public License 2.0", "MPL-2.0"), ("Licensed under the European Union Public License, version 1.2", "EUPL-1.2"),
]


def test_usual_sentences(spark, documents):
    got = {r["doc_id"]: r["licence"] for r in lic.scan(documents([(i, t, "s") for i, (t, _) in enumerate(USUAL)])).collect()}
    assert [got[i] for i in range(len(USUAL))] == [licence for _, licence in USUAL]
    assert sum(form.count('|') + 1 for _, form in lic.SENTENCES) >= 300 and len({licence for licence, _ in lic.RULES}) >= 40


def test_no_length_caps(spark, documents):
    long = "Copyright 2020 " + "A Very Long Name " * 30 + ". All rights reserved."
    names = "Neither the name of " + "Some Firm and " * 20 + "others may be used to endorse or promote products derived from this software without specific prior written permission."
    got = {r["doc_id"]: r["sentence_ids"] for r in lic.scan(documents([(0, long, "s"), (1, names, "s")])).collect()}
    assert got == {0: ["copyright", "reserved"], 1: ["bsd-names"]}


def test_declared_expressions(spark, documents):
    texts = ["// SPDX-License-Identifier: MIT", "# spdx-license-identifier: (GPL-2.0-only  OR MIT)\ncode", "/* SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception */", "SPDX", None, "SPDX-License-Identifier:"]
    got = {r["doc_id"]: r["spdx"] for r in lic.scan(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(6)] == ["MIT", "(GPL-2.0-only OR MIT)", "Apache-2.0 WITH LLVM-exception", None, None, None]
