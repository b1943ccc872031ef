"""Licence scans: the trigger words, wrapped and mixed texts, rule order, and the SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pathloom.llm import licenses
from pathloom.llm.queries import ORACLE_SQL, QUERIES

MIT = """# Copyright (c) 2020 A. Holder
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission.
"""
GPL = "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 3 of the License, or\n(at your option) any later version.\n"

CASES = [
    (1, "No end here\nReleased under the MIT License.", "MIT"),
    (2, "Words. This work is licensed under the GNU General Public Licence,\nversion 3. More.", "GPL-3.0"),
    (3, MIT, "MIT"),
    (4, BSD, "BSD-2-Clause"),
    (5, BSD + THIRD, "BSD-3-Clause"),
    (6, GPL + "\n" + MIT + "\nLicensed under CC BY-NC 4.0.", "GPL-3.0-or-later,MIT,CC-BY-NC-4.0"),
    (7, None, ""),
    (8, "", ""),
    (9, "The MIT license was discussed at length. Permission is a word.", ""),
    (10, GPL[:30] + "x " * 30 + GPL[30:], ""),
    (11, "word. " * 200_000 + "Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    (12, "SPDX-License-Identifier: MIT\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "MIT,CC-BY-NC-4.0"),
    (12, "SPDX-License-Identifier: MIT\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "MIT,CC-BY-NC-4.0"),
    (None, "This file is in the public\n// domain.", "Public-Domain"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("key", "sequence", "rest", "licenses")})


def hashed(rows):
    return sorted(map(str, rows))


def sql(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.sql(f"SELECT doc_id, licenses, sequence, n_known, unclaimed FROM ({ORACLE_SQL['op2_license_scan']})").fetchall()


def test_triggers():
    for sentence in licenses.known_sentences():
        assert licenses.TRIGGER.search(sentence), sentence
        assert licenses.normalised(sentence) == sentence
    known = set(licenses.known_sentences().values())
    assert {i for run, _ in licenses.RULES for i in run.split()} <= known


def test_cases(docs):
    got = licenses.scan(docs)
    rows = [tuple(r) for r in got.collect()]
    assert hashed((k, names) for k, names, *_ in rows) == hashed((k, names) for k, _, names in CASES)
    import pandas as pd

    frame = pd.DataFrame({"doc_id": pd.array([c[0] for c in CASES], "Int64"), "text": [c[1] for c in CASES]})
    assert hashed(rows) == hashed(sql(frame))
    assert licenses.scan(docs.limit(0)).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    got = [tuple(r) for r in QUERIES["op2_license_scan"](spark, f"/root/testdata/{sf}").collect()]
    frame = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").toPandas()
    assert hashed(got) == hashed(sql(frame))
    lines = {"Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."}
    assert {r[0] for r in got if r[1]} == {k for k, t in zip(frame.doc_id, frame.text) if t and lines & set(t.split("\n"))}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
3. This notice may not be removed or altered from any source distribution.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"


@pytest.mark.parametrize(
    "text,want",
    [
        (BSD + AS_IS, "BSD-2-Clause"), (BSD + ENDORSE + AS_IS, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (GPL.replace("software:", "software;").replace("Foundation,\n", "Foundation; ").replace("version 3", "version 2"), "GPL-2.0-or-later"), (ZLIB, "Zlib"), (MPL, "MPL-2.0"), ("Intro. " + MPL + "\n" + ZLIB, "MPL-2.0,Zlib"), (BSD, "BSD-2-Clause"),
        ("Distributed under the Boost Software License, Version 1.0. See below.", "BSL-1.0"), ("Licensed under the EPL 2.0.", "EPL-2.0"), ("This file is licensed under the zlib license.", "Zlib"),
        ("The licenses for most software are designed to take away your freedom to share and change it. ", "GPL-2.0"),
    ],
)
def test_texts_of_licences(spark, text, want):
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "x " * 50_000 + "\n\n" + text)], "doc_id long, text string")).collect()
    assert [r.licenses for r in got] == [want, want]


def test_every_sentence_has_a_trigger_and_rules_are_reached():
    assert all(licenses.TRIGGER.search(s) and licenses.normalised(s) == s for s in licenses.SENTENCES)
    made = set(licenses.known_sentences().values())
    runs = [run for run, _ in licenses.RULES]
    assert all(i in made for run in runs for i in run.split())
    assert all(not f" {a} " in f" {b} " for n, a in enumerate(runs) for b in runs[n + 1 :]), "a rule that a shorter one before it takes"
