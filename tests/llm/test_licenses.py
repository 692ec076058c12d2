from __future__ import annotations

from quillon.llm import licenses


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.scan_licenses(df).collect()}


def test_rules(spark):
    by = dict(licenses.SENTENCES[::-1])
    mit = ". ".join(by[i] for i in ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")) + "."
    bsd = [by[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    got = found(
        spark, mit.upper(), "Some prose.\n" + "\n * ".join(bsd), "\n".join(bsd[:3]), "\n".join(reversed(bsd)), "Released under the MIT License. All rights reserved!\nLicensed under CC BY-NC 4.0.",
        "We released it under the MIT License, mostly.", "Licensed under the Apache License, Version 2.0.", None, "", "...!?\n\n",
    )
    assert got[0] == (4, "MIT")
    assert got[1] == (4, "BSD-3-Clause") and got[2] == (3, "BSD-2-Clause")
    assert got[3] == (4, "")  # rules are ordered: sentences in the wrong order are no licence
    assert got[4] == (3, "MIT,Proprietary,CC-BY-NC-4.0")
    assert got[5] == (0, "") and got[6] == (1, "Apache-2.0")
    assert got[7] == got[8] == got[9] == (0, "")


def test_every_known_sentence_is_reached(spark):
    got = found(spark, *[s for _, s in licenses.SENTENCES])
    assert all(n == 1 for n, _ in got.values())


def test_odd_rows(odd, nothing):
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(nothing).count() == 0
    assert "PythonUDF" not in (plan := licenses.scan_licenses(odd)._jdf.queryExecution().toString()) and "Exchange" not in plan


def test_known_sentences_behind_long_banners(spark):
    lead = ["#" * 63, "#" * 64, "=" * 500, " " * 200, "Лицензия " * 20, "许可证" * 40]
    got = found(spark, *[f"{x} Licensed under the MIT License" for x in lead])
    assert all(g == (1, "MIT") for g in got.values())


_MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def commented(text, first, lead, last=""):
    return "\n".join([first, *[lead + line for line in text.splitlines()], last])


def wrapped_texts():
    texts = []
    for text in (_MIT, _BSD, _APACHE, _GPL):
        texts += [text, text.replace("\n", "\r\n"), commented(text, "/*", " * ", " */"), commented(text, "", "# "), commented(text, "", "// "), commented(text, "", "!! "), "x" * 500 + "\n\n" + text + "\nmore words follow here."]
    odd = ["Released under\n\nthe MIT License", "Released under\n# the MIT\nLicense.", "Released. Under the MIT License", "We say: released\nunder the MIT License", " " * 70 + "Released under the MIT License", "/" + "*" * 70 + " Released under the MIT License", "\f\n.MIT License ", "MIT License\x85", "S L\nMIT License\nL", "\r\r\n\n", "MIT License!"]
    return texts, odd


def test_wrapped_and_commented_texts(spark):
    texts, odd = wrapped_texts()
    got = found(spark, *texts, *odd)
    names = ["MIT"] * 7 + ["BSD-3-Clause"] * 7 + ["Apache-2.0"] * 7 + ["GPL-3.0-or-later"] * 7
    assert [got[i] for i in range(28)] == [(n, name) for n, name in zip([5] * 7 + [4] * 14 + [3] * 7, names)]
    assert [got[28 + i][1] for i in range(len(odd))] == ["", "MIT", "", "", "MIT", "MIT", "MIT", "MIT", "MIT", "", "MIT"]


def test_wrapped_texts_equal_sql(spark):
    import duckdb

    texts, odd = wrapped_texts()
    rows = list(enumerate([*texts, *odd, "a\nb. " * 3000, "", None, "Ünder the\nMIT License \U0001f600."]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mine = licenses.scan_licenses(df).orderBy("doc_id").toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    other = con.execute(licenses.oracle() + " ORDER BY doc_id").df()
    for c in mine.columns:
        assert mine[c].tolist() == other[c].tolist()
