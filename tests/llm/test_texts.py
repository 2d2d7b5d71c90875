"""Licence scan, language id, fingerprints, page text and decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rodada.llm import fingerprints
from rodada.llm.decontaminate import WuManber, contamination, contamination_sql, patterns_of, sha_of, words_of
from rodada.llm.fingerprints import combine, document_fingerprints
from rodada.llm.html_text import Page, main_text, page_texts
from rodada.llm.language_id import grams, language_id, learn, ranked
from rodada.llm.licenses import RULES, SENTENCES, license_scan, license_sql, spellings, words

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software. The above copyright notice and this permission notice shall be included in all copies.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
LICENSED = [
    (1, "Foo bar.\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, MIT), (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (6, "A permission slip and a warranty."), (7, None), (8, ""), (9, "plain"), (9, "plain"), (10, "x. SPDX-License-Identifier: BSD-3-Clause\n"),
    (11, "You may obtain a copy of the License at http://x"), (12, "# Redistribution and use in source and binary forms, with or without modification, are permitted.\n# Redistributions of source code must retain the above copyright notice.\n# Redistributions in binary form must reproduce the above copyright notice.\n# Neither the name of X may be used to endorse or promote products."),
]


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in LICENSED], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r for r in license_scan(docs).collect()}
    assert {i: got[i]["licenses"] for i in got} == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "GPL-3.0-only", 5: "CC-BY-NC-4.0", 6: "", 7: "", 8: "", 9: "", 10: "BSD-3-Clause", 11: "", 12: "BSD-3-Clause"}
    assert got[11]["unmatched"] == "apache2_copy" and got[3]["n_sentences"] == 4
    assert license_scan(docs).count() == len(LICENSED) and license_scan(docs.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LICENSED)
    want = sorted(con.execute(license_sql()).fetchall())
    assert sorted(tuple(r) for r in license_scan(docs).collect()) == want


def test_every_known_sentence_is_found_alone(spark):
    alone = [(name, x) for name, phrase in SENTENCES for s in sorted(spellings(phrase)) for x in [s.replace("\n", "2024").strip()] if re.search(phrase, x)]
    assert {n for n, _ in alone} == {n for n, _ in SENTENCES} and all(re.search(words(), s) for _, s in alone)
    first = [next(n for n, phrase in SENTENCES if re.search(phrase, s)) for _, s in alone]
    rows = [(i, f"Nothing here. {s.capitalize()}. Nothing more.") for i, (_, s) in enumerate(alone)]
    rows += [(i + len(rows), s) for i, s in enumerate(["Text available under CC BY-SA 4.0.", "Dedicated under CC0.", "Creative Commons Attribution 4.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://x."])]
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in sorted(got)] == [*first, "cc_by_sa4", "cc0", "cc_by4", "mpl2_copy"]


HOPE = """This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, see <https://www.gnu.org/licenses/>."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

""" + HOPE
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    ("GPL-2.0-or-later", GPL.format(2)), ("GPL-3.0-or-later", GPL.format(3)), ("GPL-2.0-or-later", GPL.format(2).replace("Foundation; either", "Foundation;\neither").replace("by\nthe Free", "by the\nFree")),
    ("AGPL-3.0-or-later", GPL.format(3).replace("GNU General", "GNU Affero General")), ("LGPL-3.0-or-later", GPL.format(3).replace("GNU General", "GNU Lesser General")),
    ("AGPL", "See the GNU Affero General Public License."), ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"), ("LGPL", "See the GNU Lesser General Public License."), ("LGPL-3.0-only", "GNU Lesser General Public License version 3"), ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("EPL-2.0", "Eclipse Public License 2.0"), ("EPL-1.0", "Eclipse Public License v1.0"), ("BSL-1.0", "Boost Software License 1.0"), ("Zlib", "Released under the zlib License."), ("Apache-2.0 OR MIT", "MIT license or Apache License 2.0"),
    ("GPL-3.0-only", "Licensed under the GNU\nGeneral Public License version 3."), ("GPL-2.0-only", "Licensed under the GNU General\nPublic License v2."), ("GPL", "See COPYING, the GNU General Public\nLicense."),
    ("MPL-2.0", MPL), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy of the MPL was not distributed with this file,\nYou can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""),
    ("BSD-2-Clause", BSD.format("")), ("BSD-3-Clause", BSD.format(ENDORSE)), ("BSD", "Released under the\nModified BSD License."),
    *((f"CC-{x.upper().replace(' ', '-')}-4.0", f"This work is licensed under a Creative Commons\n{y} 4.0 International License.") for x, y in [("by", "Attribution"), ("by sa", "Attribution-ShareAlike"), ("by nc", "Attribution-NonCommercial"), ("by nd", "Attribution-NoDerivatives"), ("by nc sa", "Attribution-NonCommercial-ShareAlike"), ("by nc nd", "Attribution-NonCommercial-NoDerivatives")]),
    ("CC0-1.0", "Dedicated under Creative Commons\nZero."), ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Public-Domain", "These files are in the public domain."), ("Proprietary", "Copyright (c) 2024 Acme Inc. All rights reserved."),
    ("MIT,CC-BY-4.0", "Code is released under the MIT License\nText is available under CC BY 4.0"),
]


def test_standard_notices(spark):
    """Each rule fires on its whole notice, plain and in comments, and leaves no other licence."""
    rows = [(i, w + w.join(t.splitlines(True))) for k, w in enumerate(("", "# ", " * ", "// ")) for i, (_, t) in enumerate(NOTICES, 100 * k)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: NOTICES[i % 100][0] for i, _ in rows} and {n for n, _ in NOTICES} - {"MIT,CC-BY-4.0"} == {n for n, _ in RULES}


ALONE = [
    ("This picture is CC BY 4.0.", "CC-BY-4.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"), ("CC0 1.0 Universal", "CC0-1.0"), ("MIT License", "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2024 X", "MIT"),
    ("Licensed under the\nApache License, Version 2.0", "Apache-2.0"), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"), ("Under the GNU\nGeneral Public License, version 2", "GPL-2.0-only"), ("GNU General Public License version 3 or (at your option) any later version", "GPL-3.0-or-later"),
    ("// SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT"), ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-or-later", "MIT,BSD-3-Clause,GPL-2.0-or-later"),
    ("This is not licensed under the MIT License.", ""), ("It was never released under the MIT license", ""), ("No longer distributed under the BSD license.", ""), ("We like Apache or MIT.", ""), ("x" * 300_000 + ". Released under the MIT License. " + "y " * 100_000, "MIT"),
]


def test_licenses_named_alone(spark):
    rows = [(i, t) for i, (t, _) in enumerate(ALONE)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [want for _, want in ALONE]
    assert license_scan(spark.createDataFrame([(0, ALONE[-5][0])], "doc_id long, text string")).first()["unmatched"] == "denied"


def test_license_scan_is_native(spark):
    plan = license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


WORDS = {"en": "the and that with from this house water", "de": "der und nicht mit über straße wasser schön", "fr": "les des était où garçon maison même être"}


def test_language_id(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 60))), lang, "x") for i, lang in enumerate(random.Random(2).choices(sorted(WORDS), k=240))]
    rows += [(900, None, "en", ""), (901, "", "de", ""), (902, "123 !?", "fr", ""), (903, "the water", None, ""), (904, "der " * 20000, "de", ""), (905, "x", "en", ""), (905, "x", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    found = {x["doc_id"]: x for x in got.collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang, _ in rows[:240])
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and found[903]["lang_pred"] == "en" and found[904]["lang_pred"] == "de"
    assert all(0 <= x["score"] <= 1 for x in found.values()) and 0 < sum(x["held_out"] for x in found.values()) < len(found)
    assert {x["lang_pred"] for x in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id(docs.limit(0)).count() == 0


def _profile(texts, top):
    counts = Counter(g for t in texts for g in _grams(t))
    return sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[:top]


def _grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [f" {w} "[k : k + n] for w in words for n in (1, 2, 3) for k in range(len(w) + 3 - n) if n > 1 or f" {w} "[k] != " "]


def test_predictions_equal_plain_out_of_place_distances(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(1, 12))), lang) for i, lang in enumerate(r.choices(sorted(WORDS), k=90))]
    rows += [(200, "the der les", None), (201, "zzz", "de"), (202, "the water " * 30_000, None), (203, None, None), (None, "und nicht", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    top = 60
    learnt = [x for x in rows if x[2] and zlib.crc32(str(x[0]).encode()) % 4 != 2]
    profiles = {lang: _profile([t for _, t, g in learnt if g == lang], top) for lang in WORDS}
    want = {}
    for i, t, _ in rows:
        mine = _profile([t or ""], top)
        far = {lang: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.__getitem__)
        want[i] = (best, pytest.approx(1 - far[best] / (top * len(mine)))) if mine else ("und", 0.0)
    assert {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id(docs, top=top).collect()} == want


def test_equally_near_languages_take_the_smaller_name(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["xx", "aa", "mm"] * 8)]
    assert {x["lang_pred"] for x in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"aa"}


def test_learning_is_bounded_by_rows(spark):
    rows = [(1, f"word{chr(97 + k)}", "aa") for k in range(20)]  # one id, many rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn(docs, train_docs=1)
    assert len(profiles.codes) <= len(set(_grams("worda")))
    assert learn(docs, train_docs=20).names == ["aa"] and learn(docs.limit(0)).names == []


def test_grams():
    text, want = "Ab a, cá", []
    for w in ("ab", "a", "cá"):
        padded = f" {w} "
        for n in (1, 2, 3):
            want += [padded[k : k + n] for k in range(len(padded) - n + 1) if n > 1 or padded[k] != " "]
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    assert sorted(grams(text).tolist()) == sorted(map(code, want))
    assert grams("12 --").size == 0 and grams("").size == 0
    assert ranked(grams("aaa b b c"), 2).tolist()[0] in grams("aaa b b c").tolist()


def _edit(texts, k):
    half = len(texts[k]) // 2
    return texts[k][: len(texts[k]) - half] + texts[(k + 1) % len(texts)][:half]


def test_fingerprints(spark):
    r = random.Random(5)
    para = [" ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(9)) + "." for _ in range(60)]
    texts = ["\n".join(r.choice(para) for _ in range(r.randint(1, 30))) for _ in range(40)] + ["", "é𝄞x", "one", "\n".join(para), "\n".join(reversed(para))]
    rows = [(i * 10, t or None, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(random.Random(6).sample(rows, len(rows)), "doc_id long, text string, fingerprint string")
    got = {x["doc_id"]: x for x in document_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        x = got[k * 10]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(_edit(texts, k).encode()).hexdigest())
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    assert got[430]["fingerprint"] == got[440]["fingerprint"] and got[430]["near_next"] == 1.0  # order doesn't count
    assert len({x["fingerprint"] for x in got.values()}) == len({tuple(sorted(p for p in re.split(fingerprints.PARAGRAPH_END, t) if p.strip())) for t in texts})
    long_ = [got[k * 10] for k, t in enumerate(texts[:40]) if t.count("\n") > 15]
    assert sum(x["near_edited"] for x in long_) / len(long_) > 0.5


def _lanes(spark, units):
    """Lane sums of paragraphs, from the same two hashes of each one but summed in Python; the count last."""
    if not units:
        return [0] * 129
    h = spark.createDataFrame([(u,) for u in units], "u string").select(F.xxhash64(F.lit(11), "u"), F.xxhash64(F.lit(12), "u")).collect()
    bits = [[(x[s] >> (j + half)) & 1 for s in (0, 1) for j in range(32) for half in (0, 32)] for x in h]
    return [sum(b) for b in zip(*bits, strict=True)] + [len(units)]


def _near(a, b):
    if [x % 65536 for x in a[:128]] + a[128:] == [x % 65536 for x in b[:128]] + b[128:]:
        return 1.0
    u, v = ([(2 * x - s[128] + 32768) % 65536 - 32768 for x in s[:128]] for s in (a, b))
    size = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(u, v, strict=True)) / size)) if size else 0.0


def test_fingerprint_values_and_likeness(spark):
    r = random.Random(15)
    texts = [" ".join(r.choice(["one. ", "two!\n", "three", "\n\n", "four? "]) for _ in range(r.randint(0, 14))) for _ in range(12)] + ["a\n" * 70_000, "a\n" * 70_001]
    docs = spark.createDataFrame([*enumerate(texts), (None, "left out")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in document_fingerprints(docs).collect()}
    assert sorted(got) == list(range(len(texts)))
    units = lambda t: [p for p in re.split(fingerprints.PARAGRAPH_END, t) if p.strip(" ")]
    for k, t in enumerate(texts):
        own, edited, following = (_lanes(spark, units(x)) if len(x) < 1000 else [n * x.count("a") for n in _lanes(spark, ["a"])[:128]] + [x.count("a")] for x in (t, _edit(texts, k), texts[(k + 1) % len(texts)]))
        if len(t) > 1000 or k == 11:
            edited = None  # mixed paragraphs
        assert got[k]["fingerprint"] == "".join(f"{x % 65536:04X}" for x in own[:128]) + f"{own[128]:08X}"
        assert got[k]["near_next"] == pytest.approx(_near(own, following), abs=1e-6)
        assert edited is None or (got[k]["near_edited"] == pytest.approx(_near(own, edited), abs=1e-6) and got[k]["edited_fingerprint"][-8:] == f"{edited[128]:08X}")


def test_fingerprints_of_repeated_rows(spark):
    rows = [(1, "a. b."), (1, "a. b."), (2, "c."), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["fingerprint"], x["edited_sha256"]) for x in document_fingerprints(docs).collect())
    once = sorted((x["doc_id"], x["fingerprint"], x["edited_sha256"]) for x in document_fingerprints(docs.distinct()).collect())
    assert len(got) == 4 and sorted(set(got)) == once
    assert document_fingerprints(docs.limit(0)).count() == 0
    alone = document_fingerprints(spark.createDataFrame([(8, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0


def test_fingerprints_insert_and_delete(spark):
    docs = spark.createDataFrame([(1, "a\nb\nb"), (2, "b\nc"), (3, "b\na\nc\nb\nb")], "doc_id long, text string")
    f = {x["doc_id"]: x["fingerprint"] for x in document_fingerprints(docs).collect()}
    both = spark.createDataFrame([(f[1], f[2], f[3])], "a string, b string, c string").select(combine(F.col("a"), F.col("b")).alias("sum"), combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert both["sum"] == f[3] and both["rest"] == f[1]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><!-- a > b -->
<div class="cookie-notice">We use cookies, a lot of cookies, on this long page of ours.</div><div id="main">{}</div>
<aside>Side words that go on and on and on for a while here.</aside><form><label>Name</label><textarea>typed</textarea></form>
<section class="comments"><p>A reader said something rather long about all of this here.</p></section><div class="ad">Buy it now.</div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    body = "<article><h1>Head &eacute;&#33;</h1><p>First <b>bold</b>\n  words&nbsp;here.<br>more<p>Second paragraph of the text, <a href='#'>with a link</a>.<ul><li>one<li>two</ul></article>"
    want = "Head é!\n\nFirst bold words here. more\n\nSecond paragraph of the text, with a link.\n\none\n\ntwo"
    assert main_text(PAGE.format(body)) == want
    assert main_text(PAGE.format(body.replace("article", "div"))) == want
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<body><p>a <b>b<p>c</b> d") == "a b\n\nc d"
    assert main_text("<p title='a > b'>x</p><p attr=\"broken>y") != ""
    assert "é" * 10 in main_text("<div>" * 3000 + "<p>" + "é" * 100_000)


LONG = "".join(f"<p>{f'words of paragraph {k} that go on for some while, '*4}</p>" for k in range(3))
LAYOUTS = [
    f'<body><div class="layout sidebar-right content-sidebar"><div class="c"><h1>T</h1>{LONG}</div><div class="sidebar"><p>side</p></div></div></body>',
    f'<body><div class="with-sidebar sidebar"><h1>T</h1>{LONG}</div><div class="ad">Buy it.</div></body>',
    f'<body><article><div class="entry-header"><h1>T</h1></div>{LONG}</article></body>',
    f'<body><div id="page"><div class="site-header"><h1>Site</h1></div><div class="post"><header><h1>T</h1></header><div class="entry">{LONG}</div></div></div></body>',
    f'<body><article><h1 class="page-header">T</h1>{LONG}<section class="comments"><p>{"a reader says this " * 20}</p></section></article></body>',
    f'<body><nav><a href="/">menu</a></nav><div><h1 id="search">T</h1>{LONG}</div><div class="comment-list">{LONG}{LONG}</div></body>',
    f'<body><div><h1>T</h1><div class="promo"><a href="/a">one</a> <a href="/b">two</a></div>{LONG}<ul><li><a href="/c">three</a></li><li><a href="/d">four</a></li></ul></div></body>',
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_names_dont_veto_the_article(page):
    blocks = main_text(page).split("\n\n")
    assert blocks[0] == "T" and len(blocks) == 4 and all(b.startswith(f"words of paragraph {k}") for k, b in enumerate(blocks[1:]))


def test_ids_inside_an_article_stay():
    page = f'<body><article><h1>T</h1>{LONG}<h2 id="related">R</h2>{LONG}<section id="search"><h2>S</h2>{LONG}</section></article></body>'
    assert main_text(page).count("words of paragraph 0") > 3 * 3 and [b for b in main_text(page).split("\n\n") if len(b) == 1] == ["T", "R", "S"]
    assert main_text(page.replace("article", "div")) == main_text(page)


def test_short_advert_beside_a_shorter_article():
    assert main_text('<body><div class="ad">An advert that is longer than it.</div><div><h1>Title.</h1><p>Short text.</p></div></body>') == "Title.\n\nShort text."


def test_densities_equal_a_plain_count():
    """Composite density from its formula, with characters and tags counted by walking each node's subtree."""
    r = random.Random(12)
    for _ in range(30):
        parts = []
        for _ in range(r.randint(1, 6)):
            tag = r.choice(["p", "div", "section"])
            parts.append(f"<{tag}>{'x ' * r.randint(0, 40)}<a href='#'>{'y' * r.randint(1, 9)}</a><b>{'z' * r.randint(0, 5)}</b></{tag}>")
        page = Page(f"<body><div>{''.join(parts)}</div>{''.join(parts[:2])}</body>")
        n = len(page.tag)
        density, total, chars, links = page.densities([False] * n)
        under = lambda k, top: k == top or (k > 0 and under(page.parent[k], top))
        linked = lambda k: k > 0 and (page.tag[k] == "a" or linked(page.parent[k]))
        size = lambda top, only: sum(len("".join(t.split())) for k, _, t in page.runs if under(k, top) and (not only or linked(k)))
        want = [0.0] * n
        for k in range(1, n):
            c, lc = size(k, False), size(k, True)
            t, lt = (max(1, sum(under(j, k) and j != k and (not only or linked(j)) for j in range(1, n))) for only in (False, True))
            if c:
                base = math.log(c / max(c - lc, 1) * max(lc, 1) + size(0, True) / size(0, False) * c + math.e)
                want[k] = c / t * max(0.0, math.log(c / max(lc, 1) * t / lt)) / math.log(base)
            assert (chars[k], links[k]) == (c, lc)
        assert density == pytest.approx(want)
        assert total == pytest.approx([sum(want[k] for k in range(1, n) if page.parent[k] == up and page.tag[k] in ("p", "div", "section", "body")) for up in range(n)])


def test_equal_densities_take_the_first():
    half = f"<div><h1>T</h1>{LONG}</div>"
    assert main_text(f"<body><div>{half}</div><div>{half}</div></body>").count("words of paragraph 0") == main_text(half).count("words of paragraph 0")


def test_page_texts(spark):
    rows = [(1, "u", "<article><p>é</p></article>", "x"), (2, "u", None, "x"), (2, "u", None, "x")]
    got = sorted(tuple(r) for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [(1, "u", "é", 1), (2, "u", "", 0), (2, "u", "", 0)]
    assert page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _hits(rows, items, window=10):
    out = []
    wins = [(str(i), words_of(t)) for i, t in items]
    for doc_id, text in rows:
        w, hit, found = words_of(text), set(), set()
        for i, p in wins:
            m = min(window, len(p))
            for a in range(len(p) - m + 1 if m else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == p[a : a + m]:
                        hit |= set(range(k, k + m))
                        found.add(i)
        out.append((doc_id, len(w), len(hit), len(found), sha_of(list(found)), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [500_000, 20])
def test_contamination(spark, most):
    r = random.Random(7)
    word = lambda: r.choice("ab")
    items = [(i, " ".join(word() for _ in range(r.randint(8, 14)))) for i in range(6)] + [(10, "Uno DOS"), (11, None), (12, "?!"), (13, "uno dos"), (13, "uno dos"), (2, "z " * 12)]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(30)] + [(50, None), (51, ""), (52, "x uno-dos! y"), (53, "Z " * 11), (54, "é" * 5000), (52, "x uno-dos! y")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(x) for x in contamination(docs, bench, max_windows=most).collect()) == _hits(rows, items)
    assert {x["contaminated"] for x in contamination(docs, bench.limit(0)).collect()} == {False}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(contamination_sql()).fetchall()) == _hits(rows, items)
    nameless = spark.createDataFrame([(None, items[6][1]), (None, None)], "item_id long, text string")
    want = [(*x[:3], 0, sha_of([]), x[5]) for x in _hits(rows, [items[6]])]
    assert sorted(tuple(x) for x in contamination(docs, nameless, max_windows=most).collect()) == want and any(x[5] for x in want)
    assert contamination(docs.limit(0), bench).count() == 0


def test_search_skips():
    p = patterns_of([(1, "a b c d e f g h i j")], 10)[10]
    s = WuManber(p, 10)
    assert s.far == 9 and list(s.search([b"x"] * 40 + words_of("a b c d e f g h i j"))) == [(40, {1})]
