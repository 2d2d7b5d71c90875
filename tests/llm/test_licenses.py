"""Whole licence sentences, near ones and references; Spark and the SQL alike."""

import duckdb
import pandas as pd

from rodada.llm.licenses import KNOWN, license_scan, license_sql

WHOLE = dict(KNOWN)
BSD = f"""Copyright (c) 2020, The Authors. All rights reserved.

{WHOLE["bsd_grant"].capitalize()}:

* {WHOLE["bsd_source"].capitalize()}.
* {WHOLE["bsd_binary"].capitalize()}.
* {WHOLE["bsd_endorse"].capitalize()}.
"""
CASES = [
    (BSD, "BSD-3-Clause"),
    ("Licensed under the MIT License. All rights reserved.", "MIT"),
    ("All rights reserved.", "Proprietary"),
    ("Copyright (c) 2021 X.\nAll rights reserved.", "Proprietary"),
    ("This file isn't licensed under the Apache License, Version 2.0.", ""),
    ("These files aren’t released under the MIT license.", ""),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("Use it under the terms of the MIT License.", "MIT"),
    ("MIT licensed", "MIT"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0 OR MIT"),
    ("// SPDX-License-Identifier: (MIT AND Zlib)", "MIT,Zlib"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later OR (EPL-2.0 and BSL-1.0)\nint x;", "GPL-2.0-or-later,EPL-2.0,BSL-1.0"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"),
    ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1-only"),
    ("Distributed under the Boost Software License, Version 1.0. (See the file.)", "BSL-1.0"),
    (f"{WHOLE['zlib_as_is'].capitalize()}.\n\n{WHOLE['zlib_grant'].capitalize()}:\n\n{WHOLE['zlib_altered'].capitalize()}.", "Zlib"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.", "EPL-2.0"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software\nFoundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    (WHOLE["mit_grant"].replace("person obtaining", "persn obtaining").replace("documentation", "docs").capitalize() + ":\n\n" + WHOLE["mit_notice"].replace("copyright", "copyrigth").capitalize() + ".", "MIT"),
    (WHOLE["mit_grant"].replace("is hereby granted", "is not granted").capitalize() + ".\n\n" + WHOLE["mit_notice"].capitalize() + ".", ""),
    ("Text available under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("x " * 200_000 + "\nLicensed under the MIT License.\n" + "y. " * 100_000, "MIT"),
    (None, ""), ("", ""), ("A word of warranty only.", ""),
]


def test_texts_name_their_licences_in_both_engines(spark):
    rows = [(k, t, "x") for k, (t, _) in enumerate(CASES)] + [(None, "MIT licensed", "y"), (0, CASES[0][0], "z"), (0, CASES[0][0], "z")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert {k: by[k]["licenses"] for k in range(len(CASES))} == {k: want for k, (_, want) in enumerate(CASES)}
    assert len(got) == len(rows) and by[None]["licenses"] == "MIT"
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["doc_id", "text", "ids"]).astype({"doc_id": "Int64"}))
    names = ["doc_id", "n_sentences", "sentence_ids", "licenses", "unmatched"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({license_sql('t')}) x").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got)


def test_every_known_sentence_has_its_identifier(spark):
    rows = [(k, t.capitalize() + ".") for k, (_, t) in enumerate(KNOWN)]
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: n for k, (n, _) in enumerate(KNOWN)}


def test_no_rows(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
