"""License scans: variants of known texts, and the SQL on a whole table."""

from pathlib import Path

import duckdb
from strandline.llm import license_scan as ls

SF = "/root/testdata/sf0.01"


def test_variants(spark):
    mit = dict(ls.TEXTS)["MIT"]
    wrapped = "MIT\n".join([""]) + "Copyright (c) 2020 Some One\n\n" + mit.replace(". ", ".\n").replace("sublicense", "sub-license").upper().replace('"', "“")
    rows = [(1, mit), (2, wrapped), (3, "Intro.\nreleased  under the M.I.T. licence\nmore"), (4, "Intro.\nReleased under the MIT licence!\nmore"), (5, None), (6, ""), (7, "\n \n"),
            (8, "Text before.\n\n" + dict(ls.TEXTS)["BSD-3-Clause"].replace(". ", ".\n") + "\n\nLicensed under CC BY-NC 4.0."), (9, "SPDX-License-Identifier: GPL-3.0-only"), (9, "other"), (10, mit + " not quite"), (None, "Licensed under the Apache Licence, version 2.0"), (11, "x " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as mark", "text as lines", "2 as part")
    found = [tuple(r) for r in ls.license_scan(docs).collect()]
    assert len(found) == len(rows)
    by = {r[0]: r[1:] for r in found if r[0] != 9}
    assert by[1] == ("MIT", 1, "MIT") and by[2][0] == "MIT"
    assert by[3] == (None, 0, "") and by[4] == (None, 1, "MIT")
    assert by[5] == by[6] == by[7] == by[10] == by[11] == (None, 0, "")
    assert by[8] == (None, 2, "BSD-3-Clause,CC-BY-NC-4.0")
    assert by[None] == ("Apache-2.0", 1, "Apache-2.0")
    assert sorted((r[1] or "") for r in found if r[0] == 9) == ["", "GPL-3.0-only"]
    assert ls.license_scan(docs.where("false")).count() == 0


def test_full_texts(spark):
    """Titled files, whole licences, texts of several paragraphs amid others, names after a clause."""
    mit = dict(ls.TEXTS)["MIT"]
    parts = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    assert parts.count("\n\n") == 2
    file = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + parts
    kept = {p.stem: p.read_text() for p in (Path(ls.__file__).parent / "licenses").glob("*.txt")}
    rows = [(1, file), (2, "Some code.\n\n" + parts + "\n\nMore of it."), (3, "MIT License"), (4, "Copyright 2020 A. B. Inc. All rights reserved. Licensed under the MIT License."), (5, "(c) 2021 X, MIT License"),
            (6, "Intro " + parts), (7, parts + " and more"), (8, "Mit."), (9, "Copyright (c) 2020 MIT License Team"), (10, "\n" * 200_000 + parts), (11, "Copyright 2020 Some One Inc. and others\n" + mit),
            (12, kept["Apache-2.0"].split("APPENDIX")[0]), (13, "Use of these:\n\n" + kept["GPL-3.0-only"] + "\n\n" + kept["Unlicense"])]
    rows += [(100 + k, text) for k, (_, text) in enumerate(sorted(kept.items()))]
    by = {r[0]: tuple(r)[1:] for r in ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[1] == by[3] == by[4] == by[5] == by[10] == by[11] == ("MIT", 1, "MIT")
    assert by[2] == (None, 1, "MIT")
    assert by[6] == by[7] == by[8] == by[9] == (None, 0, "")
    assert by[12][0] == "Apache-2.0" and by[13] == (None, 2, "GPL-3.0-only,Unlicense")
    assert [by[100 + k][0] for k in range(len(kept))] == sorted(kept)


def test_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(ls.license_scan_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in ls.license_scan(docs).collect()), key=str)
    assert got == want
    assert sum(r[2] for r in got) > 10
