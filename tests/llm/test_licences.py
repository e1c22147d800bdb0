"""Licences of headers, files and directories."""

import pytest
from pyspark.sql import functions as F

from streamloom.llm import licences

FILES = [
    ("a/LICENSE", "Released under the MIT License.", 1),
    ("a/x.c", "no header", 2),
    ("a/b/y.c", "Some text\nThis work is licensed under the GNU General Public License, version 3.\nmore", 3),
    ("a/b/c/z.c", None, 4),
    ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0", 5),
    ("other/w.c", "", 6),
    (None, "Licensed&&& under*** CC### BY-NC%%% 4.0.$$$", 7),
    ("a/b/c/d/long.c", "word " * 50_000 + "\nLicensed under CC BY 4.0.", 8),
    ("ab/v.c", "we licensed nothing of the sort to anybody at all, ever, in any place", 9),
    ("root.c", "x", 10),
    ("a/b/c/z.c", None, 4),
]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "path string, text string, doc_id int, licence string")
    return [tuple(r) for r in licences.scan(df, F.col("path"), F.col("text"), ["doc_id"]).orderBy("doc_id").select("doc_id", "licence", "origin", "via").collect()]


def test_nearest_ancestor(spark):
    assert run(spark, FILES) == [
        (1, "MIT", "file", None),
        (2, "MIT", "directory", "a"),
        (3, "GPL-3.0", "header", None),
        (4, "Apache-2.0", "directory", "a/b"),
        (4, "Apache-2.0", "directory", "a/b"),
        (5, "Apache-2.0", "file", None),
        (6, None, None, None),
        (7, "CC-BY-NC-4.0", "header", None),
        (8, "CC-BY-4.0", "header", None),
        (9, None, None, None),
        (10, None, None, None),
    ]


def test_a_licence_at_the_root(spark):
    assert run(spark, [("COPYING", "Licensed under CC BY-SA 4.0", 1), ("q/r/s.c", None, 2)]) == [(1, "CC-BY-SA-4.0", "file", None), (2, "CC-BY-SA-4.0", "directory", "")]
    assert run(spark, []) == []


def texts(spark, *found):
    """Licence and similarity of texts in files that are no licence files."""
    df = spark.createDataFrame(list(enumerate(found)), "n int, t string")
    return [(r.licence, r.similarity) for r in licences.scan(df, F.concat(F.lit("src/"), "n"), F.col("t"), ["n"]).orderBy("n").collect()]


def test_templates_find_themselves(spark):
    got = texts(spark, *(t for _, t in licences.TEMPLATES))
    assert [n for n, _ in got] == [n for n, _ in licences.TEMPLATES] and all(x > 0.999 for _, x in got)


def test_identifiers(spark):
    tag = "/* SPDX-License-Identifier: "
    assert texts(spark, tag + "MIT */", tag + "Apache-2.0", tag + "GPL-3.0-or-later", tag + "gpl-2.0-only", tag + "(LGPL-2.1+ OR MIT)", tag + "Nothing-1.0") == [("MIT", 1.0), ("Apache-2.0", 1.0), ("GPL-3.0", 1.0), ("GPL-2.0", 1.0), ("LGPL-2.1", 1.0), (None, None)]


NOTICE = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version {v} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() {{ return 0; }}
"""


def test_wrapped_notices_and_prose(spark):
    prose = "We met in the old town and talked of many things, of ships and of shoes, " * 30
    found = [
        NOTICE.format(v=2), NOTICE.format(v=3), "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C)", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1",
        prose + "The code is released under the MIT License. " + prose, prose + "you may use it, licensed\nunder the Apache\nLicense,\nVersion 2.0, if you like. " + prose, "x " * 100_000 + "Licensed under CC BY-SA 4.0" + " y" * 100_000,
        prose + " licence to kill " + prose, "Sie kam mit dem Zug, mit der Bahn und mit Lizenz. Her licence, mit Hund.", "the license of the public domain",
    ]
    assert [n for n, _ in texts(spark, *found)] == ["GPL-2.0", "GPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MIT", "Apache-2.0", "CC-BY-SA-4.0", None, None, None]


def test_files_as_a_whole_ties_and_clashing_names(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [("a/LICENSE", f"MIT License\n\nCopyright (c) 2020 Some Body\n\n{mit}", 1), ("a/b/c.py", "import os", 2), ("a/b/LICENCE.md", "Released under the MIT License. Licensed under CC BY 4.0", 3), ("a/b/d.py", "", 4), ("a/b/d.py", "", 4)]
    got = run(spark, rows)
    assert got[0] == (1, "MIT", "file", None) and got[2][1:3] in {("MIT", "file"), ("CC-BY-4.0", "file")}
    assert [g[1:] for g in got if g[0] in (2, 4)] == [(got[2][1], "directory", "a/b")] * 3
    # Both lines are whole templates: the one of more words holds, and of equal ones the last by name.
    between = ". " + "word " * 50
    assert texts(spark, "Released under the MIT License" + between + "Licensed under CC BY 4.0") == [("CC-BY-4.0", 1.0)]
    assert texts(spark, "Licensed under CC BY-SA 4.0" + between + "Licensed under CC BY-NC 4.0") == [("CC-BY-SA-4.0", 1.0)]
    with pytest.raises(ValueError):
        licences.scan(spark.createDataFrame([("a", "b", "c")], "path string, text string, licence string"), F.col("path"), F.col("text"), ["path", "Licence"])
    with_key = spark.createDataFrame([("a/b", "Licensed under CC BY 4.0", 5)], "path string, text string, key int")
    assert licences.scan(with_key, F.col("path"), F.col("text"), ["key"]).first()[:2] == (5, "CC-BY-4.0")


@pytest.mark.parametrize("name", ["op5_licences", "licence_inheritance"])
def test_query_against_sql(spark, name):
    import duckdb

    from streamloom.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    found = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_query_inherits_where_sources_name_licence_files(spark, tmp_path):
    """No path that op5_licences makes up of the given tables names a licence file; sources of rows without an id may."""
    import duckdb

    from streamloom.llm import queries

    rows = [
        (None, "Released under the MIT License.", None, "repo/LICENSE"), (None, "Licensed under CC BY 4.0", None, "repo/en/COPYING.txt"),
        (1, "x", "en", "repo"), (2, "x", "de", "repo"), (3, None, "de", "other"), (4, "Licensed under the Apache License, Version 2.0.", "en", "repo"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op5_licences(spark, str(tmp_path)).select("doc_id", "licence", "similarity", "origin", "via").collect()]
    assert sorted((r for r in found if r[0]), key=lambda r: r[0]) == [(1, "CC-BY-4.0", 1.0, "directory", "repo/en"), (2, "MIT", 1.0, "directory", "repo"), (3, None, None, None, None), (4, "Apache-2.0", 1.0, "header", None)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(repr, found)) == sorted(map(repr, con.execute(queries.oracle_sql()["op5_licences"]).fetchall()))


def test_query_compares_licence_files_as_a_whole(spark, tmp_path):
    """The title of a licence file lies outside its best stretch: as a whole it has more words and is less similar. Other files have stretches alone."""
    import duckdb

    from streamloom.llm import queries

    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 500)
    text = f"MIT License\n\nCopyright (c) 2020 Some Body\n\n{mit}"
    spark.createDataFrame([(None, text, None, "repo/LICENSE"), (1, text, "en", "other"), (2, "x", "en", "repo")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op5_licences(spark, str(tmp_path)).select("doc_id", "licence", "similarity", "origin", "via").collect()]
    assert sorted(found, key=lambda r: r[0] or 0) == [(None, "MIT", 0.958516, "file", None), (1, "MIT", 1.0, "header", None), (2, "MIT", 0.958516, "directory", "repo")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(repr, found)) == sorted(map(repr, con.execute(queries.oracle_sql()["op5_licences"]).fetchall()))
