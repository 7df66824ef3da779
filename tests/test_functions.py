"""Scalar functions, schemas and hunks."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import hunks, paths, schemas, text
from tallyweave.operators import sketches


def value(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expression).first()[0]


@pytest.mark.parametrize(("path", "key"), [("a/B.RS", "rs"), ("x/app.min.js", "min.js"), (".gitignore", "gitignore"), ("a/Makefile", "makefile"), ("a.b/c.tar.gz", "gz"), ("x/y.", "y")])
def test_extension_key(spark, path, key):
    assert value(spark, paths.extension_key(F.col("p")), p=path) == key


@pytest.mark.parametrize(("path", "old", "new"), [("a/{b => c}/d.rs", "a/b/d.rs", "a/c/d.rs"), ("x.c => y/z.c", "x.c", "y/z.c"), ("a/{ => b}/c", "a/c", "a/b/c"), ("plain.py", "plain.py", "plain.py")])
def test_renames(spark, path, old, new):
    assert (value(spark, paths.renamed_from(F.col("p")), p=path), value(spark, paths.renamed_to(F.col("p")), p=path)) == (old, new)


def test_labels(spark):
    assert value(spark, paths.label_of_tip(F.col("p")), p="Code (by name)") == "Code"
    assert value(spark, paths.label_of_tip(F.col("p")), p=None) == "Unknown"
    assert value(spark, paths.category(F.col("p")), p="a/b.toml") == "Configuration"
    assert value(spark, paths.is_anomalous(F.col("p")), p="a/third_party/x.js")
    assert not value(spark, paths.is_anomalous(F.col("p")), p="src/party.rs")
    assert value(spark, paths.top_folder(F.col("p")), p="a//./b/c") == "a"


@pytest.mark.parametrize(("t", "read", "split"), [("", 0, 1), ("a", 1, 1), ("a\n", 1, 2), ("a\n\nb", 3, 3), ("\n", 1, 2)])
def test_line_rules(spark, t, read, split):
    assert (value(spark, text.lines_read(F.col("t")), t=t), value(spark, text.lines_split(F.col("t")), t=t)) == (read, split)


@pytest.mark.parametrize(("n", "bucket"), [(9, "0-10"), (10, "10-30"), (29, "10-30"), (30, "30-100"), (2999, "1000-3000"), (3000, "3000+"), (None, None)])
def test_buckets(spark, n, bucket):
    df = spark.createDataFrame([(n, 5)], "n int, m int")
    assert df.select(text.size_bucket(F.col("n"))).first()[0] == bucket
    assert df.select(text.pair_bucket(F.col("m"), F.col("n"))).first()[0] == bucket


def test_words_and_widths(spark):
    assert value(spark, F.array_sort(text.word_set(F.col("t"), ["use"])), t="Use a::B, b") == ["a", "b"]
    assert value(spark, text.shares_no_word(F.col("a"), F.col("b")), a="x y", b="z")
    assert value(spark, text.display_width(F.col("t")), t="a\tbc漢") == 8
    assert value(spark, text.leading_blanks(F.col("t")), t=" \tx ") == 2
    assert value(spark, text.thousands(F.col("t").cast("int")), t="1234567") == "1{,}234{,}567"


def test_hunk_lines(spark):
    df = spark.createDataFrame([(1, "@@ -5,0 +6,2 @@\n@@ -9 +11 @@ f()"), (2, None), (3, "none")], "id int, p string")
    got = {(r.id, r.side, r.line) for r in hunks.touched_lines(df, "p", ["id"]).collect()}
    assert got == {(1, "after", 6), (1, "after", 7), (1, "before", 9), (1, "after", 11)}


def test_other_tools(spark):
    chunks = '{"chunks":[[{"lhs":{"line_number":3,"changes":[]},"rhs":{"line_number":4,"changes":[{"start":0,"end":2}]}}]]}'
    parts = '{"hunks":[{"Old":[{"line_index":1}]},{"New":[{"line_index":2},{"line_index":3}]}]}'
    df = spark.createDataFrame([(1, chunks, parts)], "id int, a string, b string")
    assert {(r.side, r.line) for r in hunks.touched_in_chunks(df, "a", ["id"]).collect()} == {("before", 3), ("after", 4)}
    assert {(r.side, r.line) for r in hunks.touched_in_hunks(df, "b", ["id"]).collect()} == {("before", 1), ("after", 2), ("after", 3)}


def test_schema_violations():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 1}}, "b": {"type": ["string", "null"]}}}
    assert schemas.violation({"a": [1, 2], "b": None}, s) is None
    assert schemas.violation({"a": [1, 0]}, s) == "$.a[1]"
    assert schemas.violation({}, s) == "$.a"
    assert schemas.violation({"a": [], "c": 1}, s) == "$.c"
    assert schemas.violation({"a": [True]}, s) == "$.a[0]"
    with pytest.raises(ValueError):
        schemas.violation(1, {"pattern": "x"})


def test_sketches(spark):
    df = spark.createDataFrame([(list(range(40)), list(range(20, 60))), ([1, 2], [2, 3]), ([], [])], "a array<bigint>, b array<bigint>")
    s = df.select(sketches.similarity(sketches.sketch_of(F.col("a")), sketches.sketch_of(F.col("b")))).collect()
    assert [x[0] for x in s] == [0.0, pytest.approx(1 / 3), 0.0]
    whole = df.select(sketches.sketch_of(F.concat("a", "b")), sketches.merged(sketches.sketch_of(F.col("b")), sketches.sketch_of(F.col("a")))).collect()
    assert all(x[0] == x[1] for x in whole)
