"""Bytes as text, CSV, line protocols, languages, and streams that keep the latest."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tallyweave import session
from tallyweave.functions import languages, text
from tallyweave.operators import review
from tallyweave.sources import files
from tallyweave.streaming import census


def test_bytes_as_text(spark):
    rows = {"ascii": b"plain", "utf8": "zürich".encode(), "mark": b"\xef\xbb\xbfx", "latin": b"z\xfcrich", "zero": b"a\0b", "le": b"\xff\xfe" + "hé😀".encode("utf-16-le"), "be": b"\xfe\xff" + "hé".encode("utf-16-be"), "odd": b"\xff\xfea", "empty": b"", "null": None}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "name string, c binary")
    got = {r.name: r for r in df.select("name", files.as_text("c").alias("t"), files.decoded_text(F.col("c")).alias("d"), files.decoded_text(F.col("c"), True).alias("l"), files.is_binary(F.col("c")).alias("b")).collect()}
    assert got["latin"].t is None and got["utf8"].t == "zürich" and got["empty"].t == "" and got["null"].t is None
    assert {k: got[k].d for k in rows} == {"ascii": "plain", "utf8": "zürich", "mark": "x", "latin": None, "zero": None, "le": "hé😀", "be": "hé", "odd": None, "empty": "", "null": None}
    assert got["latin"].l == "zürich"
    assert {k for k in rows if got[k].b} == {"zero"}


def test_csv_there_and_back(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nof two lines', 1.5), (2, None, None), (3, "", 0.0)]
    df = spark.createDataFrame(rows, "id int, t string, x double")
    files.write_csv(df, str(tmp_path / "out"), ["id", "t", "x"], ["id"])
    back = files.read_csv(spark, str(tmp_path / "out"), "id int, t string, x double").orderBy("id").collect()
    assert [(r.id, r.t or "", r.x) for r in back] == [(i, t or "", x) for i, t, x in rows]
    (tmp_path / "bad.csv").write_text("id,x\n1,2.0\nno,3.0\n")
    loose = files.read_csv(spark, str(tmp_path / "bad.csv"), "id int, x double", strict=False).cache()
    assert [r._corrupt for r in loose.filter("_corrupt is not null").collect()] == ["no,3.0"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, str(tmp_path / "bad.csv"), "id int, x double").collect()


def test_line_protocols(spark):
    lines = spark.createDataFrame([("a/b.rs\n",), ("",), ("x.unknown",), (None,)], "line string")
    got = [r.answer for r in files.line_requests(lines, "line", languages.language_of).collect()]
    assert got == ["a/b.rs\tRust", None, "x.unknown\t", None]
    asked = spark.createDataFrame([('{"id": 1, "n": 4}',), ('{"id": 2, "n": 0}',), ("junk",), (None,)], "q string")
    replies = [json.loads(r.reply) for r in files.json_requests(asked, "q", lambda r: 12 // r["n"]).collect()]
    assert replies[0] == {"id": 1, "result": 3} and replies[1]["error"].startswith("ZeroDivisionError") and replies[2]["id"] is None and "error" in replies[3]


def test_languages(spark):
    df = spark.createDataFrame([("a/B.PY", "x"), ("t/x.ts", "let a"), ("t/x.ts", "<?xml"), ("t/x.ts", None), ("Makefile", ""), ("src\\a.go", ""), ("noext", ""), ("", ""), (None, "")], "p string, c string")
    got = [r[0] for r in df.select(languages.language_of(F.col("p"), F.col("c"))).collect()]
    assert got == ["Python", "TypeScript", None, "TypeScript", "Make", "Go", None, None, None]


def test_offsets(spark):
    df = spark.createDataFrame([("aé😀b", i) for i in (-1, 0, 1, 2, 3, 4, 5, 6)], "t string, o int")
    assert [r[0] for r in df.select(text.utf16_to_byte(F.col("t"), F.col("o"))).collect()] == [None, 0, 1, 3, None, 7, 8, None]


def test_edits_of_commits(spark):
    lines = spark.createDataFrame([("c1", "1\t2\ta.rs"), ("c1", "-\t-\tp.png"), ("c2", "3\t0\tb.rs"), ("c3", "1\t1\tc.rs")], "commit string, line string")
    commits = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 1)], "commit string, parents int")
    shallow = spark.createDataFrame([("c3",)], "commit string")
    got = files.code_edits(files.numstat(lines, "line", ["commit"]), commits, ["commit"], "parents", shallow)
    assert [(r.commit, r.path, r.added, r.removed) for r in got.collect()] == [("c1", "a.rs", 1, 2)]


def test_history_from_objects(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()

    def git(*args):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (repo / "a b.txt").write_text("one\ntwo\nthree\nfour\n")
    (repo / "bin").write_bytes(b"\0\1")
    git("add", ".")
    git("commit", "-qm", "first")
    git("checkout", "-qb", "side")
    git("mv", "a b.txt", "zürich.txt")
    (repo / "zürich.txt").write_text("one\ntwo\nthree\nfour\nfive\n")
    git("commit", "-qam", "second")
    git("checkout", "-q", "main")
    (repo / "c").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "third")
    git("merge", "-q", "--no-ff", "-m", "merged", "side")
    repos = spark.createDataFrame([(str(repo),), (str(tmp_path / "none"),)], "path string")
    rows = files.commit_history(repos, "path").collect()
    changes = {(r.change_type[0], r.old_path, r.path, r.added, r.removed) for r in rows if r.path}
    assert changes == {("A", None, "a b.txt", 4, 0), ("A", None, "bin", None, None), ("R", "a b.txt", "zürich.txt", 1, 0), ("A", None, "c", 1, 0)}
    assert sorted(r.parents for r in rows if r.error is None and r.path is None) == [2]
    assert sum(r.error is not None for r in rows) == 1
    assert {r.parents for r in files.commit_history(repos.limit(1), "path", most=1).collect()} == {2}


def test_queue_counts(spark):
    queue = review.review_queue(spark.createDataFrame([("one\tb1 a2\tnote",), ("one\tb3",), ("# no",), ("two",)], "line string"), "line")
    cases = spark.createDataFrame([("one",), ("three",)], "case string")
    assert {r.case: r.waiting for r in review.queue_counts(queue, cases).collect()} == {"one": 2, "three": 0}


def test_latest_by_a_pointer(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "t")
    schema = "k string, g int, v string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = census.arriving(spark, folder, spark.createDataFrame([], schema).schema)
        census.keep_latest(stream, table, ["k"], "g").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {r.k: r.v for r in census.latest(spark, table).collect()}

    with pytest.raises(ValueError):
        census.latest(spark, table)
    assert feed([("a", 2, "new"), ("b", 1, "b")]) == {"a": "new", "b": "b"}
    assert feed([("a", 1, "late"), ("c", 1, "c")]) == {"a": "new", "b": "b", "c": "c"}
    name = open(os.path.join(table, census.POINTER)).read()
    os.rename(os.path.join(table, name), os.path.join(table, "gone"))
    with pytest.raises(Exception):  # noqa: B017 - a lost folder is no empty history
        feed([("d", 1, "d")])


def test_spreading_is_a_setting(spark):
    df = spark.range(10).repartition(1)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set(session.SPREAD_SETTING, "0")
    try:
        assert session.spread(df).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(session.SPREAD_SETTING)
