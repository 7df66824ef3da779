"""Statuses, queues, logs and lookups."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import review as R

MAP = "id int, before_id int, after_id int, operation string"


def test_status_and_disagreement(spark):
    ours = spark.createDataFrame([(1, 1, 1, "Identical"), (1, 2, 0, "Delete"), (1, 0, 2, "Insert"), (1, 3, 4, "Update"), (1, 5, 6, "NotYetSet")], MAP)
    assert {r.node_id: r.status for r in R.node_status(ours, ["id"], "before").collect()} == {1: "Matched", 2: "Deleted", 3: "Matched", 5: "Unknown"}
    theirs = spark.createDataFrame([(1, 1, 1, "Identical"), (1, 2, 2, "Update"), (1, 9, 0, "Delete")], MAP)
    assert {(r.before_id, r.our_partner) for r in R.disagreement(ours, theirs, ["id"]).collect()} == {(2, 0), (9, None)}


def test_removals_are_inherited(spark):
    marks = spark.createDataFrame([(1, 2, 0, "DeleteWithChildren"), (1, 3, 7, "Identical")], MAP)
    nodes = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (1, 4, 1)], "id int, node_id int, size int")
    got = {r.before_id: r.operation for r in R.with_inherited_removals(marks, nodes, ["id"]).collect()}
    assert got == {2: "Delete", 3: "Identical", 4: "Delete"}


@pytest.mark.parametrize(("query", "want"), [("AB", {1: 3, 3: 5, 5: 1, 6: 1}), ("zz", {1: 6, 3: 6, 5: 6, 6: 6}), ("", dict.fromkeys((1, 3, 5, 6)))])
def test_next_matches(spark, query, want):
    df = spark.createDataFrame([("g", 1, "ab"), ("g", 3, "xAby"), ("g", 5, "ab"), ("g", 6, "zz")], "g string, n int, t string")
    assert {r.n: r.next for r in R.next_matches(df, ["g"], "n", F.col("t"), query).collect()} == want


def test_queue_and_log(spark):
    lines = spark.createDataFrame([(1, "# c"), (2, ""), (3, "case\tb1 a2\tnote\tmore"), (4, "case\tb1"), (5, "bad"), (6, "case\tb1")], "n int, l string")
    assert [(r.case, r.note) for r in R.review_queue(lines.orderBy("n"), "l").collect()] == [("case", "note\tmore"), ("case", None), ("case", None)]
    assert sorted(r.n for r in R.without_first(lines, "l", "n", "case\tb1").collect()) == [1, 2, 3, 5, 6]
    log = spark.createDataFrame([("5\tc\tm\tk\t1",), ("7\tc\tm\tk\t0",), ("noise",)], "l string")
    assert [tuple(r) for r in R.key_log(log, "l").collect()] == [("m", "k", 2, 1, 12)]


def test_lookup_fails_on_unknown_names(spark):
    df = spark.createDataFrame([("cpu a",), ("cpu b",)], "k string")
    assert R.looked_up(df, "k", {"cpu a": "x", "cpu b": "y"}).filter("name = 'x'").count() == 1
    with pytest.raises(Exception, match="not registered"):
        R.looked_up(df, "k", {"cpu a": "x"}).collect()


def test_rules(spark):
    df = spark.createDataFrame([("a", "b", True, True, True, False), ("a", "a", True, True, False, False), ("a", "b", False, True, True, False), ("a", "b", False, True, True, True)], "x string, y string, lx boolean, ly boolean, p boolean, e boolean")
    rule = R.cross_kind_rule(*(F.col(c) for c in ("x", "y", "lx", "ly", "p", "e")))
    assert [r[0] for r in df.select(rule).collect()] == ["leaves_in_place", "same", "refused", "error_region"]
    assert df.select(R.reason_bucket(F.lit("Engine:deep"))).first()[0] == "Engine"


def test_dump(spark):
    df = spark.createDataFrame([(1, 1, 0, "unit", ""), (1, 2, 1, "name", "x")], "id int, node_id int, depth int, kind string, text string")
    assert [r.line for r in R.tree_dump(df, ["id"]).orderBy("node_id").collect()] == ["unit", "  name x"]
