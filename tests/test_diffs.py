"""Line and tree diffs, archives and members."""

import bz2
import gzip
import io
import lzma
import random
import sqlite3
import tarfile
import zipfile

import pytest

from tallyweave.operators import linediff as L
from tallyweave.operators import treediff as D
from tallyweave.operators import trees as T
from tallyweave.sources import archives, files


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_lines_are_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        k = L.common_lines(a, b)
        assert len(k) == longest(a, b) and all(a[i] == b[j] for i, j in k) and k == sorted(k)


@pytest.mark.parametrize("kept", [256, 1])
def test_long_lists_are_halved_exactly(monkeypatch, kept):
    monkeypatch.setattr(L, "MOST_CELLS", 6)
    monkeypatch.setattr(L, "KEPT_MASKS", kept, raising=False)
    unique_but_out_of_order = ["u", *"abcdef"], [*"abcdef", "u"]
    rng = random.Random(2)
    for a, b in [unique_but_out_of_order, unique_but_out_of_order[::-1], *(([rng.randrange(n) for _ in range(rng.randrange(40))] for _ in range(2)) for n in (2, 4, 30) for _ in range(100))]:
        k = L.common_lines(a, b)
        assert len(k) == longest(a, b) and all(a[i] == b[j] for i, j in k)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(k, k[1:], strict=False))


def test_three_lines_rotated():
    left, right = L.classify("a\nb\nc", "b\nc\na")
    assert [x[1] for x in left] == ["moved", "kept", "kept"] and [x[1] for x in right] == ["kept", "kept", "moved"]


def test_heaviest_chain():
    assert L.heaviest_in_order([(0, 2), (1, 0), (2, 1), (3, 3)], [5, 1, 1, 1]) == [0, 3]


def test_multiset(spark):
    rows = [(1, "a\nb\na\n", "a\nc"), (2, "", ""), (3, None, "x"), (4, "x", "x")]
    df = spark.createDataFrame(rows, "id int, b string, a string")
    got = {r.id: (r.kept, r.deleted, r.inserted) for r in L.multiset_diff(df, "id", "b", "a").collect()}
    assert got == {1: (1, 2, 1), 2: (0, 0, 0), 3: (0, 0, 1), 4: (1, 0, 0)}


def test_reconcile_takes_the_smaller_account(spark):
    row = "id int, row_before int, row_after int"
    before = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (2, 1, 1)], row)
    after = spark.createDataFrame([(1, 9, 9), (2, 5, 5)], row)
    got = {(r.id, r.row_before) for r in L.reconcile_moves(before, after, "id").collect()}
    assert got == {(1, 9), (2, 1)}


def test_islands(spark):
    df = spark.createDataFrame([(1, 0, 2, "x"), (1, 2, 3, "x"), (1, 5, 6, "x"), (1, 3, 4, "y")], "id int, s int, e int, op string")
    assert {(r.op, r.s, r.e) for r in L.islands(df, ["id"], "s", "e", "op").collect()} == {("x", 0, 3), ("x", 5, 6), ("y", 3, 4)}


def tree(text):
    return T.token_tree(text)


@pytest.mark.parametrize(("a", "b"), [("", ""), ("x;", ""), ("f(a, b);", "f(b, a);"), ("use a;\nuse b;", "use c.d;\nx = 1;"), ("log(1);\nlog(1);", "log(1);")])
def test_every_node_has_one_decision(a, b):
    rows = D.diff_trees(tree(a), tree(b))
    assert sorted(x[0] for x in rows if x[0]) == list(range(1, len(tree(a)) + 1))
    assert sorted(x[1] for x in rows if x[1]) == list(range(1, len(tree(b)) + 1))


def test_equal_trees_cost_nothing():
    t = tree("fn f() {\n  a(1);\n  b(2);\n}\n")
    rows = D.diff_trees(t, t)
    assert {x[2] for x in rows} == {"Identical"} and sum(x[4] for x in rows) == 0


def forest_distance(a, b, xs, ys):
    """The recursive definition, from the right."""
    if not xs and not ys:
        return 0
    if not xs:
        return sum(b.size[y] for y in ys)
    if not ys:
        return sum(a.size[x] for x in xs)
    x, y = xs[-1], ys[-1]
    return min(
        forest_distance(a, b, xs[:-1] + a.children[x], ys) + 1,
        forest_distance(a, b, xs, ys[:-1] + b.children[y]) + 1,
        forest_distance(a, b, xs[:-1], ys[:-1]) + forest_distance(a, b, a.children[x], b.children[y]) + ((a.kind[x], a.text[x]) != (b.kind[y], b.text[y])),
    )


def test_edit_distance_against_its_definition():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (T.json_tree(str([rng.choice([1, 2, [3], [1, [2]]]) for _ in range(rng.randrange(1, 4))])) for _ in range(2))
        assert D.edit_distance(a, b) == forest_distance(a, b, [1], [1])


def test_no_tree_is_no_error():
    assert {x[2] for x in D.diff_trees(None, tree("a;"))} == {"Insert"}
    assert D.diff_trees(None, None) == []


def test_greedy_ties_limits_and_single_use():
    got = D.greedy_assignment([1, 2, 3], [10, 20], key=lambda _: 0, cost=lambda a, b: abs(a - 2), most=1)
    assert got == [(2, 10), (1, 20)]


def test_unrelated_imports_come_apart():
    d = D.PairDiff(tree("use a.b;"), tree("use c.d;"))
    d.pair(1, 1, "x")
    d.pair(2, 2, "x")
    d.unrelated_imports()
    assert d.to == {1: 1}


def test_permuted_leaves_find_their_twins():
    a, b = tree("x y z"), tree("y z x")
    d = D.PairDiff(a, b)
    for i in range(1, 6):
        d.pair(i, i, "x")
    d.permuted_leaves()
    assert all(a.text[x] == b.text[y] for x, y in d.to.items())


def solved(a, b):
    d = D.PairDiff(tree(a), tree(b))
    for name in D.PairDiff.PASSES:
        getattr(d, name)()
    return d


def test_declarations_find_their_names():
    d = solved("fn f(a) {\n x1;\n x2 + 1;\n}\nfn g(b) {\n y1;\n}\n", "fn g(c, d) {\n z1(2);\n}\nfn f(q, e, r) {\n w1;\n}\n")
    assert {"QualifiedName"} <= set(d.why.values())
    names = {d.a.text[d.a.children[x][1]]: d.b.text[d.b.children[d.to[x]][1]] for x, why in d.why.items() if why == "QualifiedName"}
    assert names == {"f": "f", "g": "g"}


def test_copies_are_one_to_many():
    d = solved("call(a, b);\nother = 1;\n", "call(a, b);\nother = 1;\ncall(a, b);\n")
    assert [len(ys) for _, ys in d.extra_copies()] == [2]


def test_passes_decide_as_named():
    d = D.PairDiff(tree("a ; b ;"), tree("a ; b ;"))
    for i in range(1, len(d.a) + 1):
        d.pair(i, i, "x")
    d.stray_terminators()
    d.stray_renames()
    assert len(d.to) == len(d.a)
    e = D.PairDiff(tree("f(old_value, 1);"), tree("f(2, new_value);"))
    e.pair(1, 1, "x")
    e.unique_type()
    assert e.to[2] == 2


def nodes(spark, text):
    df = spark.createDataFrame([(1, text, "Go")], "id int, t string, l string")
    return T.nodes(df, "t", "l", ["id"])


def test_paths_of_any_depth(spark):
    df = spark.createDataFrame([(1, "[" * 200 + "]" * 200, "Json"), (2, '{"a": [1, 2, "x"]}', "Json"), (3, "(" * 90 + ")" * 90, None)], "id int, t string, l string")
    n = T.nodes(df, "t", "l", ["id"])
    paths = {(r.id, r.node_id): r.path for r in T.node_paths(n, ["id"]).collect()}
    assert len(paths) == n.count() and paths[1, 200] == "/".join(["array:1"] * 199)
    assert [paths[2, i] for i in range(1, 7)] == ["", "pair:1", "pair:1/array:1", "pair:1/array:1/number:1", "pair:1/array:1/number:2", "pair:1/array:1/string:1"]


def test_tree_queries_take_every_file(spark, tmp_path):
    from tallyweave.plans import diff_queries as Q

    rows = [(1, "Go", "a.go", "f(b , c)"), (2, "Json", "a.json", '{"a" : 1}'), (3, None, "b.json", '{"a": [1]}'), (4, None, "x", "g(a  , b)")]
    spark.createDataFrame(rows, "file_id bigint, language string, path string, content string").write.parquet(f"{tmp_path}/file_contents.parquet")
    assert {r.file_id: r.nodes for r in Q.tree_node_paths(spark, str(tmp_path)).collect()} == {1: 9, 2: 3, 3: 4, 4: 9}
    assert {r.kind: r.gap_characters for r in Q.tree_gaps(spark, str(tmp_path)).collect()}["statement"] == 6


def test_node_operators(spark):
    n = nodes(spark, "a;\nf(b, c);\n").cache()
    paths = {r.node_id: r.path for r in T.node_paths(n, ["id"]).collect()}
    assert paths[1] == "" and paths[2] == "statement:1" and all(paths.values() if False else [True])
    near = {r.node_id: r.ancestor_id for r in T.nearest_marked_ancestor(n.selectExpr("*", "kind = 'statement' as m"), ["id"], "m").collect()}
    kinds = {r.node_id: (r.kind, r.parent_id) for r in n.collect()}
    assert all(near[i] is None or kinds[near[i]][0] == "statement" for i in near)
    shown = T.visible_rows(n, ["id"], n.kind == "parens", n.kind == "mark")
    assert [r.row for r in shown.orderBy("node_id").collect()] == list(range(shown.count()))
    solved = {r.node_id: r.solved for r in T.fully_solved(n.selectExpr("*", "kind <> 'name' as d"), ["id"], "d").collect()}
    assert not solved[1] and all(solved[i] == (k != "name") for i, (k, _) in kinds.items() if k in ("name", "mark"))


def test_unique_and_zip(spark):
    s = "k string, id int, o int"
    b = spark.createDataFrame([("x", 1, 0), ("y", 2, 0), ("y", 3, 1), ("z", 4, 0), ("z", 5, 1)], s)
    a = spark.createDataFrame([("x", 11, 0), ("y", 12, 5), ("y", 13, 1), ("z", 14, 0)], s)
    assert [tuple(r) for r in T.unique_key_matches(b, a, ["k"], "id").collect()] == [("x", 1, 11)]
    assert {(r.before_id, r.after_id) for r in T.equal_count_zip(b, a, ["k"], "id", "o").collect()} == {(1, 11), (2, 13), (3, 12)}


def packed(kind, body):
    if kind == "tar":
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in body.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in body.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    tar, zipped = packed("tar", {"a": b"1", "b/c": b"22"}), packed("zip", {"a": b"1", "d/": b""})
    assert [m[0] for m in archives.members(tar)[1]] == ["a", "b/c"]
    assert [m[0] for m in archives.members(gzip.compress(tar))[1]] == ["a", "b/c"]
    assert archives.members(gzip.compress(b"text")) [1][0][0] == "(content)"
    assert archives.members(bz2.compress(tar))[1] == archives.members(lzma.compress(tar))[1]
    assert archives.members(zipped)[1][0][2] == 1 and len(archives.members(zipped)[1]) == 1
    assert archives.members(b"plain") == (None, [])
    with pytest.raises(archives.TooLarge):
        archives.members(gzip.compress(b"0" * 5000), most=1000)
    df = spark.createDataFrame([(1, bytearray(zipped)), (2, bytearray(zipped[:40])), (3, bytearray(b"x")), (4, None)], "id int, c binary")
    got = {r.id: (r.key, r.error is None) for r in archives.archive_members(df, "c", ["id"]).collect()}
    assert got == {1: ("a", True), 2: (None, False)}


def test_member_diff(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, h int")
    a = spark.createDataFrame([("b", 3), ("c", None), ("d", 4)], "k string, h int")
    assert {r.k: r.change for r in archives.member_diff(b, a, [], "k", "h").collect()} == {"a": "removed", "b": "changed", "c": "unchanged", "d": "added"}


def test_sources(spark, tmp_path):
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as c:
        c.execute("create table t (path text, n int)")
        c.executemany("insert into t values (?, ?)", [(f"p{i}", i) for i in range(50)])
    assert files.sqlite_table(spark, str(db), "t", "path string, n int", 3).agg({"n": "sum"}).first()[0] == 1225
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a.txt").write_text("hi")
    assert files.repositories(str(tmp_path)) == [str(tmp_path / "r")]
    assert files.file_scan(spark, str(tmp_path / "r")).count() == 1
    stat = spark.createDataFrame([("3\t1\ta/{b => c}.rs",), ("-\t-\tx.png",), ("noise",)], "l string")
    assert {(r.old_path, r.path, r.added) for r in files.numstat(stat, "l", []).collect()} == {("a/b.rs", "a/c.rs", 3), ("x.png", "x.png", None)}
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, h string")
    after = spark.createDataFrame([("a", "9"), ("d", "2"), ("e", "5")], "p string, h string")
    got = {(r.change_type, r.path, r.old_path) for r in files.snapshot_delta(before, after, "p", "h").collect()}
    assert got == {("M", "a", None), ("R", "d", "b"), ("D", "c", None), ("A", "e", None)}


def test_isolated_errors_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1,), (0,)], "k int")
    got = {r.k: (r.result, r.error) for r in files.each_isolated(df, "k", lambda k: str(6 // k)).collect()}
    assert got[1] == ("6", None) and got[0][1].startswith("ZeroDivisionError")
    log = str(tmp_path / "done")
    assert files.resume(df, log, "k").count() == 2
    df.filter("k = 1").write.parquet(log)
    assert [r.k for r in files.resume(df, log, "k").collect()] == [0]
