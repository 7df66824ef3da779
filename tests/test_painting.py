"""Painted ranges."""

import random

from tallyweave.operators import painting as P


def test_ranges_never_overlap_and_stay_inside():
    rng = random.Random(8)
    words = ["a", "bb", " ", "  ", "(", ")", "\n", "x = 1", "\t"]
    for options in (P.MINIMAL, P.MAXIMAL):
        for _ in range(300):
            a, b = ("".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(2))
            for side, t in (("before", a), ("after", b)):
                last = (-1, 0)
                for r in P.paint(a, b, options):
                    if r.side == side:
                        assert 0 <= r.start < r.end <= len(t.split("\n")[r.row])
                        assert (r.row, r.start) >= last
                        last = (r.row, r.end)


def test_equal_texts_have_no_ranges():
    assert P.paint("a\nb", "a\nb", P.MAXIMAL) == [] == P.paint(None, None)


def test_one_word():
    assert P.paint("keep\nlet x = one;\nkeep", "keep\nlet x = two;\nkeep") == [P.Range("after", 1, 8, 11, "Update"), P.Range("before", 1, 8, 11, "Update")]


def test_moves_are_an_option():
    moved = {r.operation for r in P.paint("a\nb\nc", "b\nc\na")}
    assert moved == {"Move"} and P.paint("a\nb\nc", "b\nc\na", P.Options(paint_displaced_moves=False)) == []


def test_spans():
    assert P.trimmed((0, 6), "  ab  ") == (2, 4) and P.trimmed((0, 2), "  x") is None
    assert P.widened((4, 6), "x   ab", 1) == (2, 6)
    assert P.slid_left("a b  c", 2, 4) == (1, 3)
    assert P.joined([(0, 1), (2, 3), (5, 6)], "a b c x", True) == [(0, 3), (5, 6)]
    assert P.labels([P.Range("after", 0, 1, 3, "Insert")], "after", 0, 4) == [None, "Insert", "Insert", None]


def test_table(spark):
    df = spark.createDataFrame([(1, "# a\nx", "# b\nx"), (2, "x", "y"), (3, None, None)], "id int, b string, a string")
    ranges = P.painted(df, "id", "b", "a")
    assert {r.id for r in ranges.collect()} == {1, 2}
    lines = spark.createDataFrame([(1, "before", 0, True), (1, "after", 0, True), (2, "before", 0, False), (2, "after", 0, False)], "id int, side string, row int, is_comment boolean")
    assert {r.id: r.comment_only for r in P.comment_only(ranges, lines, "id").collect()} == {1: True, 2: False}
