"""Records that fail to parse."""

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
import pytest

from tallyweave.operators import bad_rows as B

C = "0123456789abcdef0123456789abcdef01234567"
GOOD = f"Go,repo,{C},a/b.go,ok,1.5,10,12,99"


@pytest.mark.parametrize(
    "record",
    [GOOD, GOOD + "\r", f'"Go","repo","{C}","a/b.go","ok","1.5","10","12","99"', f'Go,repo,{C},"a, ""b""\nc.go",ok,1,2,3,4', f"Go,repo,{C},a,killed,,,,", f"Go,repo,{C},a,timed_out,120000,5,,7", f"Go,repo,{C},a,ok,007,0,0,9223372036854775807"],
)
def test_good(record):
    assert B.diagnose(record)[1] is None
    assert B._bulk(pa.array([record])) is not None


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        (None, "no_text"), ("Go,repo", "too_few_fields"), (GOOD + ",", "too_many_fields"), (GOOD.replace("Go,", ",", 1), "empty_language"), (GOOD.replace("repo", ""), "empty_repository"),
        (GOOD.replace("a/b.go", ""), "empty_path"), (GOOD.replace(C, C.upper()), "bad_commit"), (GOOD.replace(C, C[:-1]), "bad_commit"), (GOOD.replace(",ok,", ",OK,"), "bad_status"),
        (GOOD.replace("1.5", ""), "missing_elapsed_ms"), (GOOD.replace("1.5", "1."), "bad_elapsed_ms"), (GOOD.replace("1.5", "1e3"), "bad_elapsed_ms"), (GOOD.replace("1.5", "NaN"), "bad_elapsed_ms"),
        (GOOD.replace(",10,", ",-1,"), "bad_ast_nodes_before"), (GOOD.replace(",12,", ",+12,"), "bad_ast_nodes_after"), (GOOD.replace("99", "9223372036854775808"), "bad_peak_memory_bytes"),
        (GOOD.replace(",10,", ",١,"), "bad_ast_nodes_before"), (GOOD.replace("a/b.go", 'a/"b".go'), "quote_inside_field"), (GOOD.replace("a/b.go", '"a"b'), "text_after_quote"), (GOOD.replace("a/b.go", '"a'), "quote_not_closed"),
        (GOOD.replace("a/b.go", "a\nb"), "line_break_inside_field"), (GOOD + "\r\r", "line_break_inside_field"),
    ],
)
def test_bad(record, reason):
    assert B.diagnose(record) == (None, reason)
    assert B._bulk(pa.array([record], pa.string())) is None


field = st.text(st.sampled_from('ab,"\r\n 1.'), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.just(GOOD), st.lists(field, min_size=7, max_size=10).map(",".join), st.tuples(st.integers(0, len(GOOD)), st.sampled_from('",\r\n1x')).map(lambda x: GOOD[: x[0]] + x[1] + GOOD[x[0] :])), max_size=12))
def test_blocks_agree_with_single_records(records):
    good, bad = [], []
    B._sift(pa.array(records, pa.string()), 0, good, bad)
    assert sorted(i for rows, _ in good for i in rows) == [i for i, r in enumerate(records) if B.diagnose(r)[1] is None]
    assert dict(bad) == {i: B.diagnose(r)[1] for i, r in enumerate(records) if B.diagnose(r)[1] is not None}


def test_table(spark):
    header = ",".join(B.COLUMNS)
    rows = [(1, GOOD, "x"), (2, header, "x"), (3, "", None), (4, "\r", None), (5, None, "x"), (6, GOOD, "x"), (7, "junk", None), (8, GOOD.replace("a/b.go", "a" * 200_000), "x")]
    df = spark.createDataFrame(rows, "raw_id int, raw_line string, path string")  # `path` clashes
    out = B.load_records(df, block=3)
    assert [r.raw_id for r in B.good_rows(out).orderBy("raw_id").collect()] == [1, 6, 8]
    assert {r.raw_id: r.reason for r in B.bad_rows(out).collect()} == {5: "no_text", 7: "too_few_fields"}
    assert out.filter("raw_id = 1").select("raw_path", "path", "elapsed_ms").first() == ("x", "a/b.go", 1.5)
    assert B.load_records(df.limit(0)).count() == 0


def test_another_layout(spark):
    layout = B.Layout(B.Field("id", "whole", needed_if=("kind", "row")), B.Field("kind", one_of=("row", "note")), B.Field("price", "decimal"), B.Field("text", not_empty=True, pattern="[A-Z].*"))
    lines = ["1,row,2.5,Good", ",note,,Also", ",row,1,Good", "x,note,,Good", "1,other,,Good", "1,row,1.,Good", "1,row,1,bad", "1,row,1,", "1,row,1", 'id,kind,price,text', '2,row,,"A ""b"", c"']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, raw_line string")
    out = B.load_records(df, layout=layout).cache()
    assert {r.n: (r.id, r.kind, r.price, r.text) for r in B.good_rows(out).collect()} == {0: (1, "row", 2.5, "Good"), 1: (None, "note", None, "Also"), 10: (2, "row", None, 'A "b", c')}
    assert {r.n: r.reason for r in B.bad_rows(out, layout).collect()} == {2: "missing_id", 3: "bad_id", 4: "bad_kind", 5: "bad_price", 6: "bad_text", 7: "empty_text", 8: "too_few_fields"}
