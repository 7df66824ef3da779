"""What other diff tools print, as rows of touched lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def touched_lines(df: DataFrame, patch: str, keep: list[str]) -> DataFrame:
    """`keep`, side, line: every line that a hunk header of `patch` covers.

    A missing count is 1. A count of 0 is an anchor and touches nothing on its side. A null or
    header-less patch has no rows.
    """
    groups = [F.regexp_extract_all(F.col(patch), F.lit(_HEADER), F.lit(i)) for i in range(1, 5)]
    hunks = df.select(*keep, F.explode(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups)))).alias("h"))
    sides = F.explode(
        F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"h.g{i}").cast("int").alias("start"), F.coalesce(F.nullif(F.col(f"h.g{i + 1}"), F.lit("")), F.lit("1")).cast("int").alias("n")) for s, i in (("before", 0), ("after", 2))))
    ).alias("x")
    spans = hunks.select(*keep, sides).filter("x.n > 0")
    return spans.select(*keep, "x.side", F.explode(F.sequence(F.col("x.start"), F.col("x.start") + F.col("x.n") - 1)).alias("line"))


_CHANGE = "struct<line_number:int,changes:array<struct<start:int,end:int>>>"


def touched_in_chunks(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """`keep`, side, line (from 0) of `{"chunks": [[{"lhs": {...}, "rhs": {...}}]]}`; a line without changes is touched too."""
    parsed = df.select(*keep, F.from_json(json, f"chunks array<array<struct<lhs:{_CHANGE},rhs:{_CHANGE}>>>").alias("j"))
    lines = parsed.select(*keep, F.explode("j.chunks").alias("c")).select(*keep, F.explode("c").alias("l"))
    both = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("l.lhs.line_number").alias("line")), F.struct(F.lit("after").alias("side"), F.col("l.rhs.line_number").alias("line")))).alias("x")
    return lines.select(*keep, both).filter("x.line is not null").select(*keep, "x.side", "x.line").distinct()


def touched_in_hunks(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """`keep`, side, line (from 0) of `{"hunks": [{"Old": [{"line_index": n}]}, {"New": [...]}]}`."""
    entry = "array<struct<line_index:int>>"
    parsed = df.select(*keep, F.explode(F.from_json(json, f"hunks array<struct<Old:{entry},New:{entry}>>")["hunks"]).alias("h"))
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("h.Old").alias("at")), F.struct(F.lit("after").alias("side"), F.col("h.New").alias("at")))).alias("x")
    return parsed.select(*keep, sides).select(*keep, "x.side", F.explode("x.at.line_index").alias("line")).distinct()
