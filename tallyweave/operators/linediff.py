"""Line diffs of text pairs: order-free by joins, ordered by longest common subsequences."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread


def numbered_lines(pairs: DataFrame, pair_id: str, side: str, text: str) -> DataFrame:
    """pair_id, line, occurrence: each line of a text and how many equal ones stood before it; a final break opens no line."""
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    rows = pairs.filter((F.col(text) != "") & F.col(text).isNotNull()).select(pair_id, F.posexplode(lines).alias("row", "line"))
    return rows.groupBy(pair_id, "line").agg(F.count(F.lit(1)).alias(f"n_{side}"))


def multiset_diff(pairs: DataFrame, pair_id: str, before: str, after: str) -> DataFrame:
    """pair_id, kept, deleted, inserted: lines as a multiset, so moved lines are kept.

    Both sides are counted in one aggregation over (pair, line): no join of the two sides and no
    occurrence is materialised.
    """
    sides = F.explode(F.array(F.struct(F.lit(1).alias("b"), F.lit(0).alias("a"), F.col(before).alias("t")), F.struct(F.lit(0).alias("b"), F.lit(1).alias("a"), F.col(after).alias("t")))).alias("x")
    texts = pairs.select(pair_id, sides).select(pair_id, "x.*")
    lines = texts.filter("t is not null and t <> ''").select(pair_id, "b", "a", F.explode(F.split(F.regexp_replace("t", r"\n\z", ""), "\n", -1)).alias("line"))
    counts = lines.groupBy(pair_id, "line").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    found = counts.groupBy(pair_id).agg(
        F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("deleted"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("inserted")
    )
    return pairs.select(pair_id).join(found, pair_id, "left").fillna(0, ["kept", "deleted", "inserted"])


#: Cells of the table of a pair (in bits) up to which it is kept for the way back.
MOST_CELLS = 2_000_000_000


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Equal ends are cut off. A row of the table is one whole number with a bit per item of `b`, so a
    step handles all of them. Tables beyond MOST_CELLS are halved where a longest subsequence passes.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end_a, end_b = len(a), len(b)
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    middle = _by_halves(a[start:end_a], b[start:end_b]) if (end_a - start) * (end_b - start) > MOST_CELLS else _by_bits(a[start:end_a], b[start:end_b])
    head = [(i, i) for i in range(start)]
    tail = [(end_a + i, end_b + i) for i in range(len(a) - end_a)]
    return head + [(start + i, start + j) for i, j in middle] + tail


def _by_bits(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    whole = (1 << len(b)) - 1
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows = []
    v = whole
    for x in a:
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & whole
        rows.append(v)
    # A bit of a row is 0 where the sequence grows by the item of b.
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append((i, j))
    return out[::-1]


#: Most frequent items whose bits are kept at hand; the others' are made when needed.
KEPT_MASKS = 256


def _last_row(a: list, b: list) -> np.ndarray:
    """The lengths of longest common subsequences of `a` with each beginning of `b`, in memory linear in both."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)

    def mask(at: list[int]) -> int:
        if len(at) == 1:
            return 1 << at[0]
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    often = sorted((x for x in places if len(places[x]) > 1), key=lambda x: -len(places[x]))[:KEPT_MASKS]
    kept = {x: mask(places[x]) for x in often}
    whole = (1 << len(b)) - 1
    v = whole
    for x in a:
        if x in places:
            hit = v & (kept[x] if x in kept else mask(places[x]))
            v = ((v + hit) | (v - hit)) & whole
    grows = 1 - np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little").astype(np.int64)
    return np.concatenate([[0], np.cumsum(grows)])


def _by_halves(a: list, b: list) -> list[tuple[int, int]]:
    """For very long lists, after Hirschberg: `b` is cut where the halves of `a` have most in common with its two parts."""
    in_a, in_b = set(a), set(b)
    rows, columns = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    a, b = [a[i] for i in rows], [b[j] for j in columns]
    if len(a) < 2 or len(a) * len(b) <= MOST_CELLS:
        found = _by_bits(a, b)
    else:
        i = len(a) // 2
        j = int(np.argmax(_last_row(a[:i], b) + _last_row(a[i:][::-1], b[::-1])[::-1]))
        found = common_lines(a[:i], b[:j]) + [(i + x, j + y) for x, y in common_lines(a[i:], b[j:])]
    return [(rows[x], columns[y]) for x, y in found]


def moved_lines(a: list[str], b: list[str], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of equal lines, unique on either side among what isn't kept: they only changed places."""
    used_a, used_b = {i for i, _ in kept}, {j for _, j in kept}
    rest_a: dict[str, list[int]] = {}
    rest_b: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        if i not in used_a and x.strip():
            rest_a.setdefault(x, []).append(i)
    for j, x in enumerate(b):
        if j not in used_b and x.strip():
            rest_b.setdefault(x, []).append(j)
    return sorted((i[0], rest_b[x][0]) for x, i in rest_a.items() if len(i) == 1 and len(rest_b.get(x, [])) == 1)


def heaviest_in_order(pairs: list[tuple[int, int]], weights: list[int]) -> list[int]:
    """Indices of the heaviest set of pairs that rises on both sides; pairs are sorted by their first side."""
    columns = sorted({j for _, j in pairs})
    best: list[tuple[int, int]] = [(0, -1)] * (len(columns) + 1)  # prefix maxima as a Fenwick tree
    back: list[int] = []
    score: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(columns, j)
        i, top = at, (0, -1)
        while i > 0:
            top = max(top, best[i])
            i -= i & -i
        score.append(top[0] + weights[k])
        back.append(top[1])
        i = at + 1
        while i <= len(columns):
            best[i] = max(best[i], (score[k], k))
            i += i & -i
    if not pairs:
        return []
    k = max(range(len(pairs)), key=lambda q: (score[q], q))
    out = []
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def classify(before: str | None, after: str | None) -> tuple[list[tuple], list[tuple]]:
    """Per side, (row, class, partner): kept, moved, unmatched or blank."""
    a = (before or "").split("\n")
    b = (after or "").split("\n")
    kept = common_lines(a, b)
    moved = moved_lines(a, b, kept)
    left = dict(kept) | dict(moved)
    right = {j: i for i, j in left.items()}
    in_order = set(kept)

    def side(lines: list[str], partner: dict[int, int], flip: bool) -> list[tuple]:
        out = []
        for i, x in enumerate(lines):
            j = partner.get(i)
            pair = (j, i) if flip else (i, j)
            kind = "kept" if j is not None and pair in in_order else "moved" if j is not None else "blank" if not x.strip() else "unmatched"
            out.append((i, kind, j))
        return out

    return side(a, left, False), side(b, right, True)


def _per_pair(pairs: DataFrame, pair_id: str, before: str, after: str, schema: str, names: list[str], make) -> DataFrame:
    source = pairs.select(pair_id, before, after)
    kind = dict(source.dtypes)[pair_id]
    types = source.limit(0).sparkSession.createDataFrame([], schema).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for batch in batches:
            ids, rows = [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for row in make(a, b):
                    ids.append(i)
                    rows.append(row)
            if rows:
                columns = [pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=[pair_id, *names])

    return spread(source).mapInArrow(work, f"`{pair_id}` {kind}, {schema}")


def line_classes(pairs: DataFrame, pair_id: str, before: str, after: str) -> DataFrame:
    """pair_id, side, row, class, partner of every line (rows from 0). Pairs are independent: no shuffle."""

    def make(a, b):
        left, right = classify(a, b)
        return [("before", *x) for x in left] + [("after", *x) for x in right]

    return _per_pair(pairs, pair_id, before, after, "side string, row int, class string, partner int", ["side", "row", "class", "partner"], make)


def ordered_diff(pairs: DataFrame, pair_id: str, before: str, after: str) -> DataFrame:
    """pair_id, kept, deleted, inserted, moved, distance: the ordered line diff; distance counts deletions and insertions."""

    def make(a, b):
        x, y = ("" if a is None else a).split("\n"), ("" if b is None else b).split("\n")
        kept = common_lines(x, y)
        return [(len(kept), len(x) - len(kept), len(y) - len(kept), len(moved_lines(x, y, kept)), len(x) + len(y) - 2 * len(kept))]

    return _per_pair(pairs, pair_id, before, after, "kept int, deleted int, inserted int, moved int, distance int", ["kept", "deleted", "inserted", "moved", "distance"], make)


def reconcile_moves(before_walk: DataFrame, after_walk: DataFrame, pair_id: str) -> DataFrame:
    """pair_id, row_before, row_after of the account of moves that blames fewer rows per pair; on a tie, that of the before side.

    Pairs that both walks call moved are in either account, so they always stay.
    """
    count = lambda d, name: d.groupBy(pair_id).agg(F.count(F.lit(1)).alias(name))
    sizes = count(before_walk, "_b").join(count(after_walk, "_a"), pair_id, "full").fillna(0, ["_b", "_a"])
    chosen = sizes.select(pair_id, (F.col("_b") <= F.col("_a")).alias("_first"))
    both = before_walk.withColumn("_mine", F.lit(True)).unionByName(after_walk.withColumn("_mine", F.lit(False)))
    return both.join(chosen, pair_id).filter(F.col("_mine") == F.col("_first")).drop("_mine", "_first")


def islands(ranges: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """by, key, start, end: runs of ranges of one key that touch each other, as one range."""
    w = Window.partitionBy(*by, key).orderBy(start, end)
    opened = ranges.withColumn("_new", (F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col(start)).cast("int"))
    grouped = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def hunks_json(before_path: str, after_path: str, language: str, before: str | None, after: str | None) -> str:
    """The diff of a pair as one JSON object: hunks of changed rows per side."""
    left, right = classify(before, after)

    def side(path: str, rows: list[tuple], lines: list[str], gone: str) -> dict:
        hunks, open_ = [], None
        for row, kind, _ in [*rows, (len(rows), "kept", None)]:
            op = {"unmatched": gone, "moved": "Move"}.get(kind)
            if open_ and op != open_["operation"]:
                open_["range"]["end_row"] = row
                hunks.append(open_)
                open_ = None
            if op and not open_:
                open_ = {"operation": op, "range": {"start_row": row, "start_column": 0, "end_row": row, "end_column": 0}}
        return {"path": path, "language": language, "hunks": hunks}

    a, b = (before or "").split("\n"), (after or "").split("\n")
    return json.dumps({"before": side(before_path, left, a, "Delete"), "after": side(after_path, right, b, "Insert"), "large_residual": False}, ensure_ascii=False)


# Fixed value: the schema that the JSON of a diff keeps to.
_SIDE = {"type": "object", "required": ["path", "language", "hunks"], "additionalProperties": False, "properties": {"path": {"type": "string"}, "language": {"type": "string"}, "hunks": {"type": "array", "items": {"type": "object", "required": ["operation", "range"], "additionalProperties": False, "properties": {"operation": {"enum": ["Identical", "Insert", "Delete", "Update", "Move"]}, "range": {"type": "object", "required": ["start_row", "start_column", "end_row", "end_column"], "additionalProperties": {"type": "integer", "minimum": 0}}}}}}}
DIFF_SCHEMA = {"type": "object", "required": ["before", "after", "large_residual"], "additionalProperties": False, "properties": {"before": {"$ref": "#/$defs/side"}, "after": {"$ref": "#/$defs/side"}, "large_residual": {"type": "boolean"}}, "$defs": {"side": _SIDE}}


def diffs_as_json(pairs: DataFrame, pair_id: str, before: str, after: str, before_path: str = "before", after_path: str = "after", language: str = "text") -> DataFrame:
    """pair_id, diff: each pair's diff as a JSON object of DIFF_SCHEMA."""
    return _per_pair(pairs, pair_id, before, after, "diff string", ["diff"], lambda a, b: [(hunks_json(before_path, after_path, language, a, b),)])
