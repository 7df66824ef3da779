"""Painted ranges of a diff: which characters of either side are inserted, deleted, changed or moved."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linediff import _per_pair, classify, common_lines

_WORDS = re.compile(r"\w+|\s+|[^\w\s]")


@dataclass(frozen=True)
class Options:
    """What a painting shows besides the bare changes."""

    leading_whitespace: bool = False
    structural_punctuation: bool = False
    whole_pair_updates: bool = False
    paint_reindent_only_moves: bool = False
    paint_displaced_moves: bool = True
    whole_identifier_updates: bool = False
    interior_whitespace: bool = False
    changed_trailing_whitespace: bool = False


MINIMAL = Options()
MAXIMAL = Options(*[True] * 8)


@dataclass(frozen=True)
class Range:
    side: str
    row: int
    start: int
    end: int
    operation: str


def changed_words(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of the words of either line that the other one doesn't have in order."""
    left, right = ([(m.start(), m.end()) for m in _WORDS.finditer(x)] for x in (a, b))
    kept = common_lines([a[s:e] for s, e in left], [b[s:e] for s, e in right])
    mine, theirs = {i for i, _ in kept}, {j for _, j in kept}
    return [s for i, s in enumerate(left) if i not in mine], [s for j, s in enumerate(right) if j not in theirs]


def joined(spans: Sequence[tuple[int, int]], line: str, over_blanks: bool) -> list[tuple[int, int]]:
    """Spans that touch, or are apart by blanks only, as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and (s <= out[-1][1] or over_blanks and not line[out[-1][1] : s].strip()):
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def trimmed(span: tuple[int, int], line: str) -> tuple[int, int] | None:
    """The span without blanks at its ends; None if it is blank."""
    s, e = span
    part = line[s:e]
    if not part.strip():
        return None
    return s + len(part) - len(part.lstrip()), e - len(part) + len(part.rstrip())


def widened(span: tuple[int, int], line: str, others: int) -> tuple[int, int]:
    """The span grown to the left over the blanks that the other side lacks (it has `others` of them)."""
    s, e = span
    blanks = len(line[:s]) - len(line[:s].rstrip(" \t"))
    return s - max(0, min(blanks, blanks - others)), e


def slid_left(line: str, s: int, e: int) -> tuple[int, int]:
    """An inserted middle that starts after blanks it could start with instead: moved left over equal blanks."""
    while s > 0 and line[s - 1] in " \t" and e > s and line[e - 1] == line[s - 1]:
        s, e = s - 1, e - 1
    return s, e


def paint(before: str | None, after: str | None, options: Options = MINIMAL) -> list[Range]:
    """Ranges of both sides; those of one side never overlap, gaps between them are identical."""
    a, b = (before or "").split("\n"), (after or "").split("\n")
    left, right = classify(before, after)
    out: list[Range] = []

    def whole(side: str, row: int, line: str, operation: str) -> None:
        span = (0, len(line)) if options.leading_whitespace else trimmed((0, len(line)), line)
        if span and span[1] > span[0]:
            out.append(Range(side, row, *span, operation))

    # Runs of unmatched rows between the same kept neighbours are compared row by row.
    runs_a, runs_b = _runs(left), _runs(right)
    for gap, rows in runs_a.items():
        partner = runs_b.get(gap, [])
        if len(rows) == len(partner):
            for i, j in zip(rows, partner, strict=True):
                spans = changed_words(a[i], b[j])
                full = sum(e - s for s, e in spans[0]) >= 0.7 * max(1, len(a[i].strip())) or options.whole_pair_updates
                for side, row, line, mine in (("before", i, a[i], spans[0]), ("after", j, b[j], spans[1])):
                    if full:
                        whole(side, row, line, "Update" if a[i].strip() and b[j].strip() else "Delete" if side == "before" else "Insert")
                        continue
                    kind = "Update" if spans[0] and spans[1] else "Delete" if side == "before" else "Insert"
                    for span in joined(mine, line, not options.interior_whitespace):
                        cut = span if options.interior_whitespace else trimmed(span, line)
                        if cut:
                            out.append(Range(side, row, *(slid_left(line, *cut) if kind != "Update" else cut), kind))
        else:
            for i in rows:
                whole("before", i, a[i], "Delete")
            for j in partner:
                whole("after", j, b[j], "Insert")
    for gap, rows in runs_b.items():
        if gap not in runs_a:
            for j in rows:
                whole("after", j, b[j], "Insert")
    if options.paint_displaced_moves:
        for side, lines, classes in (("before", a, left), ("after", b, right)):
            for row, kind, _ in classes:
                if kind == "moved":
                    whole(side, row, lines[row], "Move")
    return sorted(out, key=lambda r: (r.side, r.row, r.start))


def _runs(classes: list[tuple]) -> dict[int, list[int]]:
    """Unmatched rows by the number of kept rows before them."""
    out: dict[int, list[int]] = {}
    kept = 0
    for row, kind, _ in classes:
        if kind == "kept":
            kept += 1
        elif kind == "unmatched":
            out.setdefault(kept, []).append(row)
    return out


def labels(ranges: Sequence[Range], side: str, row: int, width: int) -> list[str | None]:
    """The operation of each character of a row, the later range winning; None where it is identical."""
    out: list[str | None] = [None] * width
    for r in ranges:
        if (r.side, r.row) == (side, row):
            out[r.start : min(r.end, width)] = [r.operation] * (min(r.end, width) - r.start)
    return out


def painted(pairs: DataFrame, key: str, before: str, after: str, options: Options = MINIMAL) -> DataFrame:
    """key, side, row, start, end, operation of every painted range of every pair. No shuffle."""
    chosen = replace(options)

    def make(a, b):
        return [(r.side, r.row, r.start, r.end, r.operation) for r in paint(a, b, chosen)]

    return _per_pair(pairs, key, before, after, "side string, row int, start int, end int, operation string", ["side", "row", "start", "end", "operation"], make)


def comment_only(ranges: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, comment_only: whether all painted rows of a pair are comments; `lines` has key, side, row, is_comment."""
    return ranges.select(key, "side", "row").distinct().join(lines, [key, "side", "row"]).groupBy(key).agg(F.bool_and("is_comment").alias("comment_only"))
