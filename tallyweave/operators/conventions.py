"""Checks of how diffs are painted, counted where the pairs are: brackets that share a fate, and classes of matched leaves."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .painting import MINIMAL, Options, paint
from .treediff import PairDiff, costs_without, diff_trees
from .trees import Tree, parse, token_tree


def _line_starts(text: str) -> list[int]:
    return [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]


def _counted(pairs: DataFrame, columns: list[str], schema: str, count: str, tally) -> DataFrame:
    """The summed counts of what `tally(rows of a batch)` gives as a Counter of tuples; one partial sum per batch leaves a task."""
    source = pairs.select(*columns)
    names = [p.split()[0] for p in schema.split(", ")]
    types = [pa.bool_() if p.split()[1] == "boolean" else pa.string() for p in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tally(zip(*(batch.column(k).to_pylist() for k in range(len(columns))), strict=True))
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate(types)), pa.array([found[k] for k in keys], pa.int64())], names=[*names, count])

    return spread(source).mapInArrow(work, f"{schema}, {count} bigint").groupBy(*names).agg(F.sum(count).alias(count))


def bracket_fates(pairs: DataFrame, before: str, after: str, options: Options = MINIMAL) -> DataFrame:
    """side, kind, open_fate, close_fate, groups: how the brackets of each group are painted; the lint holds where both fates are the same.

    Fates are operations of painted ranges, `kept` where nothing is painted, `missing` for a group
    that isn't closed. Null texts have no groups.
    """
    chosen = Options(**vars(options))

    def fate(fates: dict, starts: list[int], at: int) -> str:
        row = bisect_right(starts, at) - 1
        for s, e, op in fates.get(row, ()):
            if s <= at - starts[row] < e:
                return op
        return "kept"

    def tally(rows) -> Counter:
        out: Counter = Counter()
        for b, a in rows:
            if b is None or a is None:
                continue
            painted: dict[str, dict[int, list]] = {"before": {}, "after": {}}
            for r in paint(b, a, chosen):
                painted[r.side].setdefault(r.row, []).append((r.start, r.end, r.operation))
            for side, text in (("before", b), ("after", a)):
                tree, starts = token_tree(text), _line_starts(text)
                for n in range(1, len(tree) + 1):
                    if tree.kind[n] in ("parens", "brackets", "braces"):
                        s, e = tree.span[n]
                        closed = e - s > 1 and text[e - 1] == {"(": ")", "[": "]", "{": "}"}[text[s]]
                        out[side, tree.kind[n], fate(painted[side], starts, s), fate(painted[side], starts, e - 1) if closed else "missing"] += 1
        return out

    return _counted(pairs, [before, after], "side string, kind string, open_fate string, close_fate string", "groups", tally)


def leaf_conventions(pairs: DataFrame, before: str, after: str, language: str) -> DataFrame:
    """row_moved, column_moved, row_edited, drift_matches_neighbours, painted, leaves: classes of matched leaves.

    A leaf's row has moved if its number differs, and is edited if the text of the line does. It
    drifts by the difference of its places, and matches its neighbours if the matched leaf before
    it drifts as far (the first one does). It is painted if its text or its place in its parent
    changed. JSON trees have no places and aren't counted.
    """

    def places(tree: Tree, text: str) -> tuple[list[int], list[str]]:
        return _line_starts(text), text.split("\n")

    def tally(rows) -> Counter:
        out: Counter = Counter()
        for b, a, lang in rows:
            if lang == "Json":
                continue
            left, right = parse(b, lang), parse(a, lang)
            if left is None or right is None:
                continue
            d = PairDiff(left, right)
            for name in PairDiff.PASSES:
                getattr(d, name)()
            (sb, lb), (sa, la) = places(left, b), places(right, a)
            last = None
            for x in range(1, len(left) + 1):
                y = d.to.get(x)
                if not y or left.children[x] or right.children[y]:
                    continue
                p, q = left.span[x][0], right.span[y][0]
                i, j = bisect_right(sb, p) - 1, bisect_right(sa, q) - 1
                drift = q - p
                painted = left.text[x] != right.text[y] or d.to.get(left.parent[x]) != right.parent[y]
                out[i != j, p - sb[i] != q - sa[j], lb[i] != la[j], last is None or last == drift, painted] += 1
                last = drift
        return out

    return _counted(pairs, [before, after, language], "row_moved boolean, column_moved boolean, row_edited boolean, drift_matches_neighbours boolean, painted boolean", "leaves", tally)


def ablation_costs(pairs: DataFrame, before: str, after: str, language: str, names: list[str]) -> DataFrame:
    """without, cost: the summed cost of all pairs with one pass left out (`none`: with all); every pair is parsed once, and passes before the one left out run once."""
    wrong = [n for n in names if n != "none" and n not in PairDiff.PASSES]
    if wrong:
        raise ValueError(f"no such pass: {wrong}")

    def tally(rows) -> Counter:
        out: Counter = Counter({(n,): 0 for n in names})
        for b, a, lang in rows:
            left, right = parse(b, lang) or Tree().finish(), parse(a, lang) or Tree().finish()
            for without, cost in costs_without(left, right, names).items():
                out[(without,)] += cost
        return out

    return _counted(pairs, [before, after, language], "without string", "cost", tally)


def status_counts(pairs: DataFrame, before: str, after: str, language: str) -> DataFrame:
    """kind, status, nodes: matched and deleted nodes of the sides before, per kind; a text without a tree has none."""

    def tally(rows) -> Counter:
        out: Counter = Counter()
        for b, a, lang in rows:
            left = parse(b, lang)
            if left is not None:
                for x, y, *_ in diff_trees(left, parse(a, lang)):
                    if x:
                        out[left.kind[x], "Matched" if y else "Deleted"] += 1
        return out

    return _counted(pairs, [before, after, language], "kind string, status string", "nodes", tally)
