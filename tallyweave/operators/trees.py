"""Ordered labelled trees: parsing, node tables, hashes, and set-oriented matching by joins.

Node ids are preorder numbers from 1, so that 0 is free to stand for a missing side, and the
descendants of a node are the interval from its id to its id plus its size minus 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import spread

NODE_SCHEMA = "node_id int, parent_id int, depth int, child_idx int, kind string, text string, start int, end int, size int, full_hash bigint, kind_hash bigint"

_TOKEN = re.compile(r'\s+|(?P<comment>//[^\n]*|#[^\n]*|/\*(?s:.*?)\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<number>\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<mark>.)', re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_GROUP = {"(": "parens", "[": "brackets", "{": "braces"}


@dataclass
class Tree:
    """Columns of nodes by id; index 0 is unused."""

    kind: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    children: list[list[int]] = field(default_factory=lambda: [[]])
    span: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])

    def add(self, kind: str, text: str, parent: int, start: int, end: int) -> int:
        self.kind.append(kind)
        self.text.append(text)
        self.parent.append(parent)
        self.children.append([])
        self.span.append((start, end))
        me = len(self.kind) - 1
        self.children[parent].append(me)
        return me

    def __len__(self) -> int:
        return len(self.kind) - 1

    def finish(self) -> Tree:
        """Sizes, depths, places among siblings and hashes, bottom up; ids are in preorder, so children come after their parent."""
        n = len(self) + 1
        self.size = [1] * n
        self.depth = [0] * n
        self.place = [0] * n
        self.full = [0] * n
        self.shape = [0] * n
        parent, kind, text, size, full, shape = self.parent, self.kind, self.text, self.size, self.full, self.shape
        self.statements = [i for i in range(1, n) if kind[i] == "statement"]
        for i in range(2, n):
            self.depth[i] = self.depth[parent[i]] + 1
        for i in range(n - 1, 0, -1):
            kids = self.children[i]
            if not kids:
                full[i], shape[i] = _leaf_hashes(kind[i], text[i])
                continue
            for k, c in enumerate(kids):
                size[i] += size[c]
                self.place[c] = k
            full[i] = short_hash(f"{kind[i]}\x1f{text[i]}\x1f{[full[c] for c in kids]}")
            shape[i] = short_hash(f"{kind[i]}\x1f{[shape[c] for c in kids]}")
        for k, c in enumerate(self.children[0]):
            self.place[c] = k
        return self

    def inside(self, node: int) -> range:
        return range(node, node + self.size[node])

    def postorder(self) -> list[int]:
        out: list[int] = []
        stack = [(1, False)] if len(self) else []
        while stack:
            node, done = stack.pop()
            if done:
                out.append(node)
            else:
                stack.append((node, True))
                stack += [(c, False) for c in reversed(self.children[node])]
        return out


def short_hash(text: str) -> int:
    """60 bits, the same on every machine."""
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 4


_leaves: dict[tuple[str, str], tuple[int, int]] = {}


def _leaf_hashes(kind: str, text: str) -> tuple[int, int]:
    """short_hash() of a leaf with and without its text, remembered per process."""
    found = _leaves.get((kind, text))
    if found is None:
        if len(_leaves) > 200_000:
            _leaves.clear()
        found = _leaves[kind, text] = (short_hash(f"{kind}\x1f{text}"), short_hash(kind))
    return found


def json_tree(text: str) -> Tree:
    tree = Tree()

    def walk(value: object, parent: int, kind: str | None = None) -> None:
        if isinstance(value, dict):
            me = tree.add("object", "", parent, 0, 0)
            for k, v in value.items():
                pair = tree.add("pair", k, me, 0, 0)
                walk(v, pair)
        elif isinstance(value, list):
            me = tree.add("array", "", parent, 0, 0)
            for v in value:
                walk(v, me)
        else:
            name = "null" if value is None else "bool" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
            tree.add(name, json.dumps(value, ensure_ascii=False), parent, 0, 0)

    walk(json.loads(text), 0)
    return tree.finish()


def token_tree(text: str) -> Tree:
    """Statements of tokens and bracketed groups: a tree for text of any bracketed language. It never fails."""
    tree = Tree()
    tree.add("unit", "", 0, 0, len(text))
    kinds, texts, parents, children, spans = tree.kind, tree.text, tree.parent, tree.children, tree.span
    outer: list[tuple[int, str]] = []
    parent, close, statement = 1, "", 0  # the open group, what closes it, and the open statement in it
    # Nodes are made in the order of the text, and a parent before its children: that is preorder.
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        value = m.group()
        if kind is None:
            # A line break ends a statement of a block, not within parentheses.
            if statement and (close == "" or close == "}") and "\n" in value:
                statement = 0
            continue
        at, end = m.span()
        if kind == "comment":
            tree.add(kind, value, parent, at, end)
            statement = 0
            continue
        if value == close:
            spans[parent] = (spans[parent][0], end)
            statement = parents[parent]
            parent, close = outer.pop()
            continue
        if not statement:
            statement = tree.add("statement", "", parent, at, end)
        if value in _CLOSE:
            outer.append((parent, close))
            parent, close, statement = tree.add(_GROUP[value], "", statement, at, end), _CLOSE[value], 0
            continue
        kinds.append(kind)
        texts.append(value)
        parents.append(statement)
        children.append([])
        spans.append((at, end))
        children[statement].append(len(kinds) - 1)
        spans[statement] = (spans[statement][0], end)
        if value == ";" or value == ",":
            statement = 0
    return tree.finish()


def parse(text: str | None, language: str | None) -> Tree | None:
    """The tree of a text; None where there is none, which is a valid state and no error."""
    if text is None:
        return None
    if language == "Json":
        try:
            return json_tree(text)
        except (ValueError, RecursionError):
            return None
    return token_tree(text)


def nodes(df: DataFrame, text: str, language: str, keep: list[str]) -> DataFrame:
    """One row per node of each text: `keep` and NODE_SCHEMA. A text without a tree has no rows. No shuffle."""
    source = df.select(*keep, F.col(text).alias("_text"), F.col(language).alias("_language"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    names = [p.split()[0] for p in NODE_SCHEMA.split(", ")]
    types = [pa.string() if p.split()[1] == "string" else pa.int64() if p.split()[1] == "bigint" else pa.int32() for p in NODE_SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, lang) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)):
                tree = parse(t, lang)
                if tree is None or not len(tree):
                    continue
                ids = range(1, len(tree) + 1)
                rows = [(n, tree.parent[n], tree.depth[n], tree.place[n], tree.kind[n], tree.text[n], *tree.span[n], tree.size[n], tree.full[n], tree.shape[n]) for n in ids]
                columns = [pa.array(c, t_) for c, t_ in zip(zip(*rows, strict=True), types, strict=True)]
                own = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in range(len(keep))), *columns], names=[*keep, *names])

    return spread(source).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), NODE_SCHEMA]))


# --- set-oriented operators on node tables ------------------------------------------------


def equal_hash_matches(before: DataFrame, after: DataFrame, key: list[str], hash_: str, least_size: int = 1) -> DataFrame:
    """key, before_id, after_id: nodes of equal hash, the n-th before with the n-th after, each node once."""
    w = Window.partitionBy(*key, hash_).orderBy("node_id")
    side = lambda d, name: d.filter(F.col("size") >= least_size).select(*key, F.col(hash_).alias(hash_), F.col("node_id").alias(name), F.row_number().over(w).alias("_n"))
    return side(before, "before_id").join(side(after, "after_id"), [*key, hash_, "_n"]).select(*key, "before_id", "after_id")


def outermost(matches: DataFrame, nodes_before: DataFrame, key: list[str]) -> DataFrame:
    """The matches that lie within no other: the largest equal subtrees. One running maximum per pair, no range join."""
    sized = matches.join(nodes_before.select(*key, F.col("node_id").alias("before_id"), "size"), [*key, "before_id"])
    w = Window.partitionBy(*key).orderBy("before_id").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("_reach", F.max(F.col("before_id") + F.col("size")).over(w)).filter(F.col("_reach").isNull() | (F.col("_reach") <= F.col("before_id"))).select(*key, "before_id", "after_id")


def outermost_matches(pairs: DataFrame, key: str, before: str, after: str, language: str, least_size: int = 1) -> DataFrame:
    """key, before_id, after_id: what equal_hash_matches() and outermost() give of the trees of each pair, without node tables.

    Both sides are parsed once, where the texts are, and only the matches leave the task.
    """
    source = pairs.select(key, before, after, language)
    kind = dict(source.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, right = [], [], []
            for i, (b, a, lang) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                one, two = parse(b, lang), parse(a, lang)
                if one is None or two is None:
                    continue
                found: dict[int, list[int]] = {}
                for y in range(1, len(two) + 1):
                    if two.size[y] >= least_size:
                        found.setdefault(two.full[y], []).append(y)
                used: dict[int, int] = {}
                reach = 0
                for x in range(1, len(one) + 1):
                    ys = found.get(one.full[x]) if one.size[x] >= least_size else None
                    n = used.get(one.full[x], 0)
                    if ys is None or n >= len(ys):
                        continue
                    used[one.full[x]] = n + 1  # the n-th with the n-th, whether or not a larger one covers it
                    if x >= reach:
                        at.append(i)
                        left.append(x)
                        right.append(ys[n])
                    reach = max(reach, x + one.size[x])
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=[key, "before_id", "after_id"])

    return spread(source).mapInArrow(work, f"`{key}` {kind}, before_id int, after_id int")


def unique_key_matches(before: DataFrame, after: DataFrame, scope: list[str], id_: str) -> DataFrame:
    """scope, before_id, after_id where exactly one row on either side has the scope's values."""
    one = lambda d, name: d.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.min(id_).alias(name)).filter("_n = 1").drop("_n")
    return one(before, "before_id").join(one(after, "after_id"), scope)


def equal_count_zip(before: DataFrame, after: DataFrame, scope: list[str], id_: str, order: str) -> DataFrame:
    """scope, before_id, after_id: where both sides have equally many rows of a scope, the i-th with the i-th; else none."""
    w = Window.partitionBy(*scope)
    side = lambda d, name: d.select(*scope, F.col(id_).alias(name), F.row_number().over(w.orderBy(order, id_)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    return side(before, "before_id").join(side(after, "after_id"), [*scope, "_i", "_n"]).select(*scope, "before_id", "after_id")


def neighbours(nodes_: DataFrame, key: list[str]) -> DataFrame:
    """`nodes_` and the ids of the previous and next sibling."""
    w = Window.partitionBy(*key, "parent_id").orderBy("child_idx")
    return nodes_.withColumn("previous_id", F.lag("node_id").over(w)).withColumn("next_id", F.lead("node_id").over(w))


def nearest_marked_ancestor(nodes_: DataFrame, key: list[str], marked: str) -> DataFrame:
    """key, node_id, ancestor_id: the deepest marked ancestor of every node (itself not counted), or null.

    Intervals of a tree nest, so an ancestor of a node is the last earlier marked node whose interval
    still covers it; a stack per tree finds it in one pass over the nodes in preorder.
    """
    types = nodes_.select(*key).dtypes
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types), "node_id int, ancestor_id int"])

    def work(pdf):
        pdf = pdf.sort_values("node_id")
        stack: list[tuple[int, int]] = []
        found = []
        for node, size, mark in zip(pdf["node_id"], pdf["size"], pdf[marked], strict=True):
            while stack and stack[-1][1] <= node:
                stack.pop()
            found.append(stack[-1][0] if stack else None)
            if mark:
                stack.append((node, node + size))
        out = pdf[[*key, "node_id"]].copy()
        out["ancestor_id"] = found
        return out

    return nodes_.select(*key, "node_id", "size", marked).groupBy(*key).applyInPandas(work, schema)


#: Characters of paths that a batch holds.
BATCH_CHARS = 16 << 20


def node_paths(nodes_: DataFrame, key: list[str]) -> DataFrame:
    """key, node_id, path: `kind:n/kind:n`, n counting siblings of one kind from 1; the root's is empty.

    Any depth: one pass over the nodes in preorder that holds the open nodes of one tree, after one shuffle.
    """
    rows = nodes_.select(*key, "node_id", "parent_id", "depth", "kind")
    k = len(key)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*key).dtypes), "node_id int, path string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        open_: list[tuple[int, str, dict[str, int]]] = []  # node, path, children so far by kind
        for batch in batches:
            at, paths, keep, chars = 0, [], [], 0

            def packed(end: int) -> pa.RecordBatch:
                part = batch.slice(at, end - at).take(pa.array(keep, pa.int64()))
                return pa.RecordBatch.from_arrays([*part.columns[: k + 1], pa.array(paths, pa.string())], names=[*key, "node_id", "path"])

            ids = zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True)
            values = (batch.column(k + i).to_pylist() for i in range(4))
            for row, (me, node, parent, depth, kind) in enumerate(zip(ids, *values, strict=True)):
                if me != tree or depth == 0:
                    tree, open_ = me, []
                while open_ and open_[-1][0] > parent:
                    open_.pop()
                if depth == 0:
                    path = ""
                elif open_ and open_[-1][0] == parent:
                    _, above, seen = open_[-1]
                    seen[kind] = seen.get(kind, 0) + 1
                    path = f"{above}/{kind}:{seen[kind]}" if above else f"{kind}:{seen[kind]}"
                else:
                    continue
                open_.append((node, path, {}))
                paths.append(path)
                keep.append(row - at)
                chars += len(path)
                if chars > BATCH_CHARS:
                    yield packed(row + 1)
                    at, paths, keep, chars = row + 1, [], [], 0
            yield packed(batch.num_rows)

    return rows.repartition(*key).sortWithinPartitions(*key, "node_id").mapInArrow(work, schema)


def visible_rows(nodes_: DataFrame, key: list[str], collapsed: Column, hidden: Column) -> DataFrame:
    """Rows that a tree view shows, numbered from 0: a collapsed node keeps its row, a hidden one loses its subtree."""
    w = Window.partitionBy(*key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(hidden | collapsed, F.col("node_id") + F.col("size"))
    shown = nodes_.withColumn("_until", F.max(cut).over(w)).filter((F.col("_until").isNull() | (F.col("_until") <= F.col("node_id"))) & ~hidden)
    return shown.withColumn("row", F.row_number().over(Window.partitionBy(*key).orderBy("node_id")) - 1).drop("_until")


def fully_solved(nodes_: DataFrame, key: list[str], decided: str) -> DataFrame:
    """key, node_id, solved: the node and all its descendants are decided; by running counts of the undecided in preorder."""
    order = Window.partitionBy(*key).orderBy("node_id")
    open_ = (~F.col(decided)).cast("int")
    counted = nodes_.withColumn("_upto", F.sum(open_).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = counted.select(*key, F.col("node_id").alias("_last"), F.col("_upto").alias("_end"))
    return counted.withColumn("_last", F.col("node_id") + F.col("size") - 1).join(last, [*key, "_last"]).select(*key, "node_id", (F.col("_end") - F.col("_upto") + open_ == 0).alias("solved"))


def mapping_cost(mapping: DataFrame, before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, cost: updates, deletions and insertions cost 1; whole-subtree forms cost the subtree (1 if unknown); a change of own text costs 1."""
    b = before.select(*key, F.col("node_id").alias("before_id"), F.col("size").alias("_bs"), F.col("text").alias("_bt"))
    a = after.select(*key, F.col("node_id").alias("after_id"), F.col("size").alias("_as"), F.col("text").alias("_at"))
    joined = mapping.join(b, [*key, "before_id"], "left").join(a, [*key, "after_id"], "left")
    op = F.col("operation")
    cost = (
        F.when(op.isin("Update", "Delete", "Insert"), 1)
        .when(op == "DeleteWithChildren", F.coalesce("_bs", F.lit(1)))
        .when(op == "InsertWithChildren", F.coalesce("_as", F.lit(1)))
        .when((op == "MatchButNotIdentical") & (F.col("_bt") != F.col("_at")), 1)
        .otherwise(0)
    )
    return joined.groupBy(*key).agg(F.sum(cost).alias("cost"))


def owned_gaps(nodes_: DataFrame, key: list[str]) -> DataFrame:
    """kind, bytes: text of inner nodes that no child covers, per kind."""
    w = Window.partitionBy(*key, "parent_id").orderBy("child_idx")
    gaps = nodes_.filter("parent_id > 0").select(*key, "parent_id", F.greatest(F.col("start") - F.lag("end").over(w), F.lit(0)).alias("_gap"))
    inside = gaps.groupBy(*key, "parent_id").agg(F.sum("_gap").alias("_gap"))
    return nodes_.join(inside.withColumnRenamed("parent_id", "node_id"), [*key, "node_id"]).groupBy("kind").agg(F.sum("_gap").alias("gap_characters"))


def gaps_of_texts(df: DataFrame, text: str) -> DataFrame:
    """kind, gap_characters: what owned_gaps() gives of the token trees of `text`, counted where they are parsed; one sum per kind and batch is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                if t is None:
                    continue
                tree = token_tree(t)
                span = tree.span
                for n in range(1, len(tree) + 1):
                    kids = tree.children[n]
                    if kids:
                        found[tree.kind[n]] = found.get(tree.kind[n], 0) + sum(max(0, span[b][0] - span[a][1]) for a, b in zip(kids, kids[1:], strict=False))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "gap"])

    return spread(df.select(text)).mapInArrow(work, "kind string, gap bigint").groupBy("kind").agg(F.sum("gap").alias("gap_characters"))


def paths_of_texts(df: DataFrame, text: str, language: str, keep: list[str]) -> DataFrame:
    """`keep`, node_id, path: what node_paths() gives of the trees of `text`, made where they are parsed. No shuffle."""
    source = df.select(*keep, F.col(text).alias("_text"), F.col(language).alias("_language"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    k = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, paths, chars = [], [], [], 0

            def packed() -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(k)), pa.array(ids, pa.int32()), pa.array(paths, pa.string())], names=[*keep, "node_id", "path"])

            for i, (t, lang) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True)):
                tree = parse(t, lang)
                if tree is None or not len(tree):
                    continue
                open_: list[tuple[int, str, dict[str, int]]] = []  # the way to the node: node, path, children so far by kind
                for n in range(1, len(tree) + 1):
                    up, kind, path = tree.parent[n], tree.kind[n], ""
                    while open_ and open_[-1][0] != up:
                        open_.pop()
                    if open_:
                        _, above, seen = open_[-1]
                        seen[kind] = seen.get(kind, 0) + 1
                        path = f"{above}/{kind}:{seen[kind]}" if above else f"{kind}:{seen[kind]}"
                    if tree.children[n]:
                        open_.append((n, path, {}))
                    at.append(i)
                    ids.append(n)
                    paths.append(path)
                    chars += len(path)
                    if chars > BATCH_CHARS:
                        yield packed()
                        at, ids, paths, chars = [], [], [], 0
            yield packed()

    return spread(source).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "node_id int, path string"]))
