"""Tree edit distance with its mapping, bounded by cells: exact on small forests, by decomposition on large ones."""

from __future__ import annotations

from collections.abc import Sequence

from .linediff import common_lines
from .trees import Tree

#: Cells (nodes times nodes) up to which a pair of forests is solved exactly.
MOST_CELLS = 10_000
#: From so many children on, both sides, children are aligned by their longest common subsequence first.
MANY_CHILDREN = 50
#: What pairing two nodes costs: nothing if they are equal, 1 if only the text differs; nodes of two kinds don't pair.
APART = 3


def _pair_cost(a: Tree, x: int, b: Tree, y: int) -> int:
    if a.kind[x] != b.kind[y] or bool(a.children[x]) != bool(b.children[y]):
        return APART
    return int(a.text[x] != b.text[y])


class _Forest:
    """The chosen nodes of a tree in postorder, hanging from their nearest chosen ancestors."""

    def __init__(self, tree: Tree, nodes: Sequence[int]):
        chosen = set(nodes)
        self.roots: list[int] = []
        self.children: dict[int, list[int]] = {n: [] for n in chosen}
        above: dict[int, int] = {}
        for n in sorted(chosen):
            up = tree.parent[n]
            trail = []
            while up and up not in chosen and up not in above:
                trail.append(up)
                up = tree.parent[up]
            home = up if up in chosen else above.get(up, 0)
            above.update(dict.fromkeys(trail, home))
            (self.children[home] if home else self.roots).append(n)
        self.post: list[int] = []
        stack = [(n, False) for n in reversed(self.roots)]
        while stack:
            n, done = stack.pop()
            if done:
                self.post.append(n)
            else:
                stack.append((n, True))
                stack += [(c, False) for c in reversed(self.children[n])]
        place = {n: i for i, n in enumerate(self.post)}
        self.left: list[int] = []
        for n in self.post:  # children come first
            kids = self.children[n]
            self.left.append(self.left[place[kids[0]]] if kids else place[n])
        last = {left: i for i, left in enumerate(self.left)}
        self.keyroots = sorted(last.values())


def exact_mapping(a: Tree, xs: Sequence[int], b: Tree, ys: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of turning the forest `xs` into `ys` (1 for every node that is dropped or new), and the pairs that it keeps."""
    f, g = _Forest(a, xs), _Forest(b, ys)
    n, m = len(f.post), len(g.post)
    if not n or not m:
        return n + m, []
    # A common root makes one tree of each forest.
    fl, gl = [*f.left, 0], [*g.left, 0]
    fk, gk = [k for k in f.keyroots if fl[k]] + [n], [k for k in g.keyroots if gl[k]] + [m]
    dist = [[0] * (m + 1) for _ in range(n + 1)]
    costs = [[_pair_cost(a, x, b, y) for y in g.post] + [APART] for x in f.post] + [[APART] * m + [0]]

    def table(i: int, j: int) -> list[list[int]]:
        li, lj = fl[i], gl[j]
        rows, columns = i - li + 2, j - lj + 2
        d = [list(range(columns))]
        for r in range(1, rows):
            u = li + r - 1
            above, row = d[-1], [r]
            whole = fl[u] == li
            du, back = dist[u], d[fl[u] - li]
            left = r
            if whole:
                diagonal = r - 1
                for v, up, cost in zip(range(lj, j + 1), above[1:], costs[u][lj : j + 1], strict=True):
                    best = up + 1 if up < left else left + 1
                    if gl[v] == lj:
                        other = diagonal + cost
                        left = du[v] = other if other < best else best
                    else:
                        other = back[gl[v] - lj] + du[v]
                        left = other if other < best else best
                    row.append(left)
                    diagonal = up
            else:
                for up, start, below in zip(above[1:], gl[lj : j + 1], du[lj : j + 1], strict=True):
                    best = up + 1 if up < left else left + 1
                    other = back[start - lj] + below
                    left = other if other < best else best
                    row.append(left)
            d.append(row)
        return d

    for i in fk:
        for j in gk:
            if fl[i] == i and gl[j] == j:  # two leaves
                dist[i][j] = min(2, costs[i][j])
            else:
                table(i, j)
    pairs: list[tuple[int, int]] = []
    todo = [(n, m)]
    while todo:
        i, j = todo.pop()
        d = table(i, j)
        li, lj = fl[i], gl[j]
        r, c = i - li + 1, j - lj + 1
        while r and c:
            u, v = li + r - 1, lj + c - 1
            if fl[u] == li and gl[v] == lj and d[r][c] == d[r - 1][c - 1] + costs[u][v]:
                if costs[u][v] < APART and u < n:
                    pairs.append((f.post[u], g.post[v]))
                r, c = r - 1, c - 1
            elif (fl[u] != li or gl[v] != lj) and d[r][c] == d[fl[u] - li][gl[v] - lj] + dist[u][v]:
                todo.append((u, v))
                r, c = fl[u] - li, gl[v] - lj
            elif d[r][c] == d[r - 1][c] + 1:
                r -= 1
            else:
                c -= 1
    return dist[n][m], sorted(pairs)


def bounded_mapping(a: Tree, xs: Sequence[int], b: Tree, ys: Sequence[int], most_cells: int | None = None) -> list[tuple[int, int]]:
    """Pairs of the nodes `xs` and `ys`: exact up to `most_cells` cells (MOST_CELLS), by decomposition beyond.

    A larger forest is cut at its roots, which are aligned by their equal subtrees and between
    these one by one in order if they are of one kind; each pair of roots is solved in turn. So
    no node is left out for its forest's size; only the optimum is given up.
    """
    most = most_cells or MOST_CELLS
    out: list[tuple[int, int]] = []
    todo = [(list(xs), list(ys))]
    while todo:
        left, right = todo.pop()
        if not left or not right:
            continue
        f, g = _Forest(a, left), _Forest(b, right)
        flat = len(f.roots) >= MANY_CHILDREN and len(g.roots) >= MANY_CHILDREN
        if len(left) * len(right) <= most and not flat:
            out += exact_mapping(a, left, b, right)[1]
            continue
        same = common_lines([a.full[n] for n in f.roots], [b.full[n] for n in g.roots])
        i0 = j0 = 0
        chosen: list[tuple[int, int]] = []
        for i, j in [*same, (len(f.roots), len(g.roots))]:
            gap = common_lines([a.kind[n] for n in f.roots[i0:i]], [b.kind[n] for n in g.roots[j0:j]])
            chosen += [(f.roots[i0 + p], g.roots[j0 + q]) for p, q in gap]
            if i < len(f.roots) and j < len(g.roots):
                chosen.append((f.roots[i], g.roots[j]))
            i0, j0 = i + 1, j + 1
        for x, y in chosen:
            if _pair_cost(a, x, b, y) < APART:
                out.append((x, y))
            todo.append((_below(f, x), _below(g, y)))
    return sorted(out)


def _below(forest: _Forest, node: int) -> list[int]:
    out, stack = [], list(forest.children[node])
    while stack:
        n = stack.pop()
        out.append(n)
        stack += forest.children[n]
    return sorted(out)
