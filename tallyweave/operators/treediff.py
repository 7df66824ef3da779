"""Tree diffs of pairs: a sequence of passes over one mapping per pair.

The passes depend on each other's decisions, so a pair is solved as a whole, in one Python call per
pair on Arrow batches; pairs are independent and a pair is one file, so tasks stay small.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .linediff import common_lines
from .treedistance import bounded_mapping
from .trees import Tree, parse

MAPPING_SCHEMA = "before_id int, after_id int, operation string, reason string, cost bigint"
#: Subtrees of this size are matched by hash anywhere; smaller ones only under matched parents.
ANCHOR_SIZE = 3
#: Containers of so many unmatched children on both sides are aligned as sequences.
FLAT_CHILDREN = 50
#: Moved subtrees have at least this many nodes.
MOVED_SIZE = 4
# Names that begin a diagnostic statement, and those that begin an import.
DIAGNOSTIC = {"log", "print", "println", "printf", "assert", "assert_eq", "debug", "warn", "error", "console", "panic", "raise", "throw"}
# Words before parentheses and blocks that declare nothing.
CONTROL = {"if", "else", "elif", "for", "foreach", "while", "until", "unless", "do", "loop", "switch", "match", "case", "when", "try", "catch", "except", "finally", "with", "return", "synchronized"}
# Words that may stand before a declaration.
MODIFIERS = {"pub", "public", "private", "protected", "internal", "static", "final", "const", "async", "abstract", "override", "virtual", "inline", "extern", "export", "default", "unsafe", "mut", "readonly", "synchronized"}
IMPORTS = {"import", "use", "from", "include", "require", "using"}


def greedy_assignment(
    before: list, after: list, key: Callable[[object], Hashable], cost: Callable[[object, object], float], most: float, accept: Callable[[object, object], bool] = lambda a, b: True,
    words: Callable[[object], frozenset] | None = None,
) -> list[tuple]:
    """Pairs of equal key in rising order of cost, each item once; ties in input order; `accept` is asked again for each pair.

    Without `words` all pairs of a key are offered. With it `cost` must be one minus the Jaccard
    similarity of the words: only pairs that share one of their rarest words are offered, which no
    pair within `most` fails to do, so the result is the same.
    """
    groups: dict[Hashable, list] = defaultdict(list)
    for j, b in enumerate(after):
        groups[key(b)].append((j, b))
    offers = []
    if words is None:
        offers = [(c, i, j, a, b) for i, a in enumerate(before) for j, b in groups.get(key(a), []) if (c := cost(a, b)) <= most]
    else:
        own = {id(x): words(x) for x in (*before, *after)}
        used = Counter(w for x in own.values() for w in x)

        def rarest(x: object) -> list:
            """All but so many words that a pair within `most` could share only those."""
            w = sorted(own[id(x)], key=lambda w: (used[w], w))
            return w[: len(w) - math.ceil((1 - most) * len(w) - 1e-9) + 1]

        shelves: dict[Hashable, dict] = {}
        for k, members in groups.items():
            shelf = shelves.setdefault(k, defaultdict(list))
            for j, b in members:
                for w in rarest(b):
                    shelf[w].append(j)
        for i, a in enumerate(before):
            shelf = shelves.get(key(a))
            if shelf is None:
                continue
            near = {j for w in rarest(a) for j in shelf.get(w, ())} if own[id(a)] else {j for j, b in groups[key(a)] if not own[id(b)]}
            offers += [(c, i, j, a, after[j]) for j in sorted(near) if (c := cost(a, after[j])) <= most]
    offers.sort(key=lambda x: x[:3])
    used_a: set[int] = set()
    used_b: set[int] = set()
    out = []
    for _, i, j, a, b in offers:
        if i not in used_a and j not in used_b and accept(a, b):
            used_a.add(i)
            used_b.add(j)
            out.append((a, b))
    return out


def edit_distance(a: Tree, b: Tree) -> int:
    """Zhang and Shasha's tree edit distance with unit costs; for small trees and as an oracle."""
    pa_, pb = a.postorder(), b.postorder()
    if not pa_ or not pb:
        return len(pa_) + len(pb)

    def prepare(tree: Tree, post: list[int]) -> tuple[list[int], list[int]]:
        place = {n: i for i, n in enumerate(post)}
        leftmost = []
        for n in post:
            while tree.children[n]:
                n = tree.children[n][0]
            leftmost.append(place[n])
        roots = {}
        for i, left in enumerate(leftmost):
            roots[left] = i
        return leftmost, sorted(roots.values())

    la, ka = prepare(a, pa_)
    lb, kb = prepare(b, pb)
    dist = [[0] * len(pb) for _ in pa_]
    for i in ka:
        for j in kb:
            rows, columns = i - la[i] + 2, j - lb[j] + 2
            d = [[0] * columns for _ in range(rows)]
            for x in range(1, rows):
                d[x][0] = d[x - 1][0] + 1
            for y in range(1, columns):
                d[0][y] = d[0][y - 1] + 1
            for x in range(1, rows):
                for y in range(1, columns):
                    u, v = la[i] + x - 1, lb[j] + y - 1
                    if la[u] == la[i] and lb[v] == lb[j]:
                        n, m = pa_[u], pb[v]
                        same = a.kind[n] == b.kind[m] and a.text[n] == b.text[m]
                        d[x][y] = dist[u][v] = min(d[x - 1][y] + 1, d[x][y - 1] + 1, d[x - 1][y - 1] + (not same))
                    else:
                        d[x][y] = min(d[x - 1][y] + 1, d[x][y - 1] + 1, d[la[u] - la[i]][lb[v] - lb[j]] + dist[u][v])
    return dist[-1][-1]


class PairDiff:
    """The mapping of one pair while its passes run."""

    def __init__(self, before: Tree, after: Tree):
        self.a, self.b = before, after
        self.to: dict[int, int] = {}
        self.back: dict[int, int] = {}
        self.why: dict[int, str] = {}
        # How many nodes of each subtree are matched.
        self.taken = ([0] * (len(before) + 1), [0] * (len(after) + 1))

    def copy(self) -> PairDiff:
        """A diff of the same trees that goes on from here by itself."""
        d = object.__new__(PairDiff)
        d.a, d.b = self.a, self.b
        d.to, d.back, d.why = self.to.copy(), self.back.copy(), self.why.copy()
        d.taken = (self.taken[0].copy(), self.taken[1].copy())
        return d

    # basic moves

    def pair(self, x: int, y: int, reason: str) -> bool:
        if x in self.to or y in self.back:
            return False
        self.to[x], self.back[y], self.why[x] = y, x, reason
        self._count(x, y, 1)
        return True

    def _count(self, x: int, y: int, by: int) -> None:
        for tree, taken, n in ((self.a, self.taken[0], x), (self.b, self.taken[1], y)):
            while n:
                taken[n] += by
                n = tree.parent[n]

    def unpair(self, x: int) -> None:
        y = self.to.pop(x)
        del self.back[y]
        self.why.pop(x, None)
        self._count(x, y, -1)

    def pair_whole(self, x: int, y: int, reason: str, below: str) -> None:
        """Pairs two subtrees of equal shape node by node; both are free."""
        for i, (p, q) in enumerate(zip(self.a.inside(x), self.b.inside(y), strict=True)):
            self.to[p], self.back[q], self.why[p] = q, p, reason if i == 0 else below
        for tree, taken, node in ((self.a, self.taken[0], x), (self.b, self.taken[1], y)):
            for n in tree.inside(node):
                taken[n] = tree.size[n]
            n = tree.parent[node]
            while n:
                taken[n] += tree.size[node]
                n = tree.parent[n]

    def free(self, tree: Tree, node: int) -> bool:
        """Whether nothing of the subtree is matched."""
        return not self.taken[0 if tree is self.a else 1][node]

    def operation(self, x: int) -> str:
        y = self.to[x]
        a, b = self.a, self.b
        if a.kind[x] == b.kind[y] and a.text[x] == b.text[y]:
            return "Identical" if a.full[x] == b.full[y] else "MatchButNotIdentical"
        return "Update" if not a.children[x] and not b.children[y] else "MatchButNotIdentical"

    def _is_import(self, tree: Tree, node: int) -> bool:
        return tree.kind[node] == "statement" and bool(tree.children[node]) and tree.text[tree.children[node][0]].lower() in IMPORTS

    # passes

    def hash_descent(self) -> None:
        """Equal subtrees, the largest first; then subtrees of equal shape, imports left out."""
        for name, reason, below, least in (("full", "IdenticalHash", "IdenticalHashOfAncestor", ANCHOR_SIZE), ("shape", "StructurallyIdenticalSubtrees", "StructurallyIdenticalAncestor", 2 * ANCHOR_SIZE)):
            ours, theirs = getattr(self.a, name), getattr(self.b, name)
            # Free nodes by hash, and by hash and parent, ascending; what is taken meanwhile leaves when it is met.
            everywhere: dict[int, list[int]] = defaultdict(list)
            at_home: dict[tuple[int, int], list[int]] = defaultdict(list)
            for n in range(1, len(self.b) + 1):
                if self.b.size[n] >= least and not self.taken[1][n]:
                    everywhere[theirs[n]].append(n)
                    at_home[theirs[n], self.b.parent[n]].append(n)
            count = Counter(ours[1:])
            shift: dict[int, int] = {}  # by parent: where its children went, to tell twins apart
            for x in sorted((n for n in range(1, len(self.a) + 1) if self.a.size[n] >= least), key=lambda n: (-self.a.size[n], n)):
                h = ours[x]
                if h not in everywhere or self.taken[0][x] or reason.startswith("Struct") and (count[h] != 1 or self._is_import(self.a, x)):
                    continue
                if reason.startswith("Struct"):
                    everywhere[h] = [y for y in everywhere[h] if not self.taken[1][y]]
                    if len(everywhere[h]) != 1:
                        continue
                aim = x + shift.get(self.a.parent[x], 0)
                y = self._nearest(at_home.get((h, self.to.get(self.a.parent[x], -1))), aim) or self._nearest(everywhere[h], aim)
                if y:
                    self.pair_whole(x, y, reason, below)
                    shift[self.a.parent[x]] = y - x

    def _nearest(self, choices: list[int] | None, aim: int) -> int:
        """The free node nearest to `aim`, the smaller of two; nodes that are taken are removed on the way."""
        if not choices:
            return 0
        at = bisect_left(choices, aim)
        while at < len(choices) and self.taken[1][choices[at]]:
            del choices[at]
        while at and self.taken[1][choices[at - 1]]:
            at -= 1
            del choices[at]
        near = [choices[k] for k in (at - 1, at) if 0 <= k < len(choices)]
        return min(near, key=lambda c: (abs(c - aim), c), default=0)

    @staticmethod
    def _qualified(tree: Tree) -> dict[tuple[str, ...], list[int]]:
        """Statements that declare something with a block, by the names on the way to them."""
        found: dict[tuple[str, ...], list[int]] = defaultdict(list)
        names: dict[int, tuple[str, ...]] = {}
        for n in range(1, len(tree) + 1):
            outer = names.get(tree.parent[n], ())
            names[n] = outer
            kids = tree.children[n]
            if tree.kind[n] != "statement" or not any(tree.kind[k] == "braces" for k in kids):
                continue
            # the name right before the parameters, else the last one before the block
            stop = next((i for i, k in enumerate(kids) if tree.kind[k] in ("parens", "braces")), 0)
            own = next((tree.text[k] for k in reversed(kids[:stop]) if tree.kind[k] == "name"), "")
            if own and own not in CONTROL:
                names[n] = (*outer, own)
                found[names[n]].append(n)
        return found

    def qualified_names(self) -> None:
        """Declarations that are alone of their qualified name on both sides, unless what is matched inside lies elsewhere."""
        left, right = self._qualified(self.a), self._qualified(self.b)
        for name in sorted(left):
            if len(left[name]) == 1 and len(right.get(name, [])) == 1:
                x, y = left[name][0], right[name][0]
                inside = self.b.inside(y)
                if all(self.to[k] in inside for k in self.a.inside(x) if k in self.to):
                    self.pair(x, y, "QualifiedName")

    def resolve_inside(self, x: int, y: int) -> None:
        """What is unmatched below a pair is matched by its bounded edit distance."""
        xs = [n for n in self.a.inside(x) if n not in self.to]
        ys = [n for n in self.b.inside(y) if n not in self.back]
        if xs and ys:
            for p, q in bounded_mapping(self.a, xs, self.b, ys):
                self.pair(p, q, "EditDistanceInside")

    def inside_of_names(self) -> None:
        """The rest of each declaration that was found by its name, by edit distance inside it alone."""
        for x, y in sorted(self.to.items()):
            if self.why[x] == "QualifiedName":
                self.resolve_inside(x, y)

    def flat_containers(self) -> None:
        """Children of paired containers of many children: equal ones in order, then what lies alone between them on both sides."""
        for x, y in sorted(self.to.items()):
            left, right = ([c for c in tree.children[n] if not taken[c]] for tree, taken, n in ((self.a, self.taken[0], x), (self.b, self.taken[1], y)))
            if min(len(left), len(right)) < FLAT_CHILDREN:
                continue
            before = (-1, -1)
            for i, j in [*common_lines([self.a.full[c] for c in left], [self.b.full[c] for c in right]), (len(left), len(right))]:
                if i - before[0] == j - before[1] == 2 and self.a.kind[left[i - 1]] == self.b.kind[right[j - 1]]:
                    self.pair(left[i - 1], right[j - 1], "FlatSubtree")
                if i < len(left):
                    self.pair_whole(left[i], right[j], "FlatSubtree", "FlatSubtree")
                before = (i, j)

    def similar_imports(self, least: float = 0.5) -> None:
        """Unmatched imports of similar words, the most similar first, unless a second import before is as similar."""
        words = lambda t, n: frozenset(t.text[k].lower() for k in t.inside(n) if t.text[k].isidentifier()) - IMPORTS
        xs = {x: words(self.a, x) for x in self.a.statements if self._is_import(self.a, x) and self.free(self.a, x)}
        holders: dict[str, list[int]] = defaultdict(list)
        for x, w in xs.items():
            for word in w:
                holders[word].append(x)
        offers: list[tuple[float, int, int]] = []
        for y in self.b.statements:
            if not self._is_import(self.b, y) or not self.free(self.b, y):
                continue
            own = words(self.b, y)
            near = {x: len(own & xs[x]) / len(own | xs[x]) for x in sorted({x for word in own for x in holders.get(word, ())})}
            best = sorted(near.items(), key=lambda e: (-e[1], e[0]))[:2]
            if best and best[0][1] >= least and (len(best) == 1 or best[1][1] < best[0][1]):
                offers.append((-best[0][1], best[0][0], y))
        for _, x, y in sorted(offers):
            if self.free(self.a, x) and self.free(self.b, y) and self.pair(x, y, "SimilarImport"):
                self.resolve_inside(x, y)

    def anchor_blocks(self) -> None:
        """Unmatched blocks pair if each holds most of what is matched in the other; the rest inside goes by edit distance."""
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for x, y in self.to.items():
            p, q = self.a.parent[x], self.b.parent[y]
            while p and (p in self.to or self.a.kind[p] != "braces"):
                p = self.a.parent[p]
            while q and (q in self.back or self.b.kind[q] != "braces"):
                q = self.b.parent[q]
            if p and q:
                votes[p, q] += 1
        for (p, q), n in sorted(votes.items(), key=lambda e: (-e[1], e[0])):
            if p not in self.to and q not in self.back and 2 * n > self.taken[0][p] and 2 * n > self.taken[1][q]:
                self.pair(p, q, "AnchorBlock")
                self.resolve_inside(p, q)

    def wrapped_blocks(self) -> None:
        """A body that moved into a new wrapper: the outer body pairs with the outer one, the statements stay paired inside."""
        for x, y in sorted(self.to.items()):
            if self.a.kind[x] != "braces" or self.b.kind[y] != "braces" or self.to.get(self.a.parent[x]) == self.b.parent[y]:
                continue
            owner = self.to.get(self.a.parent[x])
            outer = self.b.parent[y]
            while outer and not (self.b.kind[outer] == "braces" and self.b.parent[outer] == owner):
                outer = self.b.parent[outer]
            if owner and outer and outer not in self.back:
                self.unpair(x)
                self.pair(x, outer, "WrappedBlock")

    def collapsed_conditions(self) -> None:
        """Two nested conditions that became one, or the reverse: the outer statement pairs with it, and the words of both conditions with its own."""
        for flip in (False, True):
            one, two = (self.b, self.a) if flip else (self.a, self.b)
            there = self.back if flip else self.to
            for outer in one.statements:
                inner = self._only_condition(one, outer)
                if not inner:
                    continue
                body = one.children[inner][-1]
                block = there.get(body, 0)
                whole = two.parent[block] if block else 0
                if not whole or not self._is_condition(two, whole) or outer in there:
                    continue
                x, y = (whole, outer) if flip else (outer, whole)
                if there.get(inner) == whole:  # lifted from the body
                    self.unpair(whole if flip else inner)
                if self.pair(x, y, "CollapsedCondition"):
                    leaves = lambda tree, nodes: [k for n in nodes for k in tree.inside(n) if not tree.children[k] and tree.kind[k] != "mark"]
                    left = leaves(one, [*one.children[outer][:-1], *one.children[inner][:-1]])
                    right = leaves(two, two.children[whole][:-1])
                    for i, j in common_lines([(one.kind[k], one.text[k]) for k in left], [(two.kind[k], two.text[k]) for k in right]):
                        self.pair(*((right[j], left[i]) if flip else (left[i], right[j])), "CollapsedCondition")

    @staticmethod
    def _is_condition(tree: Tree, n: int) -> bool:
        kids = tree.children[n]
        return tree.kind[n] == "statement" and len(kids) > 1 and tree.text[kids[0]] == "if" and tree.kind[kids[-1]] == "braces"

    def _only_condition(self, tree: Tree, n: int) -> int:
        """The condition that is all there is in the block of the condition `n`, or 0."""
        if not self._is_condition(tree, n):
            return 0
        inner = tree.children[tree.children[n][-1]]
        return inner[0] if len(inner) == 1 and self._is_condition(tree, inner[0]) else 0

    def renamed_twins(self) -> None:
        """Unmatched subtrees of one shape under a matched pair, equally many on either side, pair in order."""
        for x, y in sorted(self.to.items()):
            if self.taken[0][x] == self.a.size[x] or self.taken[1][y] == self.b.size[y]:
                continue
            left: dict[int, list[int]] = defaultdict(list)
            right: dict[int, list[int]] = defaultdict(list)
            for tree, taken, n, found in ((self.a, self.taken[0], x, left), (self.b, self.taken[1], y, right)):
                for c in tree.children[n]:
                    if tree.children[c] and not taken[c]:
                        found[tree.shape[c]].append(c)
            for h in sorted(left):
                if len(left[h]) == len(right.get(h, [])):
                    for p, q in zip(left[h], right[h], strict=True):
                        self.pair_whole(p, q, "RenamedTwin", "RenamedTwin")

    def replaced_atoms(self) -> None:
        """A leaf that is lost and one that is new between neighbours that correspond: one replaced the other."""
        for x, y in sorted(self.to.items()):
            if self.taken[0][x] == self.a.size[x] or self.taken[1][y] == self.b.size[y]:
                continue
            for p in self.a.children[x]:
                if p in self.to or self.a.children[p]:
                    continue
                left, right = self._before(self.a, p), self._after(self.a, p)
                if not left and not right:
                    continue
                q = self._after(self.b, self.to[left]) if left in self.to else self.b.children[y][0] if not left else 0
                if not q or self.b.parent[q] != y or q in self.back or self.b.children[q] or self.b.kind[q] != self.a.kind[p]:
                    continue
                if (self._after(self.b, q) == self.to.get(right, -1)) if right else not self._after(self.b, q):
                    self.pair(p, q, "ReplacedAtom")

    def mutual_ancestors(self) -> None:
        """Unmatched inner nodes of one kind whose matched descendants all lie in each other."""
        # By node before: the least and greatest partner below, and their number.
        lows, highs, counts = [1 << 60] * (len(self.a) + 1), [0] * (len(self.a) + 1), [0] * (len(self.a) + 1)
        to, parents, children = self.to, self.a.parent, self.a.children
        for x in range(len(self.a), 0, -1):
            low, high, n = lows[x], highs[x], counts[x]
            y = to.get(x)
            if y:
                if y < low:
                    low = y
                if y > high:
                    high = y
                n += 1
            if not n:
                continue
            p = parents[x]
            if low < lows[p]:
                lows[p] = low
            if high > highs[p]:
                highs[p] = high
            counts[p] += n
            if y or not children[x]:
                continue
            q = self.b.parent[low] if low == high else low
            while q and not (q <= low and high < q + self.b.size[q] and q not in self.back):
                q = self.b.parent[q]
            if q and self.b.kind[q] == self.a.kind[x] and self.taken[1][q] == n:
                self.pair(x, q, "MutualAncestor")
                lows[p], highs[p] = min(lows[p], q), max(highs[p], q)
                counts[p] += 1

    def wrap_growth(self) -> None:
        """Retags equal blocks that got a new wrapper around them."""
        for x, y in sorted(self.to.items()):
            p, q = self.a.parent[x], self.b.parent[y]
            if self.a.full[x] == self.b.full[y] and self.a.children[x] and p in self.to and q and q not in self.back and self.to[p] in self._ancestors(self.b, y):
                self.why[x] = "WrapGrowth"

    @staticmethod
    def _ancestors(tree: Tree, n: int) -> set[int]:
        out = set()
        while tree.parent[n]:
            n = tree.parent[n]
            out.add(n)
        return out

    def extra_copies(self) -> list[tuple[int, list[int]]]:
        """(before node, after nodes): statements that are in `after` more often than before, as one-to-many maps."""
        more: dict[int, list[int]] = defaultdict(list)
        for y in range(1, len(self.b) + 1):
            if self.b.kind[y] == "statement" and self.b.size[y] >= MOVED_SIZE and self.free(self.b, y):
                more[self.b.full[y]].append(y)
        return [(x, [y, *more[self.a.full[x]]]) for x, y in sorted(self.to.items()) if self.a.kind[x] == "statement" and self.a.full[x] == self.b.full[y] and more.get(self.a.full[x])]

    def diagnostics(self) -> None:
        """Unmatched log and assert statements of equal text, the biggest first, in order."""
        queue: dict[int, deque] = defaultdict(deque)
        is_one = lambda t, n: t.children[n] and t.text[t.children[n][0]].lower() in DIAGNOSTIC
        for y in self.b.statements:
            if self.free(self.b, y) and is_one(self.b, y):
                queue[self.b.full[y]].append(y)
        for x in sorted((n for n in self.a.statements if self.free(self.a, n) and is_one(self.a, n)), key=lambda n: (-self.a.size[n], n)):
            if queue[self.a.full[x]]:
                self.pair_whole(x, queue[self.a.full[x]].popleft(), "IdenticalHash", "IdenticalHashOfAncestor")

    def bottom_up(self) -> None:
        """Inner nodes of one kind pair if most of their matched descendants are in each other."""
        for x in range(len(self.a), 0, -1):
            if x in self.to or not self.a.children[x]:
                continue
            votes: dict[int, int] = defaultdict(int)
            for c in self.a.children[x]:
                y = self.to.get(c)
                if y and self.b.parent[y] and self.b.parent[y] not in self.back and self.b.kind[self.b.parent[y]] == self.a.kind[x]:
                    votes[self.b.parent[y]] += self.a.size[c]
            if votes:
                self.pair(x, max(votes, key=lambda y: (votes[y], -y)), "BottomUpPropagation")

    def grouped_greedy(self, most: float = 0.6) -> None:
        """Unmatched statements and groups of one kind under matched parents, by the share of words they don't have in common."""

        def words(tree: Tree, n: int) -> frozenset:
            return frozenset(tree.text[k] for k in tree.inside(n) if tree.text[k])

        xs = [x for x in range(2, len(self.a) + 1) if x not in self.to and self.a.children[x] and self.a.parent[x] in self.to]
        ys = [y for y in range(2, len(self.b) + 1) if y not in self.back and self.b.children[y] and self.b.parent[y] in self.back]
        side_a, side_b = {x: words(self.a, x) for x in xs}, {y: words(self.b, y) for y in ys}
        items = [("a", x) for x in xs], [("b", y) for y in ys]
        key = lambda n: (self.a.kind[n[1]], self.a.parent[n[1]]) if n[0] == "a" else (self.b.kind[n[1]], self.back[self.b.parent[n[1]]])

        def cost(p: tuple, q: tuple) -> float:
            u, v = side_a[p[1]], side_b[q[1]]
            return 1 - len(u & v) / max(1, len(u | v))

        either = lambda n: side_a[n[1]] if n[0] == "a" else side_b[n[1]]
        for p, q in greedy_assignment(*items, key, cost, most, lambda p, q: p[1] not in self.to and q[1] not in self.back, either):
            self.pair(p[1], q[1], "GroupedGreedy")

    def leading_siblings(self) -> None:
        """Unmatched comments and modifiers right before matched nodes pair back to the first difference."""
        for x in sorted(self.to):
            y = self.to[x]
            left, right = self._before(self.a, x), self._before(self.b, y)
            while left and right and left not in self.to and right not in self.back and self.a.kind[left] == self.b.kind[right] and self.a.text[left] == self.b.text[right] and (self.a.kind[left] == "comment" or self.a.text[left] in MODIFIERS):
                self.pair(left, right, "LeadingSibling")
                left, right = self._before(self.a, left), self._before(self.b, right)

    @staticmethod
    def _before(tree: Tree, n: int) -> int:
        i = tree.place[n]
        return tree.children[tree.parent[n]][i - 1] if i else 0

    @staticmethod
    def _after(tree: Tree, n: int) -> int:
        kids = tree.children[tree.parent[n]]
        i = tree.place[n]
        return kids[i + 1] if i + 1 < len(kids) else 0

    def unique_type(self) -> None:
        """Under each matched pair, a kind with one unmatched child on either side pairs (a snapshot, no fixpoint)."""
        for x, y in sorted(self.to.items()):
            left: dict[str, list[int]] = defaultdict(list)
            right: dict[str, list[int]] = defaultdict(list)
            for c in self.a.children[x]:
                if c not in self.to:
                    left[self.a.kind[c]].append(c)
            for c in self.b.children[y]:
                if c not in self.back:
                    right[self.b.kind[c]].append(c)
            for kind in sorted(left):
                if len(left[kind]) == 1 and len(right.get(kind, [])) == 1 and self.pair(left[kind][0], right[kind][0], "UniqueTypeMatching"):
                    self.resolve_inside(left[kind][0], right[kind][0])

    def orphaned_leaves(self) -> None:
        """Leaves of equal kind and text under matched parents, equally many on either side, pair in order unless a neighbour went elsewhere."""
        for x, y in sorted(self.to.items()):
            left: dict[tuple, list[int]] = defaultdict(list)
            right: dict[tuple, list[int]] = defaultdict(list)
            for c in self.a.children[x]:
                if c not in self.to and not self.a.children[c]:
                    left[self.a.kind[c], self.a.text[c]].append(c)
            for c in self.b.children[y]:
                if c not in self.back and not self.b.children[c]:
                    right[self.b.kind[c], self.b.text[c]].append(c)
            for k in sorted(left):
                if len(left[k]) == len(right.get(k, [])):
                    for p, q in zip(left[k], right[k], strict=True):
                        if not self._neighbour_elsewhere(p, y):
                            self.pair(p, q, "OrphanedLeafUnderMatchedParent")

    def _neighbour_elsewhere(self, leaf: int, home: int) -> bool:
        return any(n in self.to and self.b.parent[self.to[n]] != home for n in (self._before(self.a, leaf), self._after(self.a, leaf)) if n)

    def permuted_leaves(self) -> None:
        """Renamed leaves of one parent pair and kind: unique equal texts find each other, the rest pairs in order."""
        groups: dict[tuple, list[int]] = defaultdict(list)
        for x, y in sorted(self.to.items()):
            if not self.a.children[x] and not self.b.children[y] and self.a.text[x] != self.b.text[y] and self.to.get(self.a.parent[x]) == self.b.parent[y]:
                groups[self.a.parent[x], self.a.kind[x]].append(x)
        for xs in groups.values():
            if len(xs) < 2:
                continue
            ys = sorted(self.to[x] for x in xs)
            texts_a = [self.a.text[x] for x in xs]
            texts_b = [self.b.text[y] for y in ys]
            for x in xs:
                self.unpair(x)
            often_a, often_b, where = Counter(texts_a), Counter(texts_b), dict(zip(texts_b, ys, strict=True))
            for x in xs:
                t = self.a.text[x]
                if often_a[t] == 1 and often_b[t] == 1:
                    self.pair(x, where[t], "PermutedLeaf")
            rest_a = [x for x in xs if x not in self.to]
            rest_b = [y for y in ys if y not in self.back]
            for x, y in zip(rest_a, rest_b, strict=True):
                self.pair(x, y, "PermutedLeaf")

    def stray_renames(self) -> None:
        """Renamed leaves whose parents have nothing to do with each other come apart, if the old parent lost another child."""
        for x, y in sorted(self.to.items()):
            if self.a.children[x] or self.b.children[y] or self.a.text[x] == self.b.text[y]:
                continue
            p, q = self.a.parent[x], self.b.parent[y]
            if self.to.get(p) != q and self.a.kind[p] != self.b.kind[q] and any(c not in self.to for c in self.a.children[p] if c != x and self.a.kind[c] != "mark"):
                self.unpair(x)

    def stray_terminators(self) -> None:
        """A closing semicolon stays with its statement."""
        for x, y in sorted(self.to.items()):
            if self.a.text[x] == self.b.text[y] == ";" and self.to.get(self.a.parent[x]) != self.b.parent[y] and len(self.a.children[self.a.parent[x]]) > 1:
                self.unpair(x)

    def sibling_terminators(self) -> None:
        """The semicolon after an inner node pairs with the one right after the node's partner, where its parent has two inner nodes or more."""
        for x, y in sorted(self.to.items()):
            if not self.a.children[x] or not self.b.children[y]:
                continue
            s, t = self._after(self.a, x), self._after(self.b, y)
            if s and t and self.a.text[s] == self.b.text[t] == ";" and self.to.get(s) != t and sum(bool(self.a.children[c]) for c in self.a.children[self.a.parent[x]]) > 1:
                if s in self.to:
                    self.unpair(s)
                if t in self.back:
                    self.unpair(self.back[t])
                self.pair(s, t, "SiblingTerminator")

    def unrelated_imports(self) -> None:
        """Imports that share no word of their paths come apart with all in them."""
        for x, y in sorted(self.to.items()):
            if x not in self.to or not self._is_import(self.a, x) or not self._is_import(self.b, y) or self.a.full[x] == self.b.full[y]:
                continue
            words = [{t.text[k].lower() for k in t.inside(n) if t.text[k].isidentifier()} - IMPORTS for t, n in ((self.a, x), (self.b, y))]
            if words[0] and words[1] and not words[0] & words[1]:
                for k in self.a.inside(x):
                    if k in self.to and self.to[k] in self.b.inside(y):
                        self.unpair(k)

    def surviving_values(self) -> None:
        """A lost and a new leaf of one text that are alone of it under paired ancestors are one value that survived."""
        slots: dict[tuple, list[list[int]]] = defaultdict(lambda: [[], []])
        for side, tree, taken in ((0, self.a, self.to), (1, self.b, self.back)):
            for n in sorted(set(range(2, len(tree) + 1)).difference(taken)):
                if tree.children[n] or tree.kind[n] in ("mark", "comment"):
                    continue
                up = tree.parent[n]
                while up and up not in taken:
                    up = tree.parent[up]
                if up and tree.kind[up] != "unit":
                    slots[(up if side == 0 else self.back[up]), tree.text[n]][side].append(n)
        for (_, _), (xs, ys) in sorted(slots.items()):
            if len(xs) == len(ys) == 1:
                self.pair(xs[0], ys[0], "SurvivingValue")

    def moved_subtrees(self) -> None:
        """Subtrees that are lost here and new there, byte for byte."""
        lost: dict[int, deque] = defaultdict(deque)
        for y in range(1, len(self.b) + 1):
            if self.b.size[y] >= MOVED_SIZE and self.free(self.b, y):
                lost[self.b.full[y]].append(y)
        for x in range(1, len(self.a) + 1):
            if self.a.size[x] >= MOVED_SIZE and self.free(self.a, x):
                while lost[self.a.full[x]] and not self.free(self.b, lost[self.a.full[x]][0]):
                    lost[self.a.full[x]].popleft()
                if lost[self.a.full[x]]:
                    self.pair_whole(x, lost[self.a.full[x]].popleft(), "MovedSubtree", "MovedSubtree")

    def residual(self) -> None:
        """The longest common subsequence of what is left, in preorder, by kind and text."""
        xs = [x for x in range(1, len(self.a) + 1) if x not in self.to]
        ys = [y for y in range(1, len(self.b) + 1) if y not in self.back]
        for i, j in common_lines([(self.a.kind[x], self.a.text[x]) for x in xs], [(self.b.kind[y], self.b.text[y]) for y in ys]):
            p, q = self.a.parent[xs[i]], self.b.parent[ys[j]]
            if self.to.get(p) == q or p not in self.to and q not in self.back:
                self.pair(xs[i], ys[j], "ResidualSequence")

    def heritage_growth(self) -> None:
        """Retags shifted equal blocks whose predecessors correspond: the head before them grew."""
        for x, y in sorted(self.to.items()):
            if self.a.kind[x] == "braces" and self.a.full[x] == self.b.full[y] and x != y:
                p, q = self._before(self.a, x), self._before(self.b, y)
                if p and q and p in self.to and self.to[p] != q and self.b.parent[self.to[p]] == self.b.parent[q]:
                    self.why[x] = "HeritageClauseGrowth"

    PASSES = (
        "hash_descent", "flat_containers", "diagnostics", "qualified_names", "bottom_up", "collapsed_conditions", "wrapped_blocks", "similar_imports", "renamed_twins", "grouped_greedy", "anchor_blocks", "inside_of_names",
        "unique_type", "leading_siblings", "orphaned_leaves", "replaced_atoms", "residual", "moved_subtrees", "mutual_ancestors", "stray_renames", "stray_terminators", "sibling_terminators", "unrelated_imports", "surviving_values", "permuted_leaves", "heritage_growth", "wrap_growth",
    )

    #: Passes that only say why, so that no cost depends on them.
    RETAGGING = frozenset({"heritage_growth", "wrap_growth"})

    def _pair_roots(self) -> None:
        if len(self.a) and len(self.b) and 1 not in self.to and 1 not in self.back:
            self.pair(1, 1, "UnresolvedNode")

    def cost(self) -> int:
        """The summed cost of rows()."""
        self._pair_roots()
        a, b = self.a, self.b
        own = 0
        for x, y in self.to.items():
            if a.text[x] != b.text[y] or a.kind[x] != b.kind[y] and not a.children[x] and not b.children[y]:
                own += 1
        return own + len(a) + len(b) - 2 * len(self.to)

    def rows(self) -> list[tuple[int, int, str, str, int]]:
        """Every node of both trees exactly once; 0 is a missing side."""
        out = []
        self._pair_roots()
        for x in range(1, len(self.a) + 1):
            if x in self.to:
                op = self.operation(x)
                own = op == "Update" or op == "MatchButNotIdentical" and self.a.text[x] != self.b.text[self.to[x]]
                out.append((x, self.to[x], op, self.why[x], int(own)))
            else:
                out.append((x, 0, "Delete", "UnresolvedNode", 1))
        out += [(0, y, "Insert", "UnresolvedNode", 1) for y in range(1, len(self.b) + 1) if y not in self.back]
        return out


def diff_trees(before: Tree | None, after: Tree | None, without: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str, int]]:
    """The mapping of a pair after all passes but those in `without`; a missing tree makes the other all deleted or inserted."""
    d = PairDiff(before or Tree().finish(), after or Tree().finish())
    if before is not None and after is not None:
        for name in PairDiff.PASSES:
            if name not in without:
                getattr(d, name)()
    return d.rows()


def costs_without(before: Tree, after: Tree, names: list[str]) -> dict[str, int]:
    """The cost of a pair's mapping with each of the passes `names` left out, or none for a name that isn't one.

    A pass left out changes nothing before it, so all begin as one. A mapping that leaves a pass
    out goes its own way from there, as long as it differs from the one with all passes: what
    passes do depends on the mapping alone.
    """
    d = PairDiff(before, after)
    apart: dict[str, PairDiff] = {}
    if len(before) and len(after):
        for name in PairDiff.PASSES:
            if name in PairDiff.RETAGGING:
                continue
            if name in names:
                apart[name] = d.copy()
            getattr(d, name)()
            for other, fork in list(apart.items()):
                if other != name:
                    getattr(fork, name)()
                if fork.to == d.to:
                    del apart[other]
    whole = d.cost()
    return {n: apart[n].cost() if n in apart else whole for n in names}


def tree_mapping(pairs: DataFrame, key: str, before: str, after: str, language: str, without: frozenset[str] = frozenset()) -> DataFrame:
    """key and MAPPING_SCHEMA for every node of both sides of every pair. No shuffle; one pair is one unit of work."""
    source = pairs.select(key, before, after, language)
    kind = dict(source.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (b, a, lang) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                rows = diff_trees(parse(b, lang), parse(a, lang), without)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)]
                    own = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *columns], names=[key, "before_id", "after_id", "operation", "reason", "cost"])

    return spread(source).mapInArrow(work, f"`{key}` {kind}, {MAPPING_SCHEMA}")


def copied_statements(pairs: DataFrame, key: str, before: str, after: str, language: str) -> DataFrame:
    """key, before_id, after_ids: statements that one side has once and the other several times."""
    source = pairs.select(key, before, after, language)
    kind = dict(source.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, many = [], [], []
            for i, (b, a, lang) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                left, right = parse(b, lang), parse(a, lang)
                if left is None or right is None:
                    continue
                d = PairDiff(left, right)
                for name in PairDiff.PASSES:
                    getattr(d, name)()
                for x, ys in d.extra_copies():
                    at.append(i)
                    ids.append(x)
                    many.append(ys)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int32()), pa.array(many, pa.list_(pa.int32()))], names=[key, "before_id", "after_ids"])

    return spread(source).mapInArrow(work, f"`{key}` {kind}, before_id int, after_ids array<int>")
