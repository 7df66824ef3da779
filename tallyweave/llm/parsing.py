"""Table-driven parsing: grammars in a small notation, their LR tables, and a recogniser.

A grammar is text of rules `name = alternatives ;` with quoted terminals, upper-case token classes,
groups and `? * +`. Rules are expanded to productions without empty ones; the tables are SLR(1).
Where a cell of a table holds several actions, the recogniser follows them all side by side, so a
grammar may be ambiguous and any look-ahead will do.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import product

END = "$end"

_TOKEN = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:(?P<name>[A-Za-z_][\w]*)|'(?P<quoted>[^'\s]+)'|(?P<mark>[=|;()?*+]))")


def _scan(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if re.fullmatch(r"\s*(#[^\n]*\s*)*", text[at:] + "\n"):
                break
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class Grammar:
    """Productions (left side, right side) over numbered symbols; no right side is empty."""

    def __init__(self, text: str, start: str):
        self.rules: dict[str, list] = {}
        tokens = deque(_scan(text))
        while tokens:
            _, name = tokens.popleft()
            assert tokens.popleft()[1] == "=", name
            self.rules.setdefault(name, []).extend(self._alternatives(tokens, ";"))
        self.extra = 0
        self.flat: dict[str, list[tuple[str, ...]]] = {}
        self.plus: dict[tuple, str] = {}
        self.nullable: set[str] = set()
        self._find_nullable()
        for name in list(self.rules):
            self.flat[f"<{name}>"] = [s for alt in self.rules[name] for s in self._sequences(alt) if s]
        self.start = f"<{start}>"
        self.start_empty = start in self.nullable
        self.productions = [(n, s) for n in self.flat for s in dict.fromkeys(self.flat[n]) if s != (n,)]

    def _alternatives(self, tokens: deque, closing: str) -> list:
        alts, now = [], []
        while True:
            kind, value = tokens.popleft()
            if kind == "mark" and value == closing:
                return [*alts, now]
            if kind == "mark" and value == "|":
                alts.append(now)
                now = []
            elif kind == "mark" and value == "(":
                now.append(("group", self._alternatives(tokens, ")")))
            elif kind == "mark" and value in "?*+":
                now[-1] = (value, now[-1])
            elif kind == "quoted" or value.isupper():
                now.append(("token", value))
            else:
                now.append(("rule", value))

    def _is_nullable(self, node: tuple) -> bool:
        kind, of = node
        if kind in ("?", "*"):
            return True
        if kind == "+":
            return self._is_nullable(of)
        if kind == "group":
            return any(all(map(self._is_nullable, alt)) for alt in of)
        return kind == "rule" and of in self.nullable

    def _find_nullable(self) -> None:
        grew = True
        while grew:
            grew = False
            for name, alts in self.rules.items():
                if name not in self.nullable and any(all(map(self._is_nullable, alt)) for alt in alts):
                    self.nullable.add(name)
                    grew = True

    def _fresh(self, alternatives: list[tuple[str, ...]]) -> str:
        name = f"<{self.extra}>"
        self.extra += 1
        self.flat[name] = alternatives
        return name

    def _options(self, node: tuple) -> list[tuple[str, ...]]:
        """The right sides that a node may become, of length 0 or 1 where there are many."""
        kind, of = node
        if kind == "token":
            return [(of,)]
        if kind == "rule":
            assert of in self.rules, of
            return [(f"<{of}>",), ()] if of in self.nullable else [(f"<{of}>",)]
        if kind == "?":
            return list(dict.fromkeys([*self._options(of), ()]))
        if kind in "*+":
            key = repr(of)
            if key not in self.plus:
                inner = [s for s in self._options(of) if s]
                name = self._fresh([])
                self.plus[key] = name
                self.flat[name] = [*inner, *((name, *s) for s in inner)]
            return [(self.plus[key],), *([()] if kind == "*" or self._is_nullable(of) else [])]
        found = [s for alt in of for s in self._sequences(alt)]
        whole = [s for s in dict.fromkeys(found) if s]
        if len(whole) > 1:
            key = ("group", *whole)
            if key not in self.plus:
                self.plus[key] = self._fresh(whole)
            whole = [(self.plus[key],)]
        return whole + ([()] if () in found else [])

    def _sequences(self, alt: list) -> list[tuple[str, ...]]:
        return [sum(parts, ()) for parts in product(*(self._options(n) for n in alt))]


class Tables:
    """SLR(1) tables of a grammar. action[state][terminal] is a state (shift), ~production (reduce), or a tuple of them."""

    ACCEPT = 1 << 30

    def __init__(self, grammar: Grammar):
        prods = [("$start", (grammar.start,)), *grammar.productions]
        by: dict[str, list[int]] = {}
        for k, (left, _) in enumerate(prods):
            by.setdefault(left, []).append(k)
        first = self._first(prods, by)
        follow = self._follow(prods, by, first)
        closures: dict[str, tuple] = {}

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            out, seen, todo = list(kernel), set(), []
            for k, dot in kernel:
                if dot < len(prods[k][1]):
                    todo.append(prods[k][1][dot])
            while todo:
                x = todo.pop()
                if x in seen or x not in by:
                    continue
                seen.add(x)
                for k in by[x]:
                    out.append((k, 0))
                    todo.append(prods[k][1][0])
            return out

        states: dict[frozenset, int] = {}
        kernels: list[frozenset] = []

        def state(kernel: frozenset) -> int:
            if kernel not in states:
                states[kernel] = len(kernels)
                kernels.append(kernel)
            return states[kernel]

        state(frozenset([(0, 0)]))
        self.action: list[dict[str, int | tuple[int, ...]]] = []
        self.goto: list[dict[str, int]] = []
        n = 0
        while n < len(kernels):
            moves: dict[str, set] = {}
            acts: dict[str, list[int]] = {}
            for k, dot in closure(kernels[n]):
                left, right = prods[k]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((k, dot + 1))
                elif k == 0:
                    acts.setdefault(END, []).append(self.ACCEPT)
                else:
                    for t in follow[left]:
                        acts.setdefault(t, []).append(~k)
            jumps = {}
            for x, kernel in moves.items():
                to = state(frozenset(kernel))
                if x in by:
                    jumps[x] = to
                else:
                    acts.setdefault(x, []).append(to)
            self.action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in acts.items()})
            self.goto.append(jumps)
            n += 1
        self.lengths = [len(r) for _, r in prods]
        self.lefts = [left for left, _ in prods]
        self.start_empty = grammar.start_empty
        self.pieces: dict[tuple, list] = {}
        self.forget_stacks()
        self.units: dict[tuple[int, int, str], int] = {}  # filled while parsing; at most states times states times terminals
        self.terminals = {x for _, r in prods for x in r if x not in by and not x.isupper()}  # the words and marks
        del closures

    def forget_stacks(self) -> None:
        """Stacks by state and the stack below: equal stacks are one object."""
        self.stacks: dict[tuple[int, int], tuple] = {}
        self.bottom = self.kept((0, None))

    def kept(self, stack: tuple) -> tuple:
        """The one object for stacks that are equal to this one."""
        new = []
        below: tuple | None = stack
        while below is not None:
            found = self.stacks.get((below[0], id(below[1])))
            if found is below:
                break
            new.append(below)
            below = below[1]
        for state, _ in reversed(new):
            key = (state, id(below))
            found = self.stacks.get(key)
            if found is None:
                found = self.stacks[key] = (state, below)
            below = found
        return below

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "stacks", "bottom")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.pieces = {}
        self.forget_stacks()

    @staticmethod
    def _first(prods: list, by: dict) -> dict[str, set]:
        first: dict[str, set] = {x: set() for x in by}
        grew = True
        while grew:
            grew = False
            for left, right in prods:
                x = right[0]
                new = first[x] if x in by else {x}
                if not new <= first[left]:
                    first[left] |= new
                    grew = True
        return first

    @staticmethod
    def _follow(prods: list, by: dict, first: dict) -> dict[str, set]:
        follow: dict[str, set] = {x: set() for x in by}
        follow["$start"].add(END)
        links: dict[str, set] = {x: set() for x in by}
        for left, right in prods:
            for a, b in zip(right, right[1:], strict=False):
                if a in by:
                    follow[a] |= first[b] if b in by else {b}
            if right[-1] in by:
                links[right[-1]].add(left)
        grew = True
        while grew:
            grew = False
            for x, ups in links.items():
                for up in ups:
                    if not follow[up] <= follow[x]:
                        follow[x] |= follow[up]
                        grew = True
        return follow


def _settle(tables: Tables, tops: list, token: str) -> list | None:
    """All stacks after `token` from the stacks `tops`, or None if it is accepted as the end."""
    action, goto, lengths, lefts, units = tables.action, tables.goto, tables.lengths, tables.lefts, tables.units
    known: set[tuple] = set()
    made: list[tuple] = []  # keeps the stacks of `known` alive, whose identities it holds
    shifted: dict[tuple, tuple] = {}
    todo = list(tops)
    while todo:
        top = todo.pop()
        while True:
            a = action[top[0]].get(token)
            if type(a) is not int:
                break
            if a >= 0:
                if a == Tables.ACCEPT:
                    return None
                key = (a, id(top))
                if key not in shifted:
                    shifted[key] = (a, top)
                a = None
                break
            below = top[1]
            if lengths[~a] == 1:
                unit = (top[0], below[0], token)
                to = units.get(unit)
                if to is None:
                    to = top[0]
                    while type(a) is int and a < 0 and lengths[~a] == 1:
                        to = goto[below[0]][lefts[~a]]
                        a = action[to].get(token)
                    units[unit] = to
            else:
                for _ in range(lengths[~a] - 1):
                    below = below[1]
                to = goto[below[0]][lefts[~a]]
            key = (to, id(below))
            if key in known:  # equal stacks are worked on once
                a = None
                break
            known.add(key)
            top = (to, below)
            made.append(top)
        if a is None:
            continue
        for x in a:
            if x == Tables.ACCEPT:
                return None
            if x >= 0:
                key = (x, id(top))
                if key not in shifted:
                    shifted[key] = (x, top)
                continue
            below = top
            for _ in range(lengths[~x]):
                below = below[1]
            to = goto[below[0]][lefts[~x]]
            key = (to, id(below))
            if key not in known:
                known.add(key)
                new = (to, below)
                made.append(new)
                todo.append(new)
    return list(shifted.values())


#: Tokens after which a piece of a text ends that is parsed as one, and pieces and stacks that are remembered.
PIECE_ENDS = frozenset([";", "{", "}", "NEWLINE", ","])
MOST_KNOWN = 100_000
#: The longest piece.
PIECE = 40


def first_error(tables: Tables, tokens: list[str], may_insert: list[bool] | None = None, inserted: str = ";") -> int | None:
    """The index of the first token at which no parse is left (len(tokens): the end), or None for a valid text.

    Where `may_insert` is true, `inserted` is put before a token that no parse can take. Pieces of
    code are alike once names are tokens, and a list of statements leaves one stack however long it
    is: where a piece leads from which stacks is remembered, so that most pieces are looked up.
    """
    if not tokens and tables.start_empty:
        return None
    known = tables.pieces
    tops: list = [tables.bottom]
    count = len(tokens)
    i = 0
    ends = [k + 1 for k, t in enumerate(tokens) if t in PIECE_ENDS]
    ends.append(count)
    for end in ends:
        while i < end:
            stop = min(end, i + PIECE)
            flags = tuple(may_insert[i:stop]) if may_insert is not None and True in may_insert[i:stop] else None
            key = (tuple(map(id, tops)), tuple(tokens[i:stop]), flags)
            found = known.get(key)
            if found is None:
                if len(known) > MOST_KNOWN or len(tables.stacks) > MOST_KNOWN:
                    known.clear()
                    tables.forget_stacks()
                    tops = [tables.kept(t) for t in tops]
                    key = (tuple(map(id, tops)), *key[1:])
                after, error = _advance(tables, tops, tokens, i, stop, may_insert, inserted)
                if error is not None:
                    return error
                if after is None:
                    return None
                found = known[key] = [tables.kept(t) for t in after]
            tops = found
            i = stop
    return _advance(tables, tops, tokens, count, count + 1, may_insert, inserted)[1]


def _advance(tables: Tables, tops: list, tokens: list[str], start: int, stop: int, may_insert: list[bool] | None, inserted: str) -> tuple[list | None, int | None]:
    """(stacks, None) after the tokens from `start` to `stop`, (None, None) for an accepted text, or (None, index of the error)."""
    action, goto, lengths, lefts = tables.action, tables.goto, tables.lengths, tables.lefts
    units = tables.units
    count = len(tokens)
    for i in range(start, stop):
        token = tokens[i] if i < count else END
        before = tops
        if len(tops) == 1:  # the usual case: one stack and one action
            top = tops[0]
            while True:
                a = action[top[0]].get(token)
                if type(a) is not int:
                    tops = [] if a is None else [top]
                    break
                if a >= 0:
                    if a == Tables.ACCEPT:
                        return None, None
                    top = (a, top)
                    break
                if lengths[~a] == 1:
                    # Where a run of reductions of single symbols ends depends on these three alone.
                    below = top[1]
                    key = (top[0], below[0], token)
                    to = units.get(key)
                    if to is None:
                        to = top[0]
                        while type(a) is int and a < 0 and lengths[~a] == 1:
                            to = goto[below[0]][lefts[~a]]
                            a = action[to].get(token)
                        units[key] = to
                    top = (to, below)
                    continue
                below = top
                for _ in range(lengths[~a]):
                    below = below[1]
                top = (goto[below[0]][lefts[~a]], below)
            if type(a) is int:
                tops = [top]
                continue
            if a is not None:
                tops = _settle(tables, tops, token)
                if tops is None:
                    return None, None
        else:
            tops = _settle(tables, tops, token)
            if tops is None:
                return None, None
        if not tops and may_insert is not None and may_insert[i]:
            tops = _settle(tables, before, inserted) or []
            if tops:
                tops = _settle(tables, tops, token)
                if tops is None:
                    return None, None
        if not tops:
            return None, i
    return (tops, None) if stop <= count else (None, count)
