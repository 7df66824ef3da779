"""Lexers of the checked languages: text to token names of the grammars.

Each returns (tokens, offsets) or, with BAD as the last token, what came before text that is no
token of the language: an unclosed string, a stray character, an indentation that fits nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right

BAD = "$bad"
OPEN = {"(": ")", "[": "]", "{": "}"}


def _bad(tokens: list, offsets: list, at: int) -> tuple[list, list]:
    tokens.append(BAD)
    offsets.append(at)
    return tokens, offsets


# --- JSON --------------------------------------------------------------------------------

_JSON = re.compile(
    r'(?P<ws>[ \t\r\n]+)|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.]))|(?P<word>(?:true|false|null)\b)|(?P<op>[][{},:])'
)


def lex_json(text: str, words: set[str]) -> tuple[list, list]:
    return _simple(_JSON, text, words)


def _simple(pattern: re.Pattern, text: str, words: set[str]) -> tuple[list, list]:
    """For languages whose tokens one pattern tells apart."""
    tokens: list[str] = []
    offsets: list[int] = []
    at, n = 0, len(text)
    match = pattern.match
    while at < n:
        if text[at] == " ":  # the most frequent blank
            at += 1
            continue
        m = match(text, at)
        if m is None:
            return _bad(tokens, offsets, at)
        kind = m.lastgroup
        if kind != "ws":
            if kind == "word":
                value = m.group()
                tokens.append(value if value in words else "ID")
            elif kind == "op":
                value = m.group()
                tokens.append(value if value in words else "OP")
            else:
                tokens.append(kind)
            offsets.append(at)
        at = m.end()
    return tokens, offsets


# --- C -----------------------------------------------------------------------------------

_C = re.compile(
    r"""(?P<ws>[ \t\r\n\f\v]+|\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\)*|/\*(?s:.*?)\*/)
    |(?P<STR>(?:u8|[uUL])?"(?:[^"\\\n]|\\(?s:.))*")|(?P<CHAR>[uUL]?'(?:[^'\\\n]|\\(?s:.))+')
    |(?P<NUM>\.?[0-9](?:[eEpP][+-]|'[0-9A-Za-z]|[0-9A-Za-z_.])*)|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*)
    |(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|[][(){}.,;:?~!%^&*+\-=/<>|])""",
    re.X,
)
_C_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01']+|(?:[0-9][0-9']*\.?[0-9']*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:[uU]?[lL]{0,2}[uU]?|[fFlL]|[fF](?:16|32|64|128)x?)\Z")
_C_SAME = {"__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__restrict__": "restrict", "__volatile__": "volatile", "__const": "const", "__asm__": "asm", "__asm": "asm", "__typeof__": "typeof", "typeof_unqual": "typeof", "__extension__": "", "static_assert": "_Static_assert", "_Static_assert": "_Static_assert", "thread_local": "_Thread_local", "constexpr": "const", "alignas": "_Alignas", "alignof": "_Alignof", "_Imaginary": "_Complex", "__signed__": "signed", "bool": "ID"}
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*([A-Za-z_]*)")


_DEFINES = re.compile(r"^[ \t]*#[ \t]*(?:define|undef)[ \t]+(\w+)", re.M)
_DEFINED = re.compile(r"defined *\(? *(\w+) *\)?\Z")


def _condition(word: str, rest: str, own: set[str], at: int) -> tuple[str, bool] | bool | None:
    """What a branch asks for: a condition and the value it must have, a constant, or None for #else."""
    rest = " ".join(re.sub(r"/\*.*?\*/|//[^\n]*|\\\r?\n", " ", rest, flags=re.S).split())
    if word == "else":
        return None
    if word.endswith("def"):
        rest = ("!" if word.endswith("ndef") else "") + f"defined {rest}"
    wanted = True
    while True:
        inner = rest[1:].strip() if rest.startswith("!") else ""
        if not inner or not re.fullmatch(r"\w+|\([^()]*\)|defined *\(? *\w+ *\)?", inner):
            break
        rest, wanted = inner, not wanted
    while re.fullmatch(r"\([^()]*\)", rest):
        rest = rest[1:-1].strip()
    if rest in ("0", "1"):
        return (rest == "1") == wanted
    m = _DEFINED.match(rest)
    rest = f"defined {m.group(1)}" if m else rest
    # A name that the file itself defines may differ from place to place.
    return (f"{rest} at {at}" if own & set(re.findall(r"\w+", rest)) else rest), wanted


class Conditionals:
    """A text by the branches of its conditionals: directives are blanked, each part knows its branch.

    Conditions are taken for free, but the same condition has the same value everywhere; what
    a constant excludes is dead. Branch 0 is the text outside of conditionals.
    """

    def __init__(self, text: str) -> None:
        self.wrong: int | None = None  # offset of an unbalanced conditional or an unknown directive
        self.parts: list[tuple[str, int]] = []
        self.parent = [-1]
        self.groups: list[list[int]] = []  # branches of each conditional
        self.group_of = [-1]
        self.asks: list[tuple[str, bool] | bool | None] = [None]
        own = set(_DEFINES.findall(text))
        open_: list[tuple[int, int]] = []  # offset, group
        branch, at, i, in_comment = 0, 0, 0, False
        lines = text.splitlines(keepends=True) if "#" in text else [text]
        unknown: list[tuple[int, int]] = []
        while i < len(lines):
            line = lines[i]
            start = at
            m = None if in_comment else _DIRECTIVE.match(line)
            if m:
                whole = line
                while whole.rstrip("\r\n").endswith("\\") and i + 1 < len(lines):
                    i += 1
                    whole += lines[i]
                # a comment that opens in a directive may go on
                bare = re.sub(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*', "", whole)
                while bare.count("/*") > bare.count("*/") and i + 1 < len(lines):
                    i += 1
                    whole += lines[i]
                    bare = re.sub(r'"(?:[^"\\\n]|\\.)*"', "", whole)
                word = m.group(1)
                if word in ("if", "ifdef", "ifndef", "elif", "else", "elifdef", "elifndef"):
                    if word.startswith("if"):
                        open_.append((start, len(self.groups)))
                        self.groups.append([])
                        above = branch
                    elif not open_ or self.asks[branch] is None:
                        self.wrong = start
                        return
                    else:
                        above = self.parent[branch]
                    branch = len(self.parent)
                    self.parent.append(above)
                    self.groups[open_[-1][1]].append(branch)
                    self.group_of.append(open_[-1][1])
                    self.asks.append(_condition(word, whole[m.end() :], own, start))
                elif word == "endif":
                    if not open_:
                        self.wrong = start
                        return
                    open_.pop()
                    branch = self.parent[branch]
                elif word not in ("include", "define", "undef", "pragma", "error", "warning", "line", "include_next", "import", "ident", "embed", ""):
                    unknown.append((start, branch))
                self.parts.append((re.sub(r"[^\n]", " ", whole), branch))
                at += len(whole)
            else:
                self.parts.append((line, branch))
                in_comment = _open_comment(line, in_comment)
                at += len(line)
            i += 1
        wrong = [at for at, x in unknown if self.values([x]) is not None] + [at for at, _ in open_]
        self.wrong = min(wrong, default=None)

    def values(self, wanted: list[int], skip: bool = False) -> dict[str, bool] | None:
        """Values of conditions that make the wanted branches live; None if there are none, or without those that don't fit if `skip`."""
        out: dict[str, bool] = {}
        for branch in wanted:
            mine = dict(out)
            fits = True
            while branch > 0 and fits:
                group = self.groups[self.group_of[branch]]
                for x in group[: group.index(branch) + 1]:
                    ask, right = self.asks[x], x == branch
                    if isinstance(ask, tuple):
                        value = ask[1] == right
                        fits = fits and mine.setdefault(ask[0], value) == value
                    elif ask is not None:
                        fits = fits and ask == right
                branch = self.parent[branch]
            if fits:
                out = mine
            elif not skip:
                return None
        return out

    def live(self, values: dict[str, bool]) -> set[int]:
        """The branches taken: where nothing is known, the first ones."""
        known = dict(values)
        out = {0}
        for group in self.groups:
            if self.parent[group[0]] not in out:
                continue
            for x in group:
                ask = self.asks[x]
                if ask is None or ask is True or isinstance(ask, tuple) and known.setdefault(ask[0], ask[1]) == ask[1]:
                    out.add(x)
                    break
        return out

    def text(self, live: set[int]) -> str:
        return "".join(part if branch in live else re.sub(r"[^\n]", " ", part) for part, branch in self.parts)


def strip_directives(text: str) -> tuple[str, int | None]:
    """The text with directives and the later branches of conditionals blanked; the offset of an unbalanced conditional, if any."""
    c = Conditionals(text)
    return (text, c.wrong) if c.wrong is not None else (c.text(c.live({})), None)


_COMMENT_MARK = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//|/\*|\*/')


def _open_comment(line: str, inside: bool) -> bool:
    at = 0
    while True:
        if inside:
            at = line.find("*/", at)
            if at < 0:
                return True
            inside, at = False, at + 2
        m = _COMMENT_MARK.search(line, at)
        if not m or m.group() == "//":
            return inside
        at = m.end()
        inside = m.group() == "/*"


def lex_c(text: str, words: set[str]) -> tuple[list, list]:
    text = text.removeprefix("﻿")
    stripped, wrong = strip_directives(text)
    if wrong is not None:
        return _bad([], [], wrong)
    tokens: list[str] = []
    offsets: list[int] = []
    at, n = 0, len(stripped)
    while at < n:
        m = _C.match(stripped, at)
        if m is None:
            return _bad(tokens, offsets, at)
        kind = m.lastgroup
        if kind != "ws":
            value = m.group()
            if kind == "word":
                value = _C_SAME.get(value, value)
                name = value if value in words else "ID"
            elif kind == "op":
                name = value if value in words else "OP"
            elif kind == "NUM" and not _C_NUMBER.match(value):
                return _bad(tokens, offsets, at)
            else:
                name = kind
            if value:
                tokens.append(name)
                offsets.append(at)
        at = m.end()
    return tokens, offsets


# --- Java --------------------------------------------------------------------------------

_JAVA = re.compile(
    r"""(?P<ws>[ \t\r\n\f\x1a]+|//[^\n\r]*|/\*(?s:.*?)\*/)
    |(?P<LIT>\"\"\"[ \t\f]*\r?\n(?:[^\\"]|\\(?s:.)|"(?!""))*\"\"\"|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'
      |(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*(?:\.(?![.A-Za-z_])[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?)(?![A-Za-z0-9_]))
    |(?P<word>non-sealed\b|[A-Za-z_$\u0080-\U0010ffff][\w$]*)
    |(?P<op>\.\.\.|->|::|\+\+|--|<<=|<<|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[][(){}.,;:?~!%^&*+\-=/<>|@])""",
    re.X,
)
_PRIM = {"byte", "short", "int", "long", "char", "float", "double", "boolean"}
_JAVA_LIT = {"true", "false", "null"}


def lex_java(text: str, words: set[str]) -> tuple[list, list]:
    tokens, offsets = _simple(_JAVA, text.removeprefix("﻿"), words | _PRIM | _JAVA_LIT)
    return ["PRIM" if t in _PRIM else "LIT" if t in _JAVA_LIT else t for t in tokens], offsets


# --- Go ----------------------------------------------------------------------------------

_GO = re.compile(
    r"""(?P<line>\r?\n|//[^\n]*(?:\n|\Z))|(?P<ws>[ \t\r]+|/\*(?s:.*?)\*/)
    |(?P<STR>`[^`]*`|"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*")
    |(?P<CHAR>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<NUM>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?(?![A-Za-z0-9_]))
    |(?P<word>[^\W\d]\w*)
    |(?P<ARROW><-)|(?P<ASSIGN>&\^=|<<=|>>=|[-+*/%&|^]=)
    |(?P<op>\.\.\.|:=|&\^|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|[][(){}.,;:!%^&*+\-=/<>|~])""",
    re.X,
)
_GO_ENDS = {"ID", "STR", "CHAR", "NUM", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def lex_go(text: str, words: set[str]) -> tuple[list, list]:
    """A newline after a token that may end a statement is a semicolon."""
    text = text.removeprefix("﻿")
    tokens: list[str] = []
    offsets: list[int] = []
    at, n = 0, len(text)
    while at < n:
        if text[at] == " ":  # the most frequent blank
            at += 1
            continue
        m = _GO.match(text, at)
        if m is None:
            return _bad(tokens, offsets, at)
        kind, value = m.lastgroup, m.group()
        if kind == "line" or kind == "ws" and "\n" in value:
            if tokens and tokens[-1] in _GO_ENDS:
                tokens.append(";")
                offsets.append(at)
        elif kind != "ws":
            if kind == "word":
                kind = value if value in words else "ID"
            elif kind == "op":
                kind = value if value in words else "OP"
            tokens.append(kind)
            offsets.append(at)
        at = m.end()
    if tokens and tokens[-1] in _GO_ENDS:
        tokens.append(";")
        offsets.append(n)
    # A semicolon may be left out before a closing bracket; the grammar has them optional there.
    return tokens, offsets


# --- Rust --------------------------------------------------------------------------------

_RUST = re.compile(
    r"""(?P<ws>[ \t\r\n\f]+|//[^\n]*)|(?P<comment>/\*)
    |(?P<raw>(?:b|c)?r(?P<hashes>\#*)")|(?P<STR>[bc]?"(?:[^"\\]|\\(?s:.))*"(?:[A-Za-z_]\w*)?)
    |(?P<CHAR>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')|(?P<LIFETIME>'[^\W\d]\w*(?!'))
    |(?P<NUM>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?_*[0-9][0-9_]*)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64|_\w*)?(?![\w]))
    |(?P<word>r\#[^\W\d]\w*|[^\W\d]\w*)
    |(?P<RANGE>\.\.=|\.\.\.|\.\.)
    |(?P<op><<=|<<|->|=>|::|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[][(){}.,;:?!%^&*+\-=/<>|@~\#$])""",
    re.X,
)


def _trees(tokens: list[str], offsets: list[int]) -> tuple[list, list]:
    """Attributes become one token each, and what lies in the brackets of a macro call is kept as brackets and ANY."""
    out: list[str] = []
    at: list[int] = []
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t == "#":
            j = i + 1
            inner = j < n and tokens[j] == "!"
            j += inner
            if j >= n or tokens[j] != "[":
                return _bad(out, at, offsets[i])
            end = _closing(tokens, j)
            if end is None:
                return _bad(out, at, offsets[i])
            out.append("INNER" if inner else "OUTER")
            at.append(offsets[i])
            i = end + 1
            continue
        if t == "!" and out and out[-1] == "ID" and i + 1 < n and (tokens[i + 1] in OPEN or tokens[i + 1] == "ID" and i + 2 < n and tokens[i + 2] in OPEN and tokens[i - 1] == "ID"):
            out.append(t)
            at.append(offsets[i])
            i += 1
            if tokens[i] == "ID":
                out.append("ID")
                at.append(offsets[i])
                i += 1
            end = _closing(tokens, i)
            if end is None:
                return _bad(out, at, offsets[i])
            for k in range(i, end + 1):
                x = tokens[k]
                out.append(x if x in "()[]{}" else "ANY")
                at.append(offsets[k])
            i = end + 1
            continue
        out.append(t)
        at.append(offsets[i])
        i += 1
    return out, at


def _closing(tokens: list[str], i: int) -> int | None:
    """The token that closes the bracket at i, if all brackets between fit."""
    want: list[str] = []
    for k in range(i, len(tokens)):
        t = tokens[k]
        if t in OPEN:
            want.append(OPEN[t])
        elif t in (")", "]", "}"):
            if want.pop() != t:
                return None
            if not want:
                return k
    return None


def lex_rust(text: str, words: set[str]) -> tuple[list, list]:
    text = text.removeprefix("﻿")
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        text = re.sub(r"^[^\n]*", lambda m: " " * len(m.group()), text)
    tokens: list[str] = []
    offsets: list[int] = []
    at, n = 0, len(text)
    while at < n:
        if text[at] == " ":  # the most frequent blank
            at += 1
            continue
        m = _RUST.match(text, at)
        if m is None:
            return _bad(*_trees(tokens, offsets), at)
        kind, value, end = m.lastgroup, m.group(), m.end()
        if kind == "comment":
            depth = 1
            while depth:
                mark = re.compile(r"/\*|\*/").search(text, end)
                if not mark:
                    return _bad(*_trees(tokens, offsets), at)
                depth += 1 if mark.group() == "/*" else -1
                end = mark.end()
        elif kind in ("raw", "hashes"):
            close = text.find('"' + m.group("hashes"), end)
            if close < 0:
                return _bad(*_trees(tokens, offsets), at)
            end = close + 1 + len(m.group("hashes"))
            tokens.append("STR")
            offsets.append(at)
        elif kind != "ws":
            if kind == "word":
                kind = value if value in words or value == "_" else "ID"
            elif kind == "op":
                kind = value if value in words or value in "#$@" else "OP"
            elif kind == "RANGE" and value == "...":
                kind = "..." if tokens and tokens[-1] in ("(", ",", ":") else "RANGE"
            elif kind == "NUM" and tokens and tokens[-1] == "." and re.fullmatch(r"[0-9]+\.[0-9]+", value):
                tokens += ["NUM", "."]  # a field of a field of tuples
                offsets += [at, at]
            tokens.append(kind)
            offsets.append(at)
        at = end
    return _trees(tokens, offsets)


# --- Python ------------------------------------------------------------------------------

_PY = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n|\\\r(?!\n))|(?P<line>\r\n|\n|\r)|(?P<comment>\#[^\n\r]*)
    |(?P<string>(?P<prefix>[A-Za-z]{0,2})(?P<quote>\"\"\"|'''|"|'))
    |(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)(?![0-9A-Za-z_]))
    |(?P<word>[^\W\d]\w*)
    |(?P<AUG>\*\*=|//=|>>=|<<=|[-+*/%@&|^]=)
    |(?P<op>\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[][(){}.,;:@%^&*+\-=/<>|~])""",
    re.X,
)
_INDENT = re.compile(r"[ \t\f]*")
_QUOTE = re.compile(r"\"\"\"|'''|\"|'")
_PREFIXES = {"", "r", "u", "b", "f", "br", "rb", "fr", "rf"}


def _python_string(text: str, at: int, quote: str, raw: bool, formatted: bool) -> int | None:
    """Where the string whose contents begin at `at` ends."""
    n, triple = len(text), len(quote) == 3
    while at < n:
        c = text[at]
        if c == "\\":
            at += 1 if formatted and text[at + 1 : at + 2] in ("{", "}") else 2  # a brace can't be escaped so
        elif text.startswith(quote, at):
            return at + len(quote)
        elif c in "\r\n" and not triple:
            return None
        elif formatted and c == "{":
            if text.startswith("{{", at):
                at += 2
                continue
            end = _replacement(text, at + 1, quote, raw)
            if end is None:
                return None
            at = end
        elif formatted and c == "}":
            if not text.startswith("}}", at):
                return None
            at += 2
        else:
            at += 1
    return None


def _replacement(text: str, at: int, quote: str, raw: bool) -> int | None:
    """Where the replacement field whose expression begins at `at` ends."""
    want: list[str] = []
    n, begin = len(text), at
    while at < n:
        c = text[at]
        if c in OPEN:
            want.append(OPEN[c])
        elif c in ")]}" and want:
            if want.pop() != c:
                return None
        elif c == "}":
            return at + 1 if text[begin:at].strip() else None
        elif c in ")]" or c in "\r\n" and len(quote) == 1:
            return None
        elif c in "\"'":
            m = _QUOTE.match(text, at)
            k = at
            while k > begin and text[k - 1].isalpha():
                k -= 1
            inner = text[k:at].lower()
            end = _python_string(text, m.end(), m.group(), "r" in inner, "f" in inner)
            if end is None:
                return None
            at = end
            continue
        elif c == "#" and len(quote) == 1:
            return None
        elif c == ":" and not want:
            # the format: ordinary text with replacement fields
            at += 1
            while at < n and text[at] != "}":
                if text[at] == "{":
                    end = _replacement(text, at + 1, quote, raw)
                    if end is None:
                        return None
                    at = end
                elif text.startswith(quote, at) or text[at] in "\r\n" and len(quote) == 1:
                    return None
                else:
                    at += 1
            return at + 1 if at < n else None
        at += 1
    return None


def lex_python(text: str, words: set[str]) -> tuple[list, list]:
    text = text.removeprefix("﻿")
    tokens: list[str] = []
    offsets: list[int] = []
    indents = [(0, 0)]
    want: list[str] = []
    at, n = 0, len(text)
    fresh = True  # at the start of a line outside brackets

    def add(kind: str) -> None:
        tokens.append(kind)
        offsets.append(at)

    while at < n:
        if fresh:
            m = _INDENT.match(text, at)
            wide = narrow = m.end() - at
            mixed = m.group() if wide and m.group().count(" ") < wide else ""
            if mixed:
                wide = narrow = 0
            for c in mixed:
                if c == "\t":
                    wide, narrow = (wide // 8 + 1) * 8, narrow + 1
                elif c == "\f":
                    wide = narrow = 0
                else:
                    wide, narrow = wide + 1, narrow + 1
            at = m.end()
            if at >= n:
                break
            fresh = False
            if text[at] not in "\r\n#":  # blank lines don't count
                top = indents[-1]
                if (wide > top[0]) != (narrow > top[1]) or (wide < top[0]) != (narrow < top[1]):
                    return _bad(tokens, offsets, at)
                if wide > top[0]:
                    indents.append((wide, narrow))
                    add("INDENT")
                while wide < indents[-1][0]:
                    indents.pop()
                    add("DEDENT")
                if (wide, narrow) != indents[-1]:
                    return _bad(tokens, offsets, at)
        if text[at] == " ":  # the most frequent blank
            at += 1
            continue
        m = _PY.match(text, at)
        if m is None:
            return _bad(tokens, offsets, at)
        kind, value, end = m.lastgroup, m.group(), m.end()
        if kind == "line":
            if not want:
                if tokens and tokens[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    add("NEWLINE")
                fresh = True
        elif kind in ("string", "quote", "prefix"):
            prefix = m.group("prefix").lower()
            if prefix not in _PREFIXES:
                return _bad(tokens, offsets, at)
            close = _python_string(text, end, m.group("quote"), "r" in prefix, "f" in prefix)
            if close is None:
                return _bad(tokens, offsets, at)
            add("STR")
            end = close
        elif kind == "word":
            add(value if value in words else "ID")
        elif kind == "op":
            if value in OPEN:
                want.append(OPEN[value])
            elif value in ")]}":
                if not want or want.pop() != value:
                    return _bad(tokens, offsets, at)
            add(value if value in words else "OP")
        elif kind not in ("ws", "comment"):
            add(kind)
        at = end
    at = n
    if want:
        return _bad(tokens, offsets, n)
    if tokens and tokens[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
        add("NEWLINE")
    for _ in indents[1:]:
        add("DEDENT")
    return tokens, offsets


# --- JavaScript and TypeScript -----------------------------------------------------------

_JS = re.compile(
    r"""(?P<ws>[ \t\f\v ﻿  \r\n]+|//[^\n\r  ]*|/\*(?s:.*?)\*/|<!--[^\n]*)
    |(?P<STR>"(?:[^"\\\n\r]|\\(?:\r\n|(?s:.)))*"|'(?:[^'\\\n\r]|\\(?:\r\n|(?s:.)))*')
    |(?P<NUM>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)n?(?![\w$]))
    |(?P<PRIVATE>\#[^\W\d]\w*)|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*)
    |(?P<back>`)
    |(?P<op>\.\.\.|\?\.(?![0-9])|=>|===|!==|\*\*=|\*\*|<<=|<<|<=|>=|==|!=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|[][(){}.,;:?~!%^&*+\-=/<>|@])""",
    re.X,
)
_COLON = re.compile(r"\s*:")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*")
#: After these an operand follows: a slash opens a pattern, a brace an object.
_OPERAND = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "+", "-", "*", "~", "OP", "<", "/", "return", "typeof", "instanceof", "in", "of", "new", "delete", "throw", "case", "await", "yield", "...", "HEAD", "MIDDLE", "default", "const", "let", "var", "extends", "as", "export", "import", "satisfies", "keyof", "=>"}
_OPENS_OBJECT = _OPERAND - {"=>"}
_BEFORE_EXPRESSION = _OPERAND - {"default", "export"}
_VALUE_ENDS = {"ID", "NUM", "STR", "REGEX", "TEMPLATE", "TAIL", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"}
_RESTRICTED = {"return", "break", "continue", "throw", "yield"}


def lex_script(text: str, words: set[str], soft: frozenset[str] = frozenset()) -> tuple[list, list, list]:
    """Besides, for each token (and the end) whether a semicolon may be put before it."""
    text = text.removeprefix("﻿")
    if text.startswith("#!"):
        text = re.sub(r"^[^\n]*", lambda m: " " * len(m.group()), text)
    tokens: list[str] = []
    offsets: list[int] = []
    free: list[bool] = []
    braces: list[bool] = []  # whether the brace belongs to a template
    at, n = 0, len(text)
    line = False
    template_end = False
    labels: list[int] = []  # open `case` labels, as the number of `?` since
    after_label = False
    while at < n:
        prev = tokens[-1] if tokens else None
        if template_end:
            m = _TEMPLATE.match(text, at)
            end = m.end()
            if text.startswith("`", end):
                kind, end = ("TAIL" if braces_open else "TEMPLATE"), end + 1
            elif text.startswith("${", end):
                kind, end = ("MIDDLE" if braces_open else "HEAD"), end + 2
                braces.append(True)
            else:
                return *_bad(tokens, offsets, at), [*free, False, False]
            template_end = False
            tokens.append(kind)
            offsets.append(at)
            free.append(line)
            line = False
            at = end
            continue
        if text[at] == " ":  # the most frequent blank
            at += 1
            continue
        m = _JS.match(text, at)
        if text[at] == "/" and (m is None or m.lastgroup == "op") and (prev is None or prev not in _VALUE_ENDS and prev not in soft):
            pattern = _REGEX.match(text, at)
            if pattern:
                tokens.append("REGEX")
                offsets.append(at)
                free.append(line)
                line = False
                at = pattern.end()
                continue
        if m is None:
            return *_bad(tokens, offsets, at), [*free, False, False]
        kind, value, end = m.lastgroup, m.group(), m.end()
        if kind == "ws":
            line = line or "\n" in value or "\r" in value
            if line and prev in _RESTRICTED and len(tokens) and not (len(tokens) > 1 and tokens[-2] in (".", "?.")):
                tokens.append(";")
                offsets.append(at)
                free.append(False)
            at = end
            continue
        if kind == "back":
            braces_open = False
            template_end = True
            at = end
            continue
        if kind == "word":
            kind = value if value in words or value in ("function", "class") else "ID"
            if prev in (".", "?."):
                kind = "ID"
            elif prev in (",", "o{") and _COLON.match(text, end):
                kind = "ID"
            elif kind in ("function", "class") and prev in _BEFORE_EXPRESSION:
                kind = "fexpr" if kind == "function" else "cexpr"
            elif kind == "function" and prev == "async" and len(tokens) > 1 and tokens[-2] in _BEFORE_EXPRESSION:
                kind = "fexpr"
        elif kind == "op":
            if value == "{":
                kind = "{" if after_label else "c{" if prev in (":", ">", "void") else "o{" if prev in _OPENS_OBJECT else "{"
                braces.append(False)
            elif value == "}":
                kind = "}"
                if braces and braces.pop():
                    braces_open = True
                    template_end = True
                    at = end
                    continue
            elif value in ("++", "--"):
                kind = value
                if line and prev in _VALUE_ENDS:
                    tokens.append(";")
                    offsets.append(at)
                    free.append(False)
            else:
                kind = value if value in words else "OP"
        after_label = False
        if kind == "case":
            labels.append(0)
        elif kind == "?" and labels:
            labels[-1] += 1
        elif kind == ":":
            if prev == "default" or prev == "ID" and len(tokens) > 1 and tokens[-2] in (";", "{", "}"):
                after_label = True
            elif labels and not labels[-1]:
                labels.pop()
                after_label = True
            elif labels:
                labels[-1] -= 1
        tokens.append(kind)
        offsets.append(at)
        free.append(line or kind == "}")
        line = False
        at = end
    return (*_bad(tokens, offsets, n), [*free, False, False]) if template_end else (tokens, offsets, [*free, True])


def line_of(text: str, offset: int) -> int:
    """The line, from 1, of an offset, whatever ends the lines."""
    ends = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
    return bisect_right(ends, offset) + 1
