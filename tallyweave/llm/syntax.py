"""Source files that do not parse: every file is tokenised and parsed whole by table-driven parsers.

The tables of the bundled grammars are built once, on the driver, and sent to the tasks; the
operator is one pass over the files without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import grammars, lexing
from .parsing import Grammar, Tables, first_error

# The languages by the extensions of their files.
EXTENSIONS = {"rs": "Rust", "py": "Python", "pyi": "Python", "go": "Go", "java": "Java", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "c": "C", "h": "C", "json": "Json"}

_GRAMMARS = {
    "Json": (grammars.JSON, lexing.lex_json),
    "Python": (grammars.PYTHON, lexing.lex_python),
    "C": (grammars.C, lexing.lex_c),
    "Java": (grammars.JAVA, lexing.lex_java),
    "Go": (grammars.GO, lexing.lex_go),
    "Rust": (grammars.RUST, lexing.lex_rust),
    "JavaScript": (grammars.script(False), partial(lexing.lex_script, soft=frozenset(grammars.SOFT_WORDS))),
    "TypeScript": (grammars.script(True), partial(lexing.lex_script, soft=frozenset(grammars.SOFT_WORDS + grammars.SOFT_TYPED))),
}


def build_tables(languages: list[str] | None = None) -> dict[str, Tables]:
    return {name: Tables(Grammar(_GRAMMARS[name][0], "file")) for name in languages or _GRAMMARS}


_local: dict[str, Tables] = {}


def tables_of(language: str) -> Tables:
    if language not in _local:
        _local.update(build_tables([language]))
    return _local[language]


def error_line(text: str, language: str, tables: dict[str, Tables] | None = None) -> int | None:
    """The line of the first error from which no parse is left, or None for a valid file.

    C is parsed with first branches of its conditionals, then with the others until each has been in a text.
    """
    table = tables[language] if tables else tables_of(language)
    lex = _GRAMMARS[language][1]
    if not text.strip("﻿ \t\r\n\f"):
        return 1 if language == "Json" else None
    at = _error_offset(text, lex, table)
    if at is None and language == "C" and "#" in text:
        at = _error_of_branches(text, lex, table)
    return None if at is None else lexing.line_of(text, at)


def _error_offset(text: str, lex: Callable, table: Tables) -> int | None:
    found = lex(text, table.terminals)
    at = first_error(table, found[0], *found[2:])
    return None if at is None else found[1][at] if at < len(found[1]) else len(text)


def _error_of_branches(text: str, lex: Callable, table: Tables) -> int | None:
    """The first error of a later branch, which neither a text with other later ones nor one with first ones around it parses."""
    c = lexing.Conditionals(text)
    seen = c.live({})
    while True:
        rest = [x for x in range(len(c.parent)) if x not in seen and c.values([x]) is not None]
        if not rest:
            return None
        live = c.live(c.values(rest, skip=True))
        if _error_offset(c.text(live), lex, table) is not None:
            for x in rest:
                if x in live:
                    at = _error_offset(c.text(c.live(c.values([x]))), lex, table)
                    if at is not None:
                        return at
        seen |= live


def known_language(language: Column, path: Column) -> Column:
    """The language, or what the extension of the path tells where it is null."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(language, F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))))


def check_files(df: DataFrame, keep: list[str], content: str = "content", language: str = "language", path: str = "path") -> DataFrame:
    """`keep`, _language, _valid, _line of every file.

    _valid is null where the content is null or no grammar fits the language; an empty file is
    valid in every language but Json. _line is that of the first error. Files are parsed whole.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(build_tables())  # of fixed size: it depends on the grammars alone
    source = df.select(*keep, known_language(F.col(language), F.col(path)).alias("_language"), F.col(content).alias("_content"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    k = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            valid: list[bool | None] = []
            lines: list[int | None] = []
            for name, text in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True):
                if text is None or name not in tables:
                    valid.append(None)
                    lines.append(None)
                    continue
                line = error_line(text, name, tables)
                valid.append(line is None)
                lines.append(line)
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(valid, pa.bool_()), pa.array(lines, pa.int32())], names=[*keep, "_language", "_valid", "_line"])

    return spread(source).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_language string, _valid boolean, _line int"]))


def invalid_rates(checked: DataFrame, by: list[str]) -> DataFrame:
    """`by`, language, files, invalid, share of what check_files() gave; files that can't be judged aren't counted."""
    return (
        checked.filter("_valid is not null")
        .groupBy(*by, F.col("_language").alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("_valid")).alias("invalid"))
        .withColumn("share", F.col("invalid") / F.col("files"))
    )
