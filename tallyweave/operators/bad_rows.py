"""Records that fail to parse: good rows are loaded, the others are set aside with a reason.

Blocks of records go through a columnar CSV parser; a block that the parser rejects is halved
until few records are left. The fields of what it takes are tested as columns. The records that
are left over are diagnosed by a strict scanner of single records. Nothing is shuffled: the
operator is one pass over the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

_BIGINT_MAX = 2**63 - 1
#: Blocks of at most this many records are not halved any further.
_LEAF = 8


@dataclass(frozen=True)
class Field:
    """A column of the records: `text`, `decimal` (digits, perhaps with a fraction) or `whole` (digits within bigint).

    Numbers may be empty unless `needed_if` names another column and the value of it that asks for
    them. A text may be anything unless it is `not_empty`, has to match `pattern` as a whole or has
    to be `one_of` some words.
    """

    name: str
    kind: str = "text"
    not_empty: bool = False
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    needed_if: tuple[str, str] | None = None


class Layout:
    """What records have to look like: as many fields as columns, quotes only around a field or doubled within one."""

    def __init__(self, *fields: Field):
        self.fields = fields
        self.names = [f.name for f in fields]
        self.types = [{"text": pa.string(), "decimal": pa.float64(), "whole": pa.int64()}[f.kind] for f in fields]
        self.schema = ", ".join(f"`{f.name}` {dict(text='string', decimal='double', whole='bigint')[f.kind]}" for f in fields)
        field = r'(?:[^",\r\n]*|"(?:[^"]|"")*")'
        self.record = rf"^{field}(?:,{field}){{{len(fields) - 1}}}\r?$"
        self.patterns = {f.name: re.compile(f.pattern) for f in fields if f.pattern}


# The columns of a benchmark run and the words its status may be.
STATUSES = ["ok", "timed_out", "killed", "unreadable", "panicked"]
_WHEN_OK = ("status", "ok")
RUN = Layout(
    Field("language", not_empty=True), Field("repository", not_empty=True), Field("commit", pattern="[0-9a-f]{40}"), Field("path", not_empty=True), Field("status", one_of=tuple(STATUSES)),
    Field("elapsed_ms", "decimal", needed_if=_WHEN_OK), Field("ast_nodes_before", "whole", needed_if=_WHEN_OK), Field("ast_nodes_after", "whole", needed_if=_WHEN_OK), Field("peak_memory_bytes", "whole", needed_if=_WHEN_OK),
)
COLUMNS = RUN.names


def split_record(record: str) -> tuple[list[str] | None, str | None]:
    """The fields of one record, or the reason why it can't be split."""
    if record.endswith("\r"):
        record = record[:-1]
    fields: list[str] = []
    i, n = 0, len(record)
    while True:
        if i < n and record[i] == '"':
            parts, i = [], i + 1
            while True:
                j = record.find('"', i)
                if j < 0:
                    return None, "quote_not_closed"
                parts.append(record[i:j])
                if record[j + 1 : j + 2] == '"':
                    parts.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and record[i] != ",":
                return None, "text_after_quote"
            fields.append("".join(parts))
        else:
            j = record.find(",", i)
            j = n if j < 0 else j
            field = record[i:j]
            if '"' in field:
                return None, "quote_inside_field"
            if "\n" in field or "\r" in field:
                return None, "line_break_inside_field"
            fields.append(field)
            i = j
        if i >= n:
            return fields, None
        i += 1


def _digits(text: str) -> bool:
    return text.isascii() and text.isdigit()


def diagnose(record: str | None, layout: Layout = RUN) -> tuple[list[str] | None, str | None]:
    """Strictly reads one record: (fields, None) if it can be loaded, else (None, reason)."""
    if record is None:
        return None, "no_text"
    fields, reason = split_record(record)
    if fields is None:
        return None, reason
    if len(fields) != len(layout.fields):
        return None, "too_few_fields" if len(fields) < len(layout.fields) else "too_many_fields"
    for f, value in zip(layout.fields, fields, strict=True):
        if f.not_empty and not value:
            return None, f"empty_{f.name}"
    for f, value in zip(layout.fields, fields, strict=True):
        if f.kind == "text":
            if f.pattern and not layout.patterns[f.name].fullmatch(value) or f.one_of and value not in f.one_of:
                return None, f"bad_{f.name}"
        elif not value:
            if f.needed_if and fields[layout.names.index(f.needed_if[0])] == f.needed_if[1]:
                return None, f"missing_{f.name}"
        elif f.kind == "decimal":
            whole, dot, part = value.partition(".")
            if not _digits(whole) or dot and not _digits(part):
                return None, f"bad_{f.name}"
        elif not _digits(value) or int(value) > _BIGINT_MAX:
            return None, f"bad_{f.name}"
    return fields, None


def is_blank(record: str | None) -> bool:
    """An empty line, with or without a carriage return."""
    return record is not None and record.rstrip("\r\n") == ""


def is_header(record: str | None, layout: Layout = RUN) -> bool:
    return record is not None and record.startswith((layout.names[0], f'"{layout.names[0]}"')) and split_record(record)[0] == layout.names


_PARSE = pacsv.ParseOptions(newlines_in_values=True, double_quote=True, ignore_empty_lines=False)


def _parsed(records: list[bytes], layout: Layout) -> pa.Table | None:
    """The fields of a block as columns of text, or None if the parser rejects a record of it."""
    read = pacsv.ReadOptions(column_names=layout.names, use_threads=False, block_size=64 << 20)
    convert = pacsv.ConvertOptions(column_types=dict.fromkeys(layout.names, pa.string()), strings_can_be_null=False)
    try:
        got = pacsv.read_csv(pa.py_buffer(b"\n".join(records) + b"\n"), read, _PARSE, convert)
    except pa.ArrowInvalid:
        return None
    return got if got.num_rows == len(records) else None


def _parsed_parts(records: list[bytes], layout: Layout) -> Iterator[tuple[int, int, pa.Table | None]]:
    """(from, to, columns) of the parts that the block falls into: what the parser rejects is halved down to _LEAF records, whose columns are None."""
    pending = [(0, len(records))]
    while pending:
        a, b = pending.pop()
        table = _parsed(records[a:b], layout)
        if table is None and b - a > _LEAF:
            mid = (a + b) // 2
            pending += [(mid, b), (a, mid)]
        elif b > a:
            yield a, b, table


def _loadable(table: pa.Table, layout: Layout) -> np.ndarray:
    """Which records have good values in all fields, as far as columns tell: numbers of 19 digits are left to the strict reader."""
    fine = np.ones(table.num_rows, bool)
    for f in layout.fields:
        column = table.column(f.name)
        if f.kind != "text":
            filled = pc.match_substring_regex(column, r"^[0-9]+(?:\.[0-9]+)?\z" if f.kind == "decimal" else r"^[0-9]{1,18}\z")
            empty = pc.equal(column, "")
            if f.needed_if:
                empty = pc.and_(empty, pc.not_equal(table.column(f.needed_if[0]), f.needed_if[1]))
            fine &= pc.or_(filled, empty).to_numpy()
            continue
        if f.not_empty:
            fine &= pc.not_equal(column, "").to_numpy()
        if f.pattern:
            fine &= pc.match_substring_regex(column, rf"\A(?:{f.pattern})\z").to_numpy()
        if f.one_of:
            fine &= pc.is_in(column, pa.array(f.one_of)).to_numpy()
    return fine


def _typed(fields: list[str], layout: Layout) -> list:
    read = {"text": str, "decimal": float, "whole": int}
    return [read[f.kind](x) if x or f.kind == "text" else None for f, x in zip(layout.fields, fields, strict=True)]


def _ill_formed(records: pa.Array, layout: Layout) -> np.ndarray:
    """The numbers of records with quotes or line breaks out of place, which could be read together with their neighbours."""
    special = np.flatnonzero(pc.fill_null(pc.match_substring_regex(records, r'["\n]|\r(?s:.)'), True).to_numpy(zero_copy_only=False))
    return special[~pc.fill_null(pc.match_substring_regex(records.take(pa.array(special, pa.int64())), layout.record), False).to_numpy(zero_copy_only=False)]


def _typed_columns(table: pa.Table, layout: Layout) -> list[pa.Array]:
    columns = [c.combine_chunks() if table.num_rows else pa.array([], pa.string()) for c in table.columns]
    return [c if f.kind == "text" else pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c).cast(t) for c, f, t in zip(columns, layout.fields, layout.types, strict=True)]


def _bulk(records: pa.Array, layout: Layout = RUN) -> list[pa.Array] | None:
    """The columns of a block all of whose records are good, else None."""
    if len(_ill_formed(records, layout)):
        return None
    table = _parsed(records.cast(pa.binary()).to_pylist(), layout)
    if table is None:
        return None
    fine = _loadable(table, layout)
    rest = [i for i in np.flatnonzero(~fine).tolist() if diagnose(records[i].as_py(), layout)[0] is None]
    return None if rest else _typed_columns(table, layout)


def _sift(records: pa.Array, first: int, good: list, bad: list, layout: Layout = RUN) -> None:
    """Adds (row numbers, columns) to good and (row number, reason) to bad."""
    if (columns := _bulk(records, layout)) is not None:
        good.append((range(first, first + len(records)), columns))
        return
    strict = _ill_formed(records, layout)
    rest = np.setdiff1d(np.arange(len(records)), strict, assume_unique=True)
    lines = records.cast(pa.binary()).take(pa.array(rest, pa.int64())).to_pylist()
    doubtful = [strict]
    parts = []
    for a, b, table in _parsed_parts(lines, layout):
        if table is None:
            doubtful.append(rest[a:b])
        else:
            parts.append((rest[a:b], table))
    if parts:
        rows, table = np.concatenate([r for r, _ in parts]), pa.concat_tables([t for _, t in parts])
        fine = _loadable(table, layout)
        doubtful.append(rows[~fine])
        good.append((rows[fine] + first, _typed_columns(table.filter(pa.array(fine)), layout)))
    single = []
    for i in np.sort(np.concatenate(doubtful)).tolist():
        fields, reason = diagnose(records[i].as_py(), layout)
        if fields is None:
            bad.append((first + i, reason))
        else:
            single.append((first + i, _typed(fields, layout)))
    if single:
        good.append(([i for i, _ in single], [pa.array([r[k] for _, r in single], t) for k, t in enumerate(layout.types)]))


def _records_only(lines: pa.Array, layout: Layout = RUN) -> pa.Array:
    """Which rows are records: neither empty lines nor headers."""
    blank = pc.fill_null(pc.match_substring_regex(lines, r"\A[\r\n]*\z"), False).to_numpy(zero_copy_only=False)
    named = pc.fill_null(pc.match_substring_regex(lines, rf'\A"?{re.escape(layout.names[0])}'), False).to_numpy(zero_copy_only=False)
    drop = blank.copy()
    for i in np.flatnonzero(named):
        drop[i] = is_header(lines[i].as_py(), layout)
    return pa.array(np.flatnonzero(~drop), pa.int64())


def load_records(df: DataFrame, text: str = "raw_line", block: int = 1024, layout: Layout = RUN) -> DataFrame:
    """Every record of `df` but headers and empty lines, with its typed columns or the reason.

    Keeps all columns of `df` (a column that is called like one of the run is prefixed by
    `raw_`) and adds the columns of the layout and `reason`, null for a good record. A null
    text is a record that can't be loaded (`no_text`); repeated records stay repeated; an empty
    table gives an empty one. `block` bounds how many records are parsed at once.
    """
    clash = {c: f"raw_{c}" for c in df.columns if c.lower() in {*(n.lower() for n in layout.names), "reason"}}
    source = df.withColumnsRenamed(clash)
    text = clash.get(text, text)
    keep = source.columns
    schema = source.schema
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, {layout.schema}, reason string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                part = part.take(_records_only(part.column(keep.index(text)), layout))
                good: list = []
                bad: list = []
                _sift(part.column(keep.index(text)), 0, good, bad, layout)
                for rows, columns in good:
                    own = part.take(pa.array(rows, pa.int64()))
                    reason = pa.nulls(len(rows), pa.string())
                    yield pa.RecordBatch.from_arrays([*own.columns, *columns, reason], names=[*keep, *layout.names, "reason"])
                if bad:
                    own = part.take(pa.array([i for i, _ in bad], pa.int64()))
                    empty = [pa.nulls(len(bad), t) for t in layout.types]
                    reason = pa.array([r for _, r in bad], pa.string())
                    yield pa.RecordBatch.from_arrays([*own.columns, *empty, reason], names=[*keep, *layout.names, "reason"])

    return spread(source).mapInArrow(work, out)


def good_rows(loaded: DataFrame) -> DataFrame:
    return loaded.filter(F.col("reason").isNull()).drop("reason")


def bad_rows(loaded: DataFrame, layout: Layout = RUN) -> DataFrame:
    return loaded.filter(F.col("reason").isNotNull()).drop(*layout.names)
