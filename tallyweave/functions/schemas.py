"""Validation of JSON against a schema of ten keywords."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
# The keywords that are known.
KEYWORDS = {"type", "properties", "required", "additionalProperties", "items", "enum", "const", "minimum", "$defs", "$ref", "description", "title", "$schema"}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def violation(value: object, schema: dict, root: dict | None = None, at: str = "$") -> str | None:
    """The path of the first violation, or None. An unknown keyword is an error of the schema."""
    root = schema if root is None else root
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"unknown keywords: {sorted(unknown)}")
    if "$ref" in schema:
        target: object = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]  # type: ignore[index]
        return violation(value, target, root, at)  # type: ignore[arg-type]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return at
    if "const" in schema and value != schema["const"] or "enum" in schema and value not in schema["enum"]:
        return at
    if "minimum" in schema and _is(value, "number") and value < schema["minimum"]:  # type: ignore[operator]
        return at
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}"
        known = schema.get("properties", {})
        for name, inner in value.items():
            if name in known:
                found = violation(inner, known[name], root, f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found = f"{at}.{name}"
            elif isinstance(schema.get("additionalProperties"), dict):
                found = violation(inner, schema["additionalProperties"], root, f"{at}.{name}")
            else:
                found = None
            if found:
                return found
    if isinstance(value, list) and "items" in schema:
        for i, inner in enumerate(value):
            found = violation(inner, schema["items"], root, f"{at}[{i}]")
            if found:
                return found
    return None


def check_json(df: DataFrame, column: str, schema: dict, keep: list[str]) -> DataFrame:
    """`keep`, violation: null for valid JSON, `not json` for what can't be read, else the first violating path."""
    source = df.select(*keep, column)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return "not json"
        return violation(value, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(t) for t in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "violation"])

    return source.mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "violation string"]))
