"""Files, repositories, logs and tables outside of parquet."""

from __future__ import annotations

import json
import os
import sqlite3
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.paths import is_anomalous, renamed_from, renamed_to


def repositories(base: str) -> list[str]:
    """`base` itself if it is a checkout, else its children that are, sorted. A listing of one folder."""
    if os.path.isdir(os.path.join(base, ".git")):
        return [base]
    return sorted(e.path for e in os.scandir(base) if e.is_dir() and os.path.isdir(os.path.join(e.path, ".git")))


def file_scan(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of all regular files below `base` whose path isn't anomalous; content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    return files.filter(~is_anomalous(F.col("path")))


def as_text(content: str) -> F.Column:
    """UTF-8 text, or null where the bytes aren't."""
    # Decoding raises on bytes that aren't UTF-8, a cast doesn't; the test is on what the cast gives.
    return F.try_validate_utf8(F.col(content).cast("string"))


#: Bytes of the beginning in which a zero byte tells a binary file.
BINARY_PREFIX = 8000


def is_binary(content: F.Column) -> F.Column:
    """Whether the bytes are no text: a zero byte among the first BINARY_PREFIX ones, unless a UTF-16 mark begins them."""
    # Of Latin-1 every byte is one character, so a zero byte is a zero character.
    zero = F.instr(F.decode(F.substring(content, 1, BINARY_PREFIX), "ISO-8859-1"), "\0") > 0
    return F.when(content.isNotNull(), zero & utf16_mark(content).isNull())


def utf16_mark(content: F.Column) -> F.Column:
    """`UTF-16LE` or `UTF-16BE` by the mark at the beginning, else null."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "FFFE", "UTF-16LE").when(head == "FEFF", "UTF-16BE")


def decoded_text(content: F.Column, latin1: bool = False) -> F.Column:
    """The text of a file: UTF-16 by its mark, else UTF-8 (its mark dropped); null for binary files.

    Bytes that are neither count as binary, unless `latin1` reads them as such, which takes any
    bytes. A UTF-16 file of an odd number of bytes is null as well.
    """
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\uFEFF", "")
    sixteen = lambda name: F.decode(F.substring(content, F.lit(3), F.octet_length(content)), name)
    mark = utf16_mark(content)
    whole = F.octet_length(content) % 2 == 0
    return (
        F.when(is_binary(content), None)
        .when((mark == "UTF-16LE") & whole, sixteen("UTF-16LE"))
        .when((mark == "UTF-16BE") & whole, sixteen("UTF-16BE"))
        .when(mark.isNotNull(), None)
        .otherwise(F.coalesce(utf8, F.decode(content, "ISO-8859-1")) if latin1 else utf8)
    )


def read_csv(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """A CSV table with a fixed header: the columns of `schema` in the order of the file.

    Fields may be quoted, quotes within are doubled, records may span lines. With `strict` a
    record that doesn't fit fails the job, else its columns are null and `_corrupt` holds it.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", False)
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).schema(StructType([*wanted.fields, StructField("_corrupt", StringType())])).csv(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """`rows` as CSV parts with the header `columns`; nulls are empty fields. With `order`, the parts in the order of their names are sorted as a whole."""
    out = rows.select(*columns)
    if order:
        out = out.orderBy(*order)
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def line_requests(lines: DataFrame, line: str, answer: Callable[[F.Column], F.Column], out: str = "answer") -> DataFrame:
    """The reply `request, tab, answer` to each line, its end and blanks around it cut: `line`, `out`. Empty lines have no reply, an unknown answer is empty."""
    asked = F.trim(F.regexp_replace(F.col(line), "[\r\n]+$", ""))
    return lines.select(line, F.when(asked != "", F.concat(asked, F.lit("\t"), F.coalesce(answer(asked), F.lit("")))).alias(out))


def json_requests(lines: DataFrame, line: str, work: Callable[[dict], object], out: str = "reply") -> DataFrame:
    """A JSON reply to each JSON request: `{"id", "result"}`, or `{"id", "error"}` for one that can't be read or fails; the rest goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for text in batch.column(0).to_pylist():
                name = None
                try:
                    request = json.loads(text or "")
                    name = request.get("id")
                    replies.append(json.dumps({"id": name, "result": work(request)}, ensure_ascii=False))
                except Exception as e:
                    replies.append(json.dumps({"id": name, "error": f"{type(e).__name__}: {e}"}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], names=[line, out])

    return lines.select(line).mapInArrow(run, f"`{line}` string, `{out}` string")


def each_isolated(rows: DataFrame, key: str, work: Callable[[object], str]) -> DataFrame:
    """key, result, error: `work` for each key; what fails is an error of its row, the rest goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for k in batch.column(0).to_pylist():
                try:
                    done.append(work(k))
                    errors.append(None)
                except Exception as e:
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string()), pa.array(errors, pa.string())], names=[key, "result", "error"])

    return rows.select(key).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, result string, error string")


def resume(todo: DataFrame, done_path: str, key: str) -> DataFrame:
    """The rows of `todo` whose key isn't in the log of finished ones (parquet, appended to); all if there is no log yet."""
    spark = todo.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return todo
    return todo.join(spark.read.parquet(done_path).select(key).distinct(), key, "left_anti")


def numstat(lines: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """`keep`, old_path, path, added, removed of numstat lines; `-` counts are binary files and null; other lines have no row."""
    parts = F.split(F.col(line), "\t", 3)
    rows = lines.filter(F.col(line).rlike(r"^(?:\d+|-)\t(?:\d+|-)\t."))
    count = lambda i: F.when(parts[i] != "-", parts[i].cast("int"))
    return rows.select(*keep, renamed_from(parts[2]).alias("old_path"), renamed_to(parts[2]).alias("path"), count(0).alias("added"), count(1).alias("removed"))


HISTORY_SCHEMA = "repository string, commit string, parents int, committed_at timestamp, shallow boolean, change_type string, old_path string, path string, added int, removed int, error string"


def commit_history(repos: DataFrame, path: str, most: int | None = None, command: str = "git") -> DataFrame:
    """HISTORY_SCHEMA: the changed files of the commits of each checkout, one row per file, read from its objects by `git log`.

    A repository is one unit of work, streamed as the log comes; `most` visits only so many of its
    latest commits (before any filter on parents). A commit that changes nothing has one row without
    a path, a merge likewise. Binary files have null counts. `shallow` marks commits at the boundary
    of a shallow clone. A folder that can't be read is one row with its error; the rest goes on.
    """
    names = [f.split()[0] for f in HISTORY_SCHEMA.split(", ")]
    ask = [command, "-c", "core.quotepath=off", "log", "--raw", "--numstat", "--no-abbrev", "-M", "-z", "--format=%x01%H%x02%P%x02%ct"] + ([f"-{most}"] if most else [])

    def rows_of(folder: str) -> Iterator[tuple]:
        said = tempfile.TemporaryFile()
        done = subprocess.Popen([ask[0], "-C", folder, *ask[1:]], stdout=subprocess.PIPE, stderr=said)
        boundary = set()
        marker = os.path.join(folder, ".git", "shallow")
        if os.path.exists(marker):
            with open(marker) as f:
                boundary = set(f.read().split())
        for block in blocks_of(done.stdout):
            head, _, rest = block.decode("utf-8", "surrogateescape").partition("\0")
            commit, parents, when = head.split("\x02")
            base = (folder, commit, len(parents.split()), datetime.fromtimestamp(int(when), timezone.utc), commit in boundary)
            kinds: dict[str, tuple[str, str | None]] = {}
            counts: dict[str, tuple[int | None, int | None]] = {}
            parts = iter(rest.lstrip("\n").split("\0"))
            for part in parts:
                part = part.lstrip("\n")
                if part.startswith(":"):
                    kind = part.split()[-1]
                    old = next(parts)
                    kinds[next(parts) if kind[0] in "RC" else old] = (kind, old if kind[0] in "RC" else None)
                elif part.count("\t") >= 2:
                    added, removed, name = part.split("\t", 2)
                    if not name:  # a rename: the old and the new path follow
                        next(parts)
                        name = next(parts)
                    counts[name] = tuple(None if x == "-" else int(x) for x in (added, removed))
            if not kinds:
                yield (*base, None, None, None, None, None, None)
            for name, (kind, old) in sorted(kinds.items()):
                clean = lambda x: None if x is None else x.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                yield (*base, kind, clean(old), clean(name), *counts.get(name, (None, None)), None)
        if done.wait():
            said.seek(0)
            raise OSError(said.read().decode("utf-8", "replace").strip() or f"{command} failed")

    def blocks_of(stream: IO[bytes]) -> Iterator[bytes]:
        """What follows each mark, as it comes."""
        held = b""
        while chunk := stream.read(1 << 20):
            *whole, held = (held + chunk).split(b"\x01")
            yield from filter(None, whole)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    for row in rows_of(folder):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)
                            rows = []
                except (OSError, ValueError, TypeError) as e:
                    rows.append((folder, *[None] * 9, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    types = repos.sparkSession.createDataFrame([], HISTORY_SCHEMA).schema
    return repos.select(path).mapInArrow(run, HISTORY_SCHEMA)


def code_edits(changes: DataFrame, commits: DataFrame, key: list[str], parents: str, shallow: DataFrame | None = None) -> DataFrame:
    """Rows of numstat() that count as edits: of commits that merge nothing, not at the boundary of a shallow clone, not binary."""
    rows = changes.filter("added is not null and removed is not null").join(commits.filter(F.col(parents) <= 1).select(*key).distinct(), key, "left_semi")
    return rows.join(shallow.select(*key), key, "left_anti") if shallow is not None else rows


def snapshot_delta(before: DataFrame, after: DataFrame, path: str, blob: str, renames: bool = True) -> DataFrame:
    """change_type (A, D, M, R), path, old_path between two snapshots of (path, blob).

    With `renames`, a lost and a new path of one blob that is alone on either side are a rename.
    """
    sides = before.select(path, F.col(blob).alias("_b")).join(after.select(path, F.col(blob).alias("_a")), path, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    kind = F.when(F.col("_b").isNull(), "A").when(F.col("_a").isNull(), "D").otherwise("M")
    changes = sides.select(kind.alias("change_type"), F.col(path).alias("path"), "_a", "_b")
    if not renames:
        return changes.select("change_type", "path", F.lit(None).cast("string").alias("old_path"))
    moved = changes.filter("change_type <> 'M'").groupBy(F.coalesce("_a", "_b").alias("_blob")).agg(
        F.count_if(F.col("change_type") == "A").alias("_new"), F.count_if(F.col("change_type") == "D").alias("_old"),
        F.max(F.when(F.col("change_type") == "A", F.col("path"))).alias("path"), F.max(F.when(F.col("change_type") == "D", F.col("path"))).alias("old_path"),
    ).filter("_new = 1 and _old = 1")
    rest = changes.withColumn("_blob", F.coalesce("_a", "_b")).join(moved.select("_blob", F.lit(True).alias("_renamed")), "_blob", "left").filter((F.col("change_type") == "M") | F.col("_renamed").isNull())
    return rest.select("change_type", "path", F.lit(None).cast("string").alias("old_path")).unionByName(moved.select(F.lit("R").alias("change_type"), "path", "old_path"))


class _SqlitePart(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [_SqlitePart(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_SqlitePart(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """`spark.read.format("sqlite_table").schema(...).option("table", t).load(path)`: ranges of rowid are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("sqlite_table needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("table", table).option("partitions", partitions).load(path)


def rewritten(rows: DataFrame, path: str, column: str, new: F.Column, write: bool) -> DataFrame:
    """`rows` with `column` replaced; written to `path` only if `write`, as a new table in one commit."""
    out = rows.withColumn(column, new)
    if write:
        out.write.mode("overwrite").parquet(path)
    return out
