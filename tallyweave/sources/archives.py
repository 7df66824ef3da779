"""Members of archives as rows, and the difference of two containers by member."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBER_SCHEMA = "format string, key string, hash bigint, bytes bigint, error string"
#: Bytes that an archive may expand to; an archive that is larger is an error, not a member list.
MOST_EXPANDED = 256 << 20
_CHUNK = 1 << 20


class TooLarge(ValueError):
    pass


def _expand(reader, most: int) -> bytes:
    out, size = [], 0
    while chunk := reader.read(_CHUNK):
        size += len(chunk)
        if size > most:
            raise TooLarge("expands beyond the limit")
        out.append(chunk)
    return b"".join(out)


def sniff(data: bytes) -> str | None:
    for magic, name in ((b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gzip"), (b"\xfd7zXZ\x00", "xz"), (b"BZh", "bzip2")):
        if data.startswith(magic):
            return name
    return "tar" if data[257:262] == b"ustar" else None


def _member_hash(crc: int, size: int) -> int:
    """The checksum in the upper and the size in the lower half of 64 bits, as a bigint."""
    value = (crc << 32 ^ size) & (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def members(data: bytes, most: int = MOST_EXPANDED) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The format and (path, hash, size) of every member; of a zip nothing is decompressed. No archive: (None, [])."""
    kind = sniff(data)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return kind, [(i.filename, _member_hash(i.CRC, i.file_size), i.file_size) for i in z.infolist() if not i.is_dir()]
    if kind in ("gzip", "xz", "bzip2"):
        opened = {"gzip": gzip.open, "xz": lzma.open, "bzip2": bz2.open}[kind](io.BytesIO(data))
        data = _expand(opened, most)
        if sniff(data) != "tar":
            return kind, [("(content)", _member_hash(zlib.crc32(data), len(data)), len(data))]
    if kind is None:
        return None, []
    out, size = [], 0
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile():
                size += m.size
                if size > most:
                    raise TooLarge("expands beyond the limit")
                body = t.extractfile(m).read()
                out.append((m.name, _member_hash(zlib.crc32(body), m.size), m.size))
    return kind, out


def archive_members(files: DataFrame, content: str, keep: list[str], most: int = MOST_EXPANDED) -> DataFrame:
    """`keep` and MEMBER_SCHEMA: a row per member; one row with an error for what can't be read; none for what is no archive."""
    source = files.select(*keep, content)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                if data is None:
                    continue
                try:
                    kind, found = members(data, most)
                    rows += [(kind, *m, None) for m in found]
                    ids += [i] * len(found)
                except Exception as e:  # a broken archive must not end the batch
                    rows.append((sniff(data), None, None, None, f"{type(e).__name__}: {e}"))
                    ids.append(i)
            if rows:
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                own = batch.take(pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keep)], *columns], names=[*keep, *(p.split()[0] for p in MEMBER_SCHEMA.split(", "))])

    return source.mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), MEMBER_SCHEMA]))


def member_diff(before: DataFrame, after: DataFrame, scope: list[str], key: str, hash_: str) -> DataFrame:
    """scope, key, change (added, removed, changed, unchanged): one aggregation of both sides, which needs no join."""
    side = lambda d, s: d.select(*scope, key, F.when(F.lit(s == 0), F.col(hash_)).alias("_b"), F.when(F.lit(s == 1), F.col(hash_)).alias("_a"), F.lit(1 - s).alias("_nb"), F.lit(s).alias("_na"))
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*scope, key).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"), F.sum("_nb").alias("_nb"), F.sum("_na").alias("_na"))
    change = F.when(F.col("_nb") == 0, "added").when(F.col("_na") == 0, "removed").when(F.col("_b").eqNullSafe(F.col("_a")), "unchanged").otherwise("changed")
    return both.select(*scope, key, change.alias("change"))
