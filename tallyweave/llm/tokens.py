"""Token counts by a public byte-level vocabulary whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file may be broadcast up to this size.
MOST_BYTES = 64_000_000

# Fixed value: the pattern by which this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def _encoder(key: str, data: bytes):
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def with_token_counts(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` and the number of tokens of `text`; null text has 0 tokens. The file is read once and sent to the tasks."""
    data = Path(vocabulary).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has more than {MOST_BYTES} bytes")
    sent = df.sparkSession.sparkContext.broadcast(data)
    source = df.select(*keep, F.col(text).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, sent.value)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(x)) if x else 0 for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, out])

    return spread(source).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` bigint"]))
