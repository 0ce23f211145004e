"""Sizes of texts in tokens of a public tokenizer, and even shards for work on sized records."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE in tiktoken's format; any other such file may be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens a shard holds about: enough for many containers, few enough for one task.
SHARD_TOKENS = 4_000_000


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def with_tokens(rows: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the column ``text`` replaced by ``tokens``, the length of the whole text; null texts have no row."""
    others = [c for c in rows.columns if c != text]
    data = rows.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.where(F.col(text).isNotNull()).select(*others, text).mapInArrow(_count(data), f"{schema}, tokens long")


def sharded(sized: DataFrame, key: str, total: int, per_shard: int = SHARD_TOKENS) -> DataFrame:
    """``sized`` with ``shard``, a hash of ``key`` into as many shards as ``total`` tokens need, and ``turn``, a hash order."""
    shards = max(1, -(-total // per_shard))
    turn = F.xxhash64(F.col(key), F.lit(7))
    return sized.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).withColumn("turn", turn)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()
