"""Sizes of texts in tokens of a public subword tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how the public byte-level vocabulary cuts a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: vocabularies are of fixed size; a larger file is not broadcast
MAX_VOCABULARY_BYTES = 16_000_000


def with_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The kept columns and tokens (bigint); null and empty texts have 0. The vocabulary is read on the driver only."""
    data = Path(vocabulary).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than a vocabulary")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["__text"]]
            yield b[keep].assign(tokens=pd.Series(sizes, index=b.index, dtype="int64"))

    slim = df.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInPandas(run, f"{fields}, tokens bigint")
