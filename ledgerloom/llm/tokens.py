"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary stands on the driver; its bytes (under 1 MB) are broadcast to the workers.
VOCABULARY = os.environ.get("LEDGERLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How this vocabulary cuts a text before merging (fixed value, published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[int, object] = {}


def encoding(raw: bytes):
    import tiktoken

    key = hash(raw)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _LOADED[key] = tiktoken.Encoding("public_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def with_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text; null and empty texts have 0."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(shared.value)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, F.pandas_udf(count, "bigint")(text))
