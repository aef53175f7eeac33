"""Token counts of whole texts with a public tokenizer's vocabulary; its path is a parameter and it is never copied."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("LONJA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    enc = _encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_count(c: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; null and empty texts have none."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(s.where(s.notna(), None).tolist(), path), dtype="int64")

    return count(c)


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    return docs.select(*keep, token_count(F.col(text), path).alias("n_tokens"))
