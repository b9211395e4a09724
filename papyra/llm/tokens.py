"""Token counts by a public tokenizer; the vocabulary file is a parameter and stays outside the package."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Default vocabulary file: byte-level BPE ranks, one "base64 rank" line each.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    """The encoder of a ranks file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("papyra", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER):
    """An Arrow UDF text -> number of tokens; null and empty texts have 0."""

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        e = encoding(path)
        return pa.array([len(e.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int32())

    return count


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """Add the token count of ``text``."""
    return df.withColumn(out, token_counter(path)(F.col(text)))


def may_exceed(text: Column, limit: int) -> Column:
    """False only where the text cannot have more than ``limit`` tokens: a token has a byte or more."""
    return F.octet_length(text) > limit
