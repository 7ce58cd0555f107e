"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary file of byte-level BPE ranks: one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that tokenizer splits text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The tokenizer, built once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(vocabulary: str = VOCABULARY):
    """A column function: tokens of the whole text, 0 for null and empty ones."""

    @F.pandas_udf("bigint")
    def count(text: pd.Series) -> pd.Series:
        e = encoder(vocabulary)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in text], dtype="int64")

    # a filter on the count would else be evaluated once before the repartitioning below it and once after
    return count.asNondeterministic()


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core: a scan of few files would leave cores without work that costs far more than reading."""
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def source_name(c: Column) -> Column:
    """A source without case and surrounding blanks; blank ones are null."""
    t = F.lower(F.btrim(c, F.lit(" \t")))
    return F.when(t != "", t)
