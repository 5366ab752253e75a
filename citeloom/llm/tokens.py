"""Token counts of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: cl100k_base if its rank file lies in the folder; else the public vocabulary there that is nearest to it (many languages).
NAMES = ("cl100k_base.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Splits words, numbers of up to three digits, punctuation and blanks before merging (fixed values, the published pattern).
PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    return next((p for n in NAMES if os.path.exists(p := os.path.join(FOLDER, n))), os.path.join(FOLDER, NAMES[-1]))


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str | None = None) -> int:
    """Tokens of text; 0 for null and empty ones. Strings of special tokens count as ordinary text."""
    if not text:
        return 0
    return len(encoding(tokenizer_path(path)).encode_ordinary(text))


def n_tokens(text: Column, path: str | None = None) -> Column:
    where = tokenizer_path(path)

    @F.pandas_udf("int")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(t, where) for t in s], dtype="int32")

    return counts(text)
