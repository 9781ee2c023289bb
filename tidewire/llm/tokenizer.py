"""Public byte-level BPE tokenizers in Python workers. Their files stay where they are; the folder is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import SparkSession

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
_SHIPPED: set[tuple[str, str]] = set()
#: Fixed value: the splitting pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The tiktoken encoder; loaded once a worker."""
    import tiktoken

    path = f"{folder}/{name}.tiktoken"
    if not os.path.exists(path):  # a machine without the folder: the file came with the job
        from pyspark import SparkFiles

        path = SparkFiles.get(f"{name}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """Length in bytes of each token id."""
    import numpy as np

    ranks = encoder(name, folder)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        out[i] = len(token)
    return out


def ship_tokenizer(spark: SparkSession, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> None:
    """Send the vocabulary file along to machines that may lack the folder; once an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _SHIPPED:
        spark.sparkContext.addFile(f"{folder}/{name}.tiktoken")
        _SHIPPED.add(key)


def id_type(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if len(token_bytes(name, folder)) <= 1 << 16 else "<u4"
