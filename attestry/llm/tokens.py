"""Sizes of texts in tokens of a public tokenizer whose rank file lies at the same path on every executor."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def sized(df: DataFrame, text: str, keep: list[str], ranks: str = RANKS, pattern: str = PATTERN, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of the whole ``text``, without special tokens.

    Null and empty texts have none.  One pass, no shuffle; only ``keep`` and ``text`` reach Python.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def count(batches):
        encode = encoder(ranks, pattern).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b[text].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], n], [*keep, out])

    return df.select(*keep, *([] if text in keep else [text])).mapInArrow(count, schema)


