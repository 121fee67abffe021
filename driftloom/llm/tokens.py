"""Sizes of texts in tokens of a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, a parameter of every operator here; it must lie at this path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(vocabulary: str):
    """The tokenizer of a rank file, loaded once per process. Strings of special tokens are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, keep: Sequence[str], text: str = "text", vocabulary: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """The kept columns and the number of tokens of the whole text.

    A null or empty text has 0 tokens. Texts of any length are encoded whole. A kept column may have any name but ``name``.
    """
    kept = [docs.schema[k] for k in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], names=[*(f.name for f in kept), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` bigint"])
    return docs.select(*keep, F.col(text)).mapInArrow(count, schema)
