"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, and the vocabulary used where none is named.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "n_tokens", pa.array(sizes, pa.int32()))

    return run


def sized(docs: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` in the place of the text; rows with a null text are dropped, an empty one has 0."""
    rows = docs.where(F.col(text).isNotNull()).select(*(c for c in docs.columns if c not in (text, "text", "n_tokens")), F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_count(path or f"{FOLDER}/{VOCABULARY}"), f"{schema}, n_tokens int")
