"""Sizes of texts in tokens of a public tokenizer. The vocabulary file's path is a parameter; nothing is trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The encoding of a rank file, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(texts: list[str | None], path: str = DEFAULT_VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null and empty ones. Lone surrogates count as replacement characters."""
    enc = encoder(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: list[str] = [], path: str = DEFAULT_VOCABULARY) -> DataFrame:  # noqa: B006
    """``id_col``, the columns of ``keep`` and ``n_tokens`` (BIGINT) of the whole text. Null and empty texts have 0."""
    source = df.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = StructType([*fields, StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_tokens(batch.column(batch.num_columns - 1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(run, schema)
