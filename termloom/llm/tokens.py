"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: place of the rank file on every machine; pass another one as ``ranks``
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# fixed value: the pattern that splits text before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_counts(docs: DataFrame, id_col: str, text_col: str, ranks: str = DEFAULT_RANKS, *, extra: Column | None = None) -> DataFrame:
    """(id, extra, n_tokens): one row per row; null texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "extra", "n_tokens"])

    extra = F.lit(None) if extra is None else extra
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), extra.cast("string").alias("extra"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, extra string, n_tokens bigint")
