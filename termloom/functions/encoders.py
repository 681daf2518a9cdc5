"""Encoders turn texts into sparse vectors.

An encoder has a ``model_id`` and ``encode(df, text_col)``, which adds ``token_ids`` and
``weights``.  :class:`LexicalEncoder` is a stand-in for a neural model, made of SQL expressions
only; :class:`UdfEncoder` wraps a user's model in an Arrow-batched iterator UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import vectors

VOCABULARY = 30522


class Encoder(Protocol):
    model_id: str

    def encode(self, df: DataFrame, text_col: str) -> DataFrame: ...


def model_id_of(model: Any) -> str:
    """A model's name: its own ``model_id``, else what its card or attributes say, else unknown."""
    card = getattr(model, "model_card_data", None)
    for owner, attribute in ((model, "model_id"), (card, "base_model"), (card, "model_id"), (card, "model_name"), (model, "_model_name"), (model, "model_name")):
        value = getattr(owner, attribute, None)
        if isinstance(value, str) and value:
            return value
    return "unknown"


class LexicalEncoder:
    """Terms are runs of ``[a-z0-9]`` in the lower-cased text; a term's token is a hash modulo the
    vocabulary, its weight ``ln(1 + occurrences)``; of colliding terms the larger weight stays."""

    model_id = "lexical-md5-30522"

    @staticmethod
    def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        terms = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
        counts = terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
        token = F.conv(F.substring(F.md5("term"), 1, 7), 16, 10).cast("bigint") % VOCABULARY
        weighed = counts.select(id_col, token.alias("token_id"), F.ln(1 + F.col("n")).cast("float").alias("weight"))
        return weighed.groupBy(id_col, "token_id").agg(F.max("weight").alias("weight"))

    def encode(self, df: DataFrame, text_col: str) -> DataFrame:
        """Per row and in place: sorting the terms puts equal ones side by side, so no shuffle."""
        terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        rows = df.withColumn("__t", F.sort_array(terms)).withColumn("__n", F.size("__t"))
        # every term beside the one before it and its place: runs of equal terms start where they
        # differ, and only one term of each run is hashed
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice("__t", F.lit(1), F.greatest(F.col("__n"), F.lit(1))))
        placed = F.arrays_zip(F.col("__t").alias("term"), before.alias("b"), F.sequence(F.lit(0), F.greatest(F.col("__n") - 1, F.lit(0))).alias("i"))
        rows = rows.withColumn("__s", F.filter(placed, lambda x: x["term"].isNotNull() & ~x["term"].eqNullSafe(x["b"])))
        ends = F.concat(F.slice(F.col("__s.i"), F.lit(2), F.greatest(F.size("__s"), F.lit(1))), F.array("__n"))
        counts = F.zip_with(F.col("__s.i"), ends, lambda i, e: F.when(i.isNotNull(), F.ln((1 + e - i).cast("double")).cast("float")))
        tokens = F.transform("__s.term", lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("bigint") % VOCABULARY)
        rows = rows.withColumn("token_ids", tokens).withColumn("weights", F.filter(counts, lambda w: w.isNotNull()))
        return vectors.normalised(rows.drop("__t", "__s", "__n"))


class DenseEncoder:
    """The text column already holds dense encodings."""

    def __init__(self, model_id: str = "dense", threshold: float = vectors.THRESHOLD) -> None:
        self.model_id, self.threshold = model_id, threshold

    def encode(self, df: DataFrame, text_col: str) -> DataFrame:
        return vectors.extract_sparse(df, text_col, self.threshold)


class UdfEncoder:
    """A model with ``encode(list of texts)`` -> dense rows, built once per Python worker."""

    def __init__(self, build: Callable[[], Any], model_id: str | None = None, threshold: float = vectors.THRESHOLD, batch: int = 256) -> None:
        self.build, self.threshold, self.batch = build, threshold, batch
        self.model_id = model_id or model_id_of(build())

    def encode(self, df: DataFrame, text_col: str) -> DataFrame:
        build, size = self.build, self.batch

        def dense(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = build()
            for series in texts:
                rows = []
                for k in range(0, len(series), size):
                    rows += [[float(x) for x in v] for v in model.encode(series.iloc[k : k + size].fillna("").tolist())]
                yield pd.Series(rows, index=series.index, dtype=object)

        encoded = F.pandas_udf(dense, "array<float>")
        rows = df.withColumn("__dense", encoded(F.col(text_col)))
        return vectors.normalised(vectors.extract_sparse(rows, "__dense", self.threshold).drop("__dense"))
