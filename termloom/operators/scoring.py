"""Similarity of sparse vectors as an equi-join on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.vectors import norm
from termloom.plans.lineage import cut

#: query terms up to this many rows (about 40 bytes each) are broadcast
BROADCAST_TERMS = 1_000_000


def cosine(dot: Column, a: Column, b: Column) -> Column:
    """Dot product over the product of the norms; 0 where a norm is 0."""
    product = a * b
    return F.when(product == 0, F.lit(0.0)).otherwise(dot / F.when(product != 0, product))


def score_pair(dt: str, dw: str, qt: str, qw: str, *, metric: str = "cosine") -> Column:
    """Similarity of two normalised vectors that stand in one row, token by token."""
    positions = F.transform(dt, lambda t: F.array_position(F.col(qt), t))
    products = F.zip_with(
        positions, dw, lambda p, w: F.when(p > 0, w.cast("double") * F.get(F.col(qw), (p - 1).cast("int")).cast("double")).otherwise(0.0)
    )
    dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return cosine(dot, norm(F.col(dw)), norm(F.col(qw))) if metric == "cosine" else dot


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token_id, weight) -> repeats settled by the largest weight, with the norm."""
    terms = queries.where("token_id is not null and weight is not null and not isnan(weight)").groupBy("query_id", "token_id").agg(F.max("weight").alias("q_weight"))
    norms = terms.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q_weight").cast("double") * F.col("q_weight").cast("double"))).alias("q_norm"))
    return terms.join(norms, "query_id")


def score(postings: DataFrame, terms: DataFrame, doc_key: str = "ordinal", *, metric: str = "cosine") -> DataFrame:
    """(query_id, doc_key, score) of every document that shares a token with a query, score > 0.

    ``postings``: (token_id, doc_key, weight, norm), the norm over all weights of the document.
    ``terms``: from :func:`query_terms`.  The query side is broadcast if its checked size allows,
    so postings stream past it and only partial sums per (query, document) are shuffled;
    otherwise both sides are hash-partitioned by token, where adaptive execution splits hot ones.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    terms = cut(terms)
    small = terms.count() <= BROADCAST_TERMS
    product = F.col("weight").cast("double") * F.col("q_weight").cast("double")
    sums = (
        postings.join(F.broadcast(terms) if small else terms, "token_id")
        .groupBy("query_id", doc_key)
        .agg(F.sum(product).alias("dot"), F.max("norm").alias("norm"), F.max("q_norm").alias("q_norm"))
    )
    value = cosine(F.col("dot"), F.col("norm"), F.col("q_norm")) if metric == "cosine" else F.col("dot")
    return sums.select("query_id", doc_key, value.alias("score")).where("score > 0")


def with_norms(postings: DataFrame, doc_key: str) -> DataFrame:
    """Postings with each document's norm, for collections whose norms are not stored."""
    square = F.col("weight").cast("double") * F.col("weight").cast("double")
    norms = postings.groupBy(doc_key).agg(F.sqrt(F.sum(square)).alias("norm"))
    return postings.join(norms, doc_key)
