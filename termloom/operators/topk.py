"""Best rows per query under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: scores are compared rounded: sums of floats differ in their last bits from run to run
DIGITS = 6


def top_k(scored: DataFrame, k: int | Column, doc_key: str = "doc_id", digits: int = DIGITS, *, most: int | None = None) -> DataFrame:
    """(query_id, rank, doc_key, score): rank by rounded score, then by key.

    ``k``: a number from 1 up, or a column of the query's own, then with ``most``, the largest of
    them (null and values below 1 ask for nothing).  A partial limit per task precedes the
    shuffle, so hot queries send at most so many rows per task.
    """
    if not isinstance(k, int) and most is None:
        raise ValueError("a column of limits needs their largest")
    if isinstance(k, int) and k < 1:
        raise ValueError("top_k must be at least 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), doc_key)
    rounded = scored.withColumn("score", F.round("score", digits))
    ranked = rounded.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k) if isinstance(k, int) else ranked.where((F.col("rank") <= most) & (F.col("rank") <= k))


def candidates(scored: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """All rows that can still be among the best ``k``: ties at the cut stay for a later key."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    rounded = scored.withColumn("score", F.round("score", digits))
    return rounded.withColumn("__r", F.rank().over(order)).where(F.col("__r") <= k).drop("__r")
