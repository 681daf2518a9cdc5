"""Building, normalising and measuring sparse vectors with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: weights must exceed this, compared as 32-bit floats
THRESHOLD = 1e-3


def above(weight: Column, threshold: float = THRESHOLD) -> Column:
    """Strictly above the threshold as 32-bit floats; NaN and null are not."""
    return weight.isNotNull() & ~F.isnan(weight) & (weight > F.lit(threshold).cast("float"))


def sparsify(dense: Column, threshold: float = THRESHOLD) -> Column:
    """Dense array -> array of (token_id, weight); the token is the position, from 0."""
    pairs = F.transform(dense, lambda x, i: F.struct(i.cast("bigint").alias("token_id"), x.cast("float").alias("weight")))
    return F.filter(pairs, lambda p: above(p["weight"], threshold))


def sparsify_rows(df: DataFrame, id_col: str, dense_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, token_id, weight) of a dense column; exploding keeps the expressions in generated code."""
    exploded = df.select(F.col(id_col), F.posexplode(dense_col).alias("token_id", "weight"))
    weight = F.col("weight").cast("float")
    return exploded.select(id_col, F.col("token_id").cast("bigint").alias("token_id"), weight.alias("weight")).where(above(F.col("weight"), threshold))


def first_row(matrix: Column) -> Column:
    """A two-dimensional encoding stands for its first row."""
    return F.get(matrix, F.lit(0))


def extract_sparse(df: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``token_ids`` and ``weights`` from an encoding column.

    Structs with ``indices`` and ``values`` are taken as they are, only cast; arrays of numbers are
    dense and cut off at ``threshold``; arrays of arrays stand for their first row.  Any other
    type is a ValueError.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType) and {"indices", "values"} <= set(kind.fieldNames()):
        return df.withColumn("token_ids", F.col(f"{column}.indices").cast("array<bigint>")).withColumn("weights", F.col(f"{column}.values").cast("array<float>"))
    dense = F.col(column)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        dense, kind = first_row(dense), kind.elementType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)):
        raise ValueError(f"unsupported encoding: {kind.simpleString()}")
    pairs = sparsify(dense, threshold)
    return df.withColumn("__pairs", pairs).withColumn("token_ids", F.col("__pairs.token_id")).withColumn("weights", F.col("__pairs.weight")).drop("__pairs")


def normalised(df: DataFrame, tokens: str = "token_ids", weights: str = "weights", *, deduplicate: bool = True) -> DataFrame:
    """Both arrays sorted by token; of repeated tokens the largest weight stays.

    With ``deduplicate=False`` repeats stay, in their order.  Null tokens, and null or NaN weights
    of repeated tokens, are dropped by deduplication; surplus entries of unequal arrays are
    dropped.  Vectors that are sorted and unique already take a short cut.
    """
    pairs = F.arrays_zip(F.col(tokens).cast(T.ArrayType(T.LongType())).alias("t"), F.col(weights).cast(T.ArrayType(T.FloatType())).alias("w"))
    length = F.least(F.size(tokens), F.size(weights))
    if not deduplicate:
        stable = F.sort_array(F.transform(F.slice(pairs, F.lit(1), F.greatest(length, F.lit(0))), lambda p, i: F.struct(p["t"].alias("t"), i.alias("i"), p["w"].alias("w"))))
        out = df.withColumn("__v", stable)
        return out.withColumn(tokens, F.col("__v.t")).withColumn(weights, F.col("__v.w")).drop("__v")
    clean = F.filter(F.sort_array(pairs), lambda p: p["t"].isNotNull() & p["w"].isNotNull() & ~F.isnan(p["w"]))
    out = df.withColumn("__s", clean).withColumn("__v", last_of_runs("__s"))
    return out.withColumn(tokens, F.col("__v.t")).withColumn(weights, F.col("__v.w")).drop("__v", "__s")


def last_of_runs(column: str) -> Column:
    """The last of every run of equal ``t`` in a sorted array of (t, w), none of them null.

    Each entry is put beside the next one's ``t`` first: the lambda looks at nothing but its own
    argument, so the array is never evaluated again per entry, wherever the optimizer moves it.
    """
    following = F.slice(F.col(f"{column}.t"), F.lit(2), F.greatest(F.size(column), F.lit(1)))
    beside = F.arrays_zip(F.col(f"{column}.t").alias("t"), F.col(f"{column}.w").alias("w"), following.alias("n"))
    return F.filter(beside, lambda p: p["t"].isNotNull() & ~p["t"].eqNullSafe(p["n"]))


def has_duplicates(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) < F.size(tokens)


def norm(weights: Column) -> Column:
    """L2 norm over all weights, in double."""
    return F.sqrt(F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w.cast("double") * w.cast("double")))


def postings(df: DataFrame, id_col: str, tokens: str = "token_ids", weights: str = "weights") -> DataFrame:
    """(id, token_id, weight): one row per entry, of repeated tokens the largest weight."""
    exploded = df.select(F.col(id_col), F.explode(F.arrays_zip(F.col(tokens).alias("t"), F.col(weights).alias("w"))).alias("e"))
    rows = exploded.select(id_col, F.col("e.t").cast("bigint").alias("token_id"), F.col("e.w").cast("float").alias("weight"))
    return rows.where(F.col("token_id").isNotNull() & F.col("weight").isNotNull() & ~F.isnan("weight")).groupBy(id_col, "token_id").agg(F.max("weight").alias("weight"))


def postings_with_norm(df: DataFrame, key: str, tokens: str = "token_ids", weights: str = "weights") -> DataFrame:
    """(key, token_id, weight, norm) of normalised vectors: the norm is found in the row, before
    its entries are spread out, so nothing is shuffled."""
    measured = df.select(key, F.arrays_zip(F.col(tokens).alias("t"), F.col(weights).alias("w")).alias("v"), norm(F.col(weights)).alias("norm"))
    # the outer form keeps the optimizer from testing the arrays' sizes in a filter of its own,
    # which would build them twice
    spread = measured.select(key, "norm", F.explode_outer("v").alias("e"))
    rows = spread.select(key, F.col("e.t").alias("token_id"), F.col("e.w").alias("weight"), "norm")
    return rows.where(F.col("token_id").isNotNull())


def to_arrays(rows: DataFrame, id_col: str) -> DataFrame:
    """The inverse of :func:`postings`: sorted arrays per id."""
    gathered = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("token_id").alias("t"), F.col("weight").alias("w")))).alias("v"))
    return gathered.select(id_col, F.col("v.t").alias("token_ids"), F.col("v.w").alias("weights"))
