"""How distinctive a term is per record: log-entropy weighting in two SQL aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.vectors import last_of_runs
from termloom.plans.lineage import cut

#: a usable weight is above this, compared as 32-bit floats
CUTOFF = 0.001
#: term statistics up to this many rows (about 40 bytes each) are broadcast
BROADCAST_TERMS = 2_000_000


def _usable(weight: Column) -> Column:
    return weight.isNotNull() & ~F.isnan(weight) & (weight > F.lit(CUTOFF).cast("float"))


def usable_entries(docs: DataFrame, id_col: str = "ordinal", tokens: str = "token_ids", weights: str = "weights") -> DataFrame:
    """(record, token_id, weight) of every usable entry; of a repeated token the largest weight.

    Repeats are settled inside the row: only rows that hold a token twice are sorted, so no
    shuffle is needed and clean rows pay nothing.
    """
    rows = docs.select(
        F.col(id_col).alias("record"),
        F.arrays_zip(F.col(tokens).alias("t"), F.col(weights).cast("array<float>").alias("w")).alias("pairs"),
        (F.size(F.array_distinct(tokens)) < F.size(tokens)).alias("repeats"),
    )
    rows = rows.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(F.filter("pairs", lambda p: p["t"].isNotNull() & _usable(p["w"])))))
    settled = F.transform(last_of_runs("sorted"), lambda p: F.struct(p["t"].alias("t"), p["w"].alias("w")))
    entries = F.when(F.col("repeats"), settled).otherwise(F.col("pairs"))
    # the outer form keeps the optimizer from building the arrays a second time in a filter
    return (
        rows.select("record", F.explode_outer(entries).alias("e"))
        .select("record", F.col("e.t").alias("token_id"), F.col("e.w").alias("weight"))
        .where(F.col("token_id").isNotNull() & _usable(F.col("weight")))
    )


def term_spread(entries: DataFrame, n_records: int, spread: str = "weight") -> DataFrame:
    """First aggregation: per term the records, the total and the entropy of its spread.

    With shares ``f / total`` over the records of a term, the entropy is
    ``ln(total) - sum(f ln f) / total``; ``deficit`` is ``ln N`` less that entropy and
    ``global_weight`` the deficit over ``ln N``, one minus the normalised entropy.
    ``spread='presence'`` gives each record an equal share.
    """
    f = F.lit(1.0) if spread == "presence" else F.col("weight").cast("double")
    f_log_f = F.lit(0.0) if spread == "presence" else f * F.ln(f)
    ln_n = F.lit(float(max(n_records, 1))).cast("double")
    return (
        entries.groupBy("token_id")
        .agg(F.count(F.lit(1)).alias("records"), F.sum(f).alias("total"), F.sum(f_log_f).alias("f_log_f"))
        .withColumn("deficit", F.ln(ln_n) - (F.ln("total") - F.col("f_log_f") / F.col("total")))
        .withColumn("global_weight", F.lit(1.0) if n_records <= 1 else F.col("deficit") / F.ln(ln_n))
        .drop("f_log_f")
    )


def log_entropy(
    docs: DataFrame,
    id_col: str = "ordinal",
    tokens: str = "token_ids",
    weights: str = "weights",
    *,
    spread: str = "weight",
    local: str = "log",
    normalised: bool = True,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(record, token_id, weight, records, score): every usable entry with its log-entropy score.

    Score = local frequency (``log``: ln(1 + weight); ``raw``: the weight) times one minus the
    normalised entropy of the term's spread across records; ``normalised=False`` leaves out the
    constant division by ln N.

    Null or empty arrays, null tokens, null, NaN and cut-off weights give no entry; arrays of
    unequal length lose the surplus.  An empty table gives no rows.  Every row counts as a record,
    repeated ones too.  In a collection of one record every global weight is 1.  Other columns
    are ignored, so clashing names do no harm.
    """
    n = docs.count()
    entries = usable_entries(docs, id_col, tokens, weights)
    terms = cut(term_spread(entries, n, spread))
    if terms.count() <= broadcast_terms:
        terms = F.broadcast(terms)
    factor = F.col("global_weight") if normalised else F.col("deficit")
    weight = F.col("weight").cast("double")
    return entries.join(terms, "token_id").select(
        "record",
        "token_id",
        "weight",
        "records",
        ((F.log1p(weight) if local == "log" else weight) * factor).alias("score"),
    )


def top_terms(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Second aggregation: the ``k`` highest rounded scores per record, ties by smaller token."""
    order = Window.partitionBy("record").orderBy(F.desc("score"), "token_id")
    return (
        scored.withColumn("score", F.round("score", digits))
        .withColumn("rank_no", F.row_number().over(order))
        .where(F.col("rank_no") <= k)
    )
