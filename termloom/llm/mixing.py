"""Mixing sources to target weights by distributed prefix sums over hash-random orders."""

from __future__ import annotations

from fractions import Fraction
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.tokens import DEFAULT_RANKS, token_counts
from termloom.plans.lineage import cut

#: most targets: they are part of the plan
MOST_TARGETS = 10_000
#: rows of one range of keys, should all rows belong to one source
RANGE_ROWS = 50_000


def source_name(column: str) -> Column:
    """Sources apart from letter case and blanks at the edges."""
    return F.lower(F.trim(F.regexp_replace(F.col(column).cast("string"), r"^[\s]+|[\s]+$", "")))


class Mixture:
    """Chosen documents and the shares reached.

    ``total``: tokens the mixture should hold; by default the most at which every source with any
    tokens can still meet its target within its repeats.  A source's budget is its share of the
    total, at most all its tokens times its repeats.  Each source is put into a hash-random order;
    whole epochs are taken while they fit into the budget, and the last epoch ends at the document
    that brings the sum nearest to the budget, so shares are off by half a document at most.

    The order is that of a 64-bit hash; its leading bits cut every source into ranges, whose sums
    give each range its offset, so a prefix sum never needs a whole source in one task.

    Null and empty texts have no tokens and are never chosen; null and unknown sources have no
    target.  Targets with a null source, or a share or repeats that is null, NaN or not above 0,
    are left out; a source given twice is an error.  Sources without documents are reported with
    nothing taken.  Repeated rows are documents of their own.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        *,
        total: int | None = None,
        seed: int = 42,
        ranks: str = DEFAULT_RANKS,
    ) -> None:
        self.spark = docs.sparkSession
        usable = targets.where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0")
        rows = usable.select(source_name("source").alias("source"), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        if len({r.source for r in rows}) < len(rows):
            raise ValueError("a source has two targets")
        self.targets = sorted((r.source, float(r.target_share), int(r.max_repeats)) for r in rows)
        wanted = docs.select(id_col, text_col, source_name(source_col).alias("__source"))
        names = F.broadcast(self.spark.createDataFrame([(s,) for s, _, _ in self.targets], "__source string"))
        wanted = wanted.join(names, "__source", "left_semi")
        self.sizes = cut(token_counts(wanted, id_col, text_col, ranks, extra=F.col("__source")).where("n_tokens > 0"))
        self.seed = seed
        held = {r.extra: int(r.t) for r in self.sizes.groupBy("extra").agg(F.sum("n_tokens").alias("t")).collect()}
        self.available = {s: held.get(s, 0) for s, _, _ in self.targets}
        shares = {s: Fraction(share).limit_denominator(10**12) for s, share, _ in self.targets}
        if total is None:
            total = min((int(self.available[s] * r / shares[s]) for s, _, r in self.targets if self.available[s]), default=0)
        self.aim(total)

    def aim(self, total: int) -> None:
        """Set the tokens that the mixture should hold, and with them every source's budget."""
        shares = {s: Fraction(share).limit_denominator(10**12) for s, share, _ in self.targets}
        self.total = total
        self.budgets = {s: min(int(shares[s] * total), self.available[s] * r) for s, _, r in self.targets}

    def chosen(self) -> DataFrame:
        """(source, doc_id, epoch, n_tokens): one row per copy of a chosen document."""
        plan = [(s, *divmod(self.budgets[s], self.available[s])) for s, _, _ in self.targets if self.available[s]]
        budgets = F.broadcast(self.spark.createDataFrame(plan, "source string, epochs bigint, rest bigint"))
        rows = self.sizes.withColumn("row", F.monotonically_increasing_id())  # of a materialised table
        bits = max(1, ceil(log2(max(2, self.sizes.count() / RANGE_ROWS)))) + 1
        keyed = rows.select(
            F.col("extra").alias("source"), F.col("id").alias("doc_id"), "n_tokens", "row", F.xxhash64("id", "row", F.lit(self.seed)).alias("key")
        ).withColumn("range_no", F.shiftrightunsigned("key", 64 - bits))
        sums = keyed.groupBy("source", "range_no").agg(F.sum("n_tokens").alias("own"))
        up_to = Window.partitionBy("source").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.withColumn("offset", F.coalesce(F.sum("own").over(up_to), F.lit(0))).drop("own")
        inside = Window.partitionBy("source", "range_no").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
        placed = keyed.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "range_no"])
        start = F.col("offset") + F.col("within")
        last = (2 * start + F.col("n_tokens") <= 2 * F.col("rest")).cast("int")
        copies = placed.join(budgets, "source").withColumn("copies", F.col("epochs") + last).where("copies > 0")
        return copies.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch"), "n_tokens")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, available_tokens, budget_tokens, taken_tokens,
        actual_share, reached) of every target."""
        plan = [(s, share, r, self.available[s], self.budgets[s], int(Fraction(share).limit_denominator(10**12) * self.total)) for s, share, r in self.targets]
        targets = self.spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available_tokens bigint, budget_tokens bigint, wanted bigint")
        taken = self.chosen().groupBy("source").agg(F.sum("n_tokens").alias("taken_tokens"))
        full = F.broadcast(targets).join(taken, "source", "left").withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0).cast("bigint")))
        whole = F.sum("taken_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
        actual = F.when(whole > 0, F.round(F.col("taken_tokens") / whole, 6)).otherwise(0.0)
        reached = (F.col("budget_tokens") >= F.col("wanted")) & (F.col("available_tokens") > 0)
        return full.withColumn("actual_share", actual).withColumn("reached", reached).drop("wanted")
