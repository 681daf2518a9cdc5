"""Top N items within every group by mergeable bounded heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows gathered before the heaps are cut back to N
GATHER = 100_000
#: a task hands its heaps on when they hold this many rows
FLUSH_ROWS = 1_000_000

_ORDER = [("grp", "ascending"), ("score", "descending"), ("item", "ascending")]


def _shrink(table: pa.Table, n: int) -> pa.Table:
    """The N best distinct items of each group: the heaps' content, best first."""
    table = table.take(pc.sort_indices(table, sort_keys=_ORDER)).combine_chunks()
    rows = len(table)
    if not rows:
        return table
    # of a repeated (group, item) the first, which has the highest score, stays
    pair = pa.table({"grp": table["grp"], "item": table["item"], "at": pa.array(np.arange(rows))})
    firsts = pair.group_by(["grp", "item"], use_threads=False).aggregate([("at", "min")])["at_min"].to_numpy()
    if len(firsts) < rows:
        table = table.take(pa.array(np.sort(firsts))).combine_chunks()
    groups = table["grp"].to_numpy()
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    place = np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))
    return table.filter(pa.array(place < n))


def _heaps(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        held = 0

        def merged() -> pa.Table:
            tables = [pa.Table.from_batches(waiting)] if waiting else []
            return _shrink(pa.concat_tables(([heaps] if heaps is not None else []) + tables), n)

        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= max(GATHER, len(heaps) if heaps is not None else 0):
                heaps, waiting, held = merged(), [], 0
                if len(heaps) > FLUSH_ROWS:
                    yield from heaps.to_batches()
                    heaps = None
        if waiting or heaps is not None:
            yield from merged().to_batches()

    return run


def top_n(results: DataFrame, n: int, group: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """(group, rank_no, item, score): the ``n`` items of every group with the highest scores.

    An item counts once per group with its highest score; equal scores rank by the item in byte
    order.  Each task keeps a heap of the N best distinct items per group while it reads (an item
    among the best N overall is among the best N wherever its highest score occurs), so at most
    N rows per group and task are shuffled, whatever the group's size; the heaps are merged after
    one exchange.  Heaps are handed on early when a task sees very many groups.

    Scores that are null or NaN, and null items or groups, are left out; an infinite score is a
    score.  An empty table gives no rows.  ``n`` must be at least 1.  Groups must be integers.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = results.select(F.col(group).cast("bigint").alias("grp"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    heaps = rows.mapInArrow(_heaps(n), rows.schema).repartition("grp")
    best = heaps.groupBy("grp", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "item")
    return (
        best.withColumn("rank_no", F.row_number().over(order))
        .where(F.col("rank_no") <= n)
        .select(F.col("grp").alias(group), "rank_no", F.col("item").alias(item), F.col("score").alias(score))
    )
