"""Dense row positions and size-based grouping in scan order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.lineage import cut, store

_IN_PARTITION = (1 << 33) - 1


def with_positions(df: DataFrame, column: str = "ordinal", start: int = 0) -> DataFrame:
    """Number the rows densely in their present order, without moving them.

    The rows are materialised first; then one small count per partition gives every partition its
    offset, and the position within the partition is free.
    """
    rows = cut(df)
    counts = {r.p: r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], start
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    table = rows.sparkSession.createDataFrame(list(enumerate(offsets)), "__p int, __offset bigint")
    marked = rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    placed = marked.join(F.broadcast(table), "__p").withColumn(column, F.col("__offset") + F.col("__i"))
    return placed.drop("__p", "__i", "__offset")


def staged(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, stored with their task ``__p`` and their place ``__i`` in it: their present order,
    however the table is read."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    return store(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", place), "staged", path)


def _sums(table: pa.Table) -> np.ndarray:
    sizes = table.column("size").fill_null(0).to_numpy()[np.argsort(table.column("__i").to_numpy())]
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes, dtype=np.int64)])


_STEPS = "part int, low bigint, closed bigint, left bigint, adds boolean, n bigint"


def _steps(target: int):
    """The rows of one task as a function of the bytes ``filled`` in the group open before them.

    The first cut is a step function of ``filled``, and what follows a cut depends on that cut
    only; most first cuts soon lead to the same ones, so few steps differ.  A step holds from
    ``low`` filled bytes up to the next step: so many groups are ``closed``, and ``left`` bytes
    are in the last one, on top of ``filled`` where none is closed (``adds``).
    """

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        sums = _sums(table)
        n = len(sums) - 1
        following = np.searchsorted(sums, sums + target, "left")  # the next cut after each place
        cuts = (following <= n).astype(np.int64)
        last = np.where(cuts, following, np.arange(n + 1))
        while (further := cuts[last]).any():
            cuts, last = cuts + further, last[last]
        firsts = np.arange(min(int(following[0]), n), 0, -1)
        firsts = firsts[sums[firsts] > sums[firsts - 1]]
        low, closed, left = np.maximum(target - sums[firsts], 0), 1 + cuts[firsts], sums[n] - sums[last[firsts]]
        keep = np.ones(len(firsts), dtype=bool)
        keep[1:] = (closed[1:] != closed[:-1]) | (left[1:] != left[:-1])
        low, closed, left = (np.append(x, y[keep]) for x, y in (([0], low), ([0], closed), (sums[n:], left)))
        size = len(low)
        return pa.table(
            {
                "part": pa.array([key[0].as_py()] * size, pa.int32()), "low": pa.array(low, pa.int64()), "closed": pa.array(closed, pa.int64()),
                "left": pa.array(left, pa.int64()), "adds": pa.array(np.arange(size) == 0), "n": pa.array([n] * size, pa.int64()),
            }
        )

    return run


_ENTRIES = "part bigint, first bigint, n bigint, groups bigint, filled bigint"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps in order -> per task the rows, closed groups and filled bytes before it."""
    part, first, n, groups, filled, step = None, 0, 0, 0, 0, (0, 0, True)
    for batch in batches:
        out = []
        for p, low, closed, left, adds, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                first, groups, filled = first + n, groups + step[0], step[1] + (filled if step[2] else 0)
                part, n = p, size
                out.append((part, first, n, groups, filled))
            if low <= filled:
                step = closed, left, adds
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=[c.split()[0] for c in _ENTRIES.split(", ")])


def _cuts(target: int, entries: dict[int, int]):
    """(part, places in it where a group starts)."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        sums, places = _sums(table), []
        at = int(np.searchsorted(sums, target - entries[part], "left"))
        while at < len(sums):
            places.append(at)
            at = int(np.searchsorted(sums, sums[at] + target, "left"))
        return pa.table({"part": pa.array([part], pa.int32()), "places": pa.array([places], pa.list_(pa.int64()))})

    return run


def grouped(rows: DataFrame, target: int, size: str = "n_bytes", group: str = "group_no", order: str | None = None, start: int = 0) -> tuple[DataFrame, int]:
    """(the rows with a group number each, how many they are): in order, a group is closed once it
    has reached ``target``, then the next one starts at 0.  ``order`` names a column for the dense
    position, from ``start``.  Null sizes count as 0; sizes are not negative.

    ``rows`` come from :func:`staged`.  Each cut depends on all cuts before it, but a task's rows
    act as a short step function of the bytes filled before them: the functions are found in
    parallel from 20 bytes a row, one task chains them, a few rows per task, and every task's
    cuts are then found in parallel.  The rows themselves are not moved.  The driver holds one
    number per group, as the list of segments does.
    """
    if target < 1:
        raise ValueError("the target size must be positive")
    sizes = rows.select("__p", "__i", F.col(size).cast("bigint").alias("size"))
    steps = sizes.groupBy("__p").applyInArrow(_steps(target), _STEPS).repartition(1).sortWithinPartitions("part", "low", F.desc("adds"))
    entries = {r.part: r for r in steps.mapInArrow(_chain, _ENTRIES).collect()}
    found = sizes.groupBy("__p").applyInArrow(_cuts(target, {p: r.filled for p, r in entries.items()}), "part int, places array<bigint>").collect()
    table = [(r.part, entries[r.part].first, entries[r.part].groups, r.places) for r in found]
    placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, "__p int, __first bigint, __groups bigint, __places array<bigint>")), "__p")
    before = F.size(F.filter("__places", lambda place: place <= F.col("__i")))
    placed = placed.withColumn(group, F.col("__groups") + before)
    if order:
        placed = placed.withColumn(order, F.col("__first") + F.col("__i") + F.lit(start))
    return placed.drop("__p", "__i", "__first", "__groups", "__places"), sum(r.n for r in entries.values())


def greedy_groups(sizes: DataFrame, target: int, order: str = "ordinal", size: str = "n_bytes") -> DataFrame:
    """(order, size, group_no): :func:`grouped` in the order of a column."""
    pairs = sizes.select(F.col(order).cast("bigint"), F.col(size).cast("bigint"))
    return grouped(staged(pairs.orderBy(order)), target, size)[0]
