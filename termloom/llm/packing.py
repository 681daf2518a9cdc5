"""Filling fixed-capacity containers with items: sum-of-squares packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.tokens import DEFAULT_RANKS, token_counts
from termloom.plans.lineage import cut

#: items of one shard, which is packed by one task
SHARD_ITEMS = 25_000
#: most kinds of containers: they are part of the plan
MOST_KINDS = 1_000

PACK_SCHEMA = "container_kind string, capacity int, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"


class SumOfSquares:
    """Containers of one capacity; ``open_at[g]`` counts those with a residual gap of g.

    An item goes where the sum over all gaps g with 0 < g < capacity of ``open_at[g] ** 2``
    becomes smallest: moving a container from gap g to gap g - s changes it by
    ``2 * (open_at[g - s] - open_at[g] + 1)``, by one less and without the first count where it
    becomes full, and a new container adds ``2 * open_at[capacity - s] + 1``.  Of equal changes
    the tightest fit is taken.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open_at = np.zeros(capacity + 1, dtype=np.int64)
        self.stacks: dict[int, list[int]] = {}
        self.fills: list[int] = []

    def _new(self) -> int:
        self.fills.append(0)
        return len(self.fills) - 1

    def place(self, size: int) -> int:
        """The container an item of 1 to ``capacity`` goes to."""
        n, cap = self.open_at, self.capacity
        best, change = -1, (2 * int(n[cap - size]) + 1) if size < cap else 0
        there = n[size:cap]
        if there.size:
            deltas = 2 * (n[: cap - size] - there + 1)  # open_at[0] stays 0
            deltas[0] -= 1
            deltas[there == 0] = np.iinfo(np.int64).max
            at = int(deltas.argmin())
            if deltas[at] <= change and there[at]:
                best = size + at
        if best < 0:
            box, gap = self._new(), cap
        else:
            box, gap = self.stacks[best].pop(), best
            n[best] -= 1
        gap -= size
        self.fills[box] = cap - gap
        if gap:
            n[gap] += 1
            self.stacks.setdefault(gap, []).append(box)
        return box


def _tighten(boxes: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Repack the items of containers that are left under nine tenths full: largest first, each
    into the tightest gap.  Kept only if it saves containers."""
    fills = np.bincount(boxes, weights=sizes).astype(np.int64)
    loose = np.flatnonzero(fills * 10 < capacity * 9)
    items = np.flatnonzero(np.isin(boxes, loose))
    gaps: list[tuple[int, int]] = []
    moved, used = {}, 0
    for i in items[np.argsort(-sizes[items], kind="stable")]:
        size = int(sizes[i])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, box = gaps.pop(at)
        else:
            if used == len(loose):
                return boxes
            gap, box = capacity, used
            used += 1
        moved[i] = box
        if gap > size:
            insort(gaps, (gap - size, box))
    if used < len(loose):
        boxes = boxes.copy()
        for i, box in moved.items():
            boxes[i] = loose[box]
    return boxes


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece number, start, tokens, container) of every piece of the items in order."""
    pieces = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    length = np.minimum(sizes[item] - start, capacity)
    packer = SumOfSquares(capacity)
    box = np.array([packer.place(int(s)) if s else -1 for s in length], dtype=np.int64)
    packed = length > 0
    if packed.any():
        box[packed] = _tighten(box[packed], length[packed], capacity)
    box[~packed] = box.max() if packed.any() else 0  # nothing to hold: with the last container
    return item, number, start, length, box


def pack(
    docs: DataFrame,
    kinds: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    ranks: str = DEFAULT_RANKS,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Every text assigned to a container of every kind, sizes in tokens.

    ``kinds``: (container_kind, capacity_tokens), a few rows of configuration.  The result has
    one row per text, kind and piece: a text is cut only if it exceeds the capacity, into full
    pieces and a remainder that is packed like any item.  No container holds more than its
    capacity.

    The items are spread evenly over shards by position, however alike or repeated they are; each
    shard is packed by itself, in order, by the sum-of-squares rule, and the containers it leaves
    loose are repacked.  Only sizes are shuffled, never texts.

    Null and empty texts have no tokens and come with some container of their shard; null ids
    stay null; repeated rows are items of their own.  Kinds with a null name or a capacity that
    is null or below 1 are left out; of a repeated name the smallest capacity counts.  Empty
    tables give no rows; other columns are ignored.
    """
    chosen = kinds.where("container_kind is not null and capacity_tokens >= 1").groupBy("container_kind").agg(F.min("capacity_tokens").alias("c")).limit(MOST_KINDS + 1).collect()
    if len(chosen) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    sizes = cut(token_counts(docs, id_col, text_col, ranks))
    shards = max(1, ceil(sizes.count() / shard_items))
    options = [F.struct(F.lit(r.container_kind).alias("kind"), F.lit(int(r.c)).alias("capacity")) for r in sorted(chosen)]
    place = F.monotonically_increasing_id()  # of a materialised table: the same at every attempt
    items = sizes.withColumn("place", place).withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    if not options:
        return sizes.sparkSession.createDataFrame([], PACK_SCHEMA)
    each = items.select("id", "n_tokens", "place", "shard", F.explode(F.array(*options)).alias("k")).select("id", "n_tokens", "place", "shard", "k.kind", "k.capacity")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        capacity, shard = int(group["capacity"].iloc[0]), int(group["shard"].iloc[0])
        item, number, start, length, box = pack_sizes(group["n_tokens"].to_numpy(np.int64), capacity)
        ids = group["id"].astype("Int64").to_numpy()
        return pd.DataFrame(
            {
                "container_kind": group["kind"].iloc[0],
                "capacity": np.int32(capacity),
                "container_id": box + (shard << 32),
                "doc_id": pd.array(ids[item], dtype="Int64"),
                "piece_no": number.astype(np.int32),
                "start_token": start,
                "n_tokens": length,
            }
        )

    return each.groupBy("kind", "shard").applyInPandas(run, PACK_SCHEMA)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity, containers, pieces, tokens, fill): how full the containers are."""
    boxes = packed.groupBy("container_kind", "capacity", "container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    totals = boxes.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"))
    return totals.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
