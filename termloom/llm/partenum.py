"""PartEnum signatures: similar sets of one size band share at least one signature.

The feature domain is partitioned, and subsets of the partitions are enumerated; a signature is
the hash of a set's projection on such a subset.  Sets of sizes a and b with Jaccard similarity
of at least g differ in at most ``(1 - g) / (1 + g) * (a + b)`` features (their Hamming
distance), and a differing feature spoils only the subsets that hold its partition.

Two kinds of partitioning, chosen per size band by :func:`plan`:

* ``parts``: two levels of hash partitions, ``n1`` groups of ``n2`` parts; every subset of
  ``n2 - k2`` parts of a group is enumerated.  Some group has at most ``k2`` spoiled parts, so
  some subset is untouched.
* ``finest``: every feature is a partition of its own.  This is taken where the allowed distance
  is so large that coarser parts would leave next to no feature per signature (low thresholds,
  tiny sets) or need more than ``MOST_SIGNATURES`` (long sets: at 0.8, from 567 features up).  At most ``n - ceil(g n)`` of a set's n features are missing in a similar set, so
  enumerating one more than that, in an order common to all sets, is enough.  The order is
  rarest first, by counters over the whole collection, which keeps signatures selective; any
  order is correct.

Candidates are cut down by exact bounds (sizes, Hamming distance of 128-bit parity maps) before
any set is fetched, then verified on the full sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.textform import mix64
from termloom.plans.lineage import cut, store

#: counters of the rarity order: 2 to this power, one byte each in a task
COUNTER_BITS = 23
_BLOCK = 1 << 14
#: below this threshold only the finest partitioning is used
COARSE_FROM = Fraction(3, 4)
#: fewest expected features per signature, and most signatures per set and band, for ``parts``
LEAST_FEATURES, MOST_SIGNATURES = 4, 128
#: id lists up to this many rows are broadcast
BROADCAST_IDS = 2_000_000

_U1, _SHIFT = np.uint64(1), np.uint64(64 - COUNTER_BITS)


def fraction(threshold: float) -> Fraction:
    g = Fraction(str(threshold))
    if not 0 < g <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    return g


def bands(largest: int, g: Fraction) -> list[int]:
    """Upper bounds of the size bands: sets of similarity g lie in one band or in neighbours."""
    uppers, low = [], 1
    while low <= largest:
        uppers.append(max(low, int(Fraction(low) / g)))
        low = uppers[-1] + 1
    return uppers


def plan(upper: int, g: Fraction) -> tuple[int, int, int] | None:
    """(n1, n2, k2) of a band of sizes up to ``upper``; None for the finest partitioning."""
    if g < COARSE_FROM:
        return None
    k = int((1 - g) / (1 + g) * 2 * upper)
    best = None
    for k2 in range(1, 4):
        n1 = ceil((k + 1) / (k2 + 1))
        for n2 in range(k2 + 1, k2 + 4):
            count = n1 * comb(n2, k2)
            if upper * (n2 - k2) / (n1 * n2) >= LEAST_FEATURES and count <= MOST_SIGNATURES and (best is None or count < best[0]):
                best = count, (n1, n2, k2)
    return best and best[1]


class Signatures:
    """Signatures of single sets under one threshold."""

    def __init__(self, threshold: float) -> None:
        self.g = fraction(threshold)
        self.uppers: list[int] = []
        self.plans: list[tuple[int, int, int] | None] = []
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def band_of(self, size: int) -> int:
        while not self.uppers or self.uppers[-1] < size:
            self.uppers = bands(max(size, 2 * (self.uppers[-1] if self.uppers else 8)), self.g)
        while len(self.plans) <= len(self.uppers):
            at = len(self.plans)
            low = (self.uppers[at - 1] if at else 0) + 1
            self.plans.append(plan(max(low, int(Fraction(low) / self.g)), self.g))
        return int(np.searchsorted(self.uppers, size))

    def coarse(self, features: np.ndarray, owner: np.ndarray, n: int, band: int, shape: tuple[int, int, int]) -> np.ndarray:
        """One row of signatures for each of ``n`` sets, ``owner`` being the set of each feature."""
        n1, n2, k2 = shape
        if (n2, k2) not in self.masks:
            subsets = list(itertools.combinations(range(n2), n2 - k2))
            mask = np.zeros((len(subsets), n2), dtype=np.uint64)
            for i, s in enumerate(subsets):
                mask[i, list(s)] = 1
            self.masks[n2, k2] = mask
        parts = n1 * n2
        cells = np.zeros(n * parts, dtype=np.uint64)
        spread = mix64(features ^ np.uint64(0xC2B2AE3D27D4EB4F))
        np.add.at(cells, owner * parts + (spread % np.uint64(parts)).astype(np.int64), mix64(features))
        sums = (cells.reshape(n, n1, n2) @ self.masks[n2, k2].T).reshape(n, -1)
        place = np.arange(sums.shape[1], dtype=np.uint64) + np.uint64((band + 1) << 32)
        return mix64(sums + mix64(place))

    def kinds(self, size: int) -> tuple[list[tuple[int, tuple[int, int, int]]], bool]:
        """(the bands with parts and their plans, whether the finest partitioning is needed) for
        sets of a size: its own band and the next one."""
        band = self.band_of(size)
        shapes = [(at, self.plans[at]) for at in (band, band + 1)]
        return [(at, shape) for at, shape in shapes if shape is not None], any(shape is None for _, shape in shapes)

    def of_many(self, features: np.ndarray, sizes: np.ndarray, rarity: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, the number of the set each belongs to) of sets that stand one after the
        other, each sorted.  ``rarity`` (one byte) orders the features; those not ``shared`` occur
        in no other set."""
        distinct, which = np.unique(sizes, return_inverse=True)
        kinds = [self.kinds(int(n)) for n in distinct]
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        needed = -(-sizes * self.g.numerator // self.g.denominator)
        enumerated = np.where(np.array([fine for _, fine in kinds], dtype=bool)[which], sizes - needed + 1, 0)
        order = np.argsort((owner << 8) | rarity, kind="stable")  # by set, rarity, feature
        chosen = order[np.arange(len(features)) - starts[owner] < enumerated[owner]]
        chosen = chosen[shared[chosen]]
        tokens, owners = [features[chosen]], [owner[chosen]]
        planned: dict[tuple[int, tuple[int, int, int]], list[int]] = {}
        for k, (shapes, _) in enumerate(kinds):
            for shape in shapes:
                planned.setdefault(shape, []).append(k)
        for (band, shape), of_kind in planned.items():
            sets = np.flatnonzero(np.isin(which, of_kind))
            member = np.full(len(sizes), -1)
            member[sets] = np.arange(len(sets))
            inside = np.flatnonzero(member[owner] >= 0)
            rows = self.coarse(features[inside], member[owner[inside]], len(sets), band, shape)
            tokens.append(rows.ravel())
            owners.append(np.repeat(sets, rows.shape[1]))
        return np.concatenate(tokens), np.concatenate(owners)

    def of(self, features: np.ndarray, rarity: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The sorted signatures of one set."""
        return np.unique(self.of_many(features, np.array([len(features)]), rarity, shared)[0])


def parity_maps(features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per set 128 bits, each the parity of the features hashed to it, as two signed integers."""
    at = owner * 128 + (features & np.uint64(127)).astype(np.int64)
    bits = (np.bincount(at, minlength=128 * n) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(n, 128), axis=1).view(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTER_BITS, dtype=np.uint8)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            at = (np.frombuffer(data, dtype=np.uint64) >> _SHIFT).astype(np.int64)
            at, times = np.unique(at, return_counts=True)
            counts[at] = np.minimum(counts[at] + times, 255)
    blocks = counts.reshape(-1, _BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    for i in range(0, len(used), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[i : i + 64], pa.int32()), pa.array([blocks[b].tobytes() for b in used[i : i + 64]], pa.binary())], names=["block", "counts"]
        )


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = sums.setdefault(block, np.zeros(_BLOCK, dtype=np.uint32))
            held += np.frombuffer(data, dtype=np.uint8)
    # steps of an eighth of an octave; 0 and 1 stay what they are
    levels = {b: np.minimum(255, np.ceil(8 * np.log2(np.maximum(s, 1))) + (s > 0)).astype(np.uint8) for b, s in sums.items()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(levels), pa.int32()), pa.array([x.tobytes() for x in levels.values()], pa.binary())], names=["block", "counts"]
    )


def rarity_table(sets: DataFrame) -> bytes:
    """Rarity levels of all features by hashed counters: a table of fixed size (8 MB), whatever
    the collection's size.  Level 1 means a single occurrence in the whole collection."""
    schema = "block int, counts binary"
    partial = sets.select("features").mapInArrow(_counter, schema)
    table = np.zeros((1 << COUNTER_BITS) // _BLOCK * _BLOCK, dtype=np.uint8).reshape(-1, _BLOCK)
    for row in partial.repartition("block").mapInArrow(_adder, schema).toLocalIterator():
        table[row.block] = np.frombuffer(row.counts, dtype=np.uint8)
    return table.tobytes()


TOKEN_SCHEMA = "token bigint, id bigint, size int, b0 bigint, b1 bigint"
_MAP = ["b0", "b1"]


def signatures(sets: DataFrame, threshold: float, order: Broadcast, *, all_features: bool = False) -> DataFrame:
    """(id, features) -> one row per signature, with the set's size and parity map.

    ``order``: the broadcast counters of :func:`rarity_table`.  A feature that these count once
    occurs in no second set and gives no signature, unless ``all_features`` are wanted, as sets
    still unknown may hold them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Signatures(threshold)
        levels = np.frombuffer(order.value, dtype=np.uint8)
        for batch in batches:
            data = batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in data], dtype=np.int64)
            ids = batch.column(0).to_numpy()
            # about a million features at a time
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(np.cumsum(sizes) >> 20)) + 1).tolist(), len(data)]):
                if a == b:
                    continue
                features, own = np.frombuffer(b"".join(data[a:b]), dtype=np.uint64), sizes[a:b]
                level = levels[(features >> _SHIFT).astype(np.int64)]
                tokens, owner = make.of_many(features, own, level, np.ones(len(features), dtype=bool) if all_features else level > 1)
                maps = parity_maps(features, np.repeat(np.arange(b - a), own), b - a)[owner]
                columns = [tokens.view(np.int64), ids[a:b][owner], own[owner].astype(np.int32), *(np.ascontiguousarray(maps[:, c]) for c in range(2))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "size", *_MAP])

    return sets.select("id", "features").mapInArrow(run, TOKEN_SCHEMA)


@contextmanager
def meeting(signed: DataFrame, tokens: DataFrame, bits: int = 24) -> Iterator[DataFrame]:
    """The rows of ``signed`` whose token may occur in ``tokens``, by a bitmap of fixed size
    (2 MB): cheap to broadcast, and what it lets through wrongly, the join drops.  The bitmap is
    given up at the end of the ``with`` block."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            bitmap[(mix64(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        blocks = bitmap.reshape(-1, 1 << 17)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(blocks[b]).tobytes() for b in used], pa.binary())], names=["block", "counts"])

    table = np.zeros((1 << bits >> 17, 1 << 14), dtype=np.uint8)
    for row in tokens.select("token").mapInArrow(mark, "block int, counts binary").toLocalIterator():
        table[row.block] |= np.frombuffer(row.counts, dtype=np.uint8)
    known = signed.sparkSession.sparkContext.broadcast(table.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(known.value, dtype=np.uint8)
        for batch in batches:
            at = (mix64(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            yield batch.filter(pa.array((bitmap[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0))

    try:
        yield signed.select("token", "id", "size", *_MAP).mapInArrow(keep, TOKEN_SCHEMA)
    finally:
        known.destroy()


def _near_enough(a: DataFrame, b: DataFrame, g: Fraction) -> Column:
    """Exact bounds: sizes within the ratio g, and parity maps within the Hamming distance."""
    n, d = g.numerator, g.denominator
    sa, sb = a["size"].cast("bigint"), b["y_size"].cast("bigint")
    flips = sum((F.bit_count(a[m].bitwiseXOR(b[f"y_{m}"])) for m in _MAP), F.lit(0))
    return (sa * d >= sb * n) & (sb * d >= sa * n) & (flips * (d + n) <= (sa + sb) * (d - n))


def _overlaps(g: Fraction):
    n, d = g.numerator, g.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * d >= n * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def within(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join with a list of ids, broadcast only if its size is checked."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def distinct_sets(profiles: DataFrame) -> DataFrame:
    """(id, features): one row per distinct set, the one of the smallest id that has features."""
    held = profiles.where("features is not null")
    light = held.select("id", "s1", "s2")
    first = light.groupBy("s1", "s2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spare = cut(light.join(first, ["s1", "s2"]).where("id > first").select("id"))
    return within(held.select("id", "features"), spare, "id", "left_anti")


def _enough_shared(g: Fraction) -> Column:
    """Exact bound on ``shared``, the signatures two sets have in common, if all are finest.

    Of the features that two sets share, those in both enumerations are counted; the others lie
    behind the enumeration that ends first in the common order, so they are at most as many as
    that set has left.
    """
    n, d = g.numerator, g.denominator
    left = [f"({c} * {n} + {d - 1}) div {d} - 1" for c in ("sa", "sb")]  # size less what is enumerated
    needed = f"((sa + sb) * {n} + {n + d - 1}) div {n + d}"
    return F.expr(f"shared + greatest({left[0]}, {left[1]}) >= {needed}")


def meet(left: DataFrame, right: DataFrame, threshold: float, different) -> DataFrame:
    """(a, b): ids that share enough signatures and pass the exact bounds, a < b, each pair once.

    ``different(x, y)`` tells which ids of the left and right side are to be compared.
    """
    g = fraction(threshold)
    right = right.select(*[F.col(c).alias(f"y_{c}") for c in right.columns])
    shared = (left["token"] == right["y_token"]) & different(left["id"], right["y_id"])
    met = left.join(right, shared & _near_enough(left, right, g))
    pairs = met.groupBy(F.least("id", "y_id").alias("a"), F.greatest("id", "y_id").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max("size").cast("bigint").alias("sa"), F.max("y_size").cast("bigint").alias("sb")
    )
    if g < COARSE_FROM:
        pairs = pairs.where(_enough_shared(g))
    return cut(pairs.select("a", "b"))


def verified(candidates: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs whose full sets are similar enough; ``features``: (id, features)."""
    wanted = candidates.select("a").union(candidates.select("b")).distinct()
    features = within(features, wanted, "id", "left_semi")
    pairs = candidates.join(features.select(F.col("id").alias("a"), F.col("features").alias("fa")), "a").join(
        features.select(F.col("id").alias("b"), F.col("features").alias("fb")), "b"
    )
    return pairs.select("a", "b", "fa", "fb").mapInArrow(_overlaps(fraction(threshold)), "a bigint, b bigint")


def similar_sets(profiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b): ids of distinct sets with Jaccard similarity of at least ``threshold``, a < b.

    ``profiles`` is a stored table (id, s1, s2, features); ids are unique.
    """
    held = profiles.where("features is not null")
    order = profiles.sparkSession.sparkContext.broadcast(rarity_table(held))
    signed = store(signatures(distinct_sets(profiles), threshold, order), "signatures")
    order.destroy()
    candidates = meet(signed, signed, threshold, lambda x, y: x < y)
    return verified(candidates, held.select("id", "features"), threshold)
