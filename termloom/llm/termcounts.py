"""Frequency of every distinct term by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a task hands its counters on when it holds this many terms
FLUSH_TERMS = 1_000_000

_PARTIAL = "token_id bigint, occurrences bigint, records bigint, last_record bigint"


class LastSeenCounters:
    """Per term: occurrences, records and the last record seen.

    Records arrive one after the other; an entry opens a new record of its term exactly when the
    term's last-seen record is another one, so no set of records is ever kept.  The state is four
    parallel arrays sorted by term.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.terms = self.occurrences = self.records = self.last = np.empty(0, dtype=np.int64)
        self.last_row = np.empty(0, dtype=np.int64)

    def add(self, terms: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Entries in record order; ``rows`` number the records, ``ids`` name them."""
        if not len(terms):
            return
        order = np.argsort(terms, kind="stable")
        terms, rows, ids = terms[order], rows[order], ids[order]
        first = np.empty(len(terms), dtype=bool)
        first[0] = True
        np.not_equal(terms[1:], terms[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(terms)) - 1
        opens = first.copy()
        opens[1:] |= rows[1:] != rows[:-1]
        fresh, seen_before = terms[starts], np.searchsorted(self.terms, terms[starts])
        known = seen_before < len(self.terms)
        known[known] = self.terms[seen_before[known]] == fresh[known]
        # the first entry of a known term opens a record only if its last-seen record differs
        again = starts[known][self.last_row[seen_before[known]] == rows[starts[known]]]
        opens[again] = False
        n, m = np.diff(np.append(starts, len(terms))), np.add.reduceat(opens.astype(np.int64), starts)
        at = seen_before[known]
        self.occurrences[at] += n[known]
        self.records[at] += m[known]
        self.last_row[at] = rows[ends[known]]
        self.last[at] = np.maximum(self.last[at], np.maximum.reduceat(ids, starts)[known])
        new = ~known
        merged = np.argsort(np.concatenate([self.terms, fresh[new]]), kind="stable")
        top = np.maximum.reduceat(ids, starts)
        for name, extra in (("terms", fresh), ("occurrences", n), ("records", m), ("last_row", rows[ends]), ("last", top)):
            setattr(self, name, np.concatenate([getattr(self, name), extra[new]])[merged])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.terms, self.occurrences, self.records, self.last)],
            names=["token_id", "occurrences", "records", "last_record"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, row = LastSeenCounters(), 0
    for batch in batches:
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = lists.flatten()
        rows = np.repeat(np.arange(row, row + len(ids), dtype=np.int64), lengths)
        names = np.repeat(ids, lengths)
        row += len(ids)
        if values.null_count:
            keep = values.is_valid().to_numpy(zero_copy_only=False)
            rows, names, values = rows[keep], names[keep], values.drop_null()
        state.add(values.to_numpy(zero_copy_only=False), rows, names)
        if len(state.terms) > FLUSH_TERMS:  # between records, so partial counters add up exactly
            yield state.batch()
            state.clear()
    if len(state.terms):
        yield state.batch()


def term_frequencies(
    docs: DataFrame,
    id_col: str = "ordinal",
    tokens: str = "token_ids",
    *,
    rare_records: int = 2,
    common_share: tuple[int, int] = (15, 100),
) -> DataFrame:
    """(token_id, occurrences, records, last_record, mark) of every distinct term.

    ``mark`` is ``rare`` for terms in at most ``rare_records`` records, else ``common`` for terms
    in more than ``common_share`` (numerator, denominator) of all records, else null.

    Each task runs last-seen counters over its records in reading order; the partial counters,
    one row per term and task, are hash-partitioned by term and added, so a term that occurs in
    every record costs one row per task.  Every row is a record, repeated rows too.  Null arrays,
    empty arrays and null tokens count nothing; a null id counts as a record but never as
    ``last_record``.  An empty table gives no rows; other columns are ignored.
    """
    n = docs.count()
    partial = docs.select(F.col(id_col).cast("bigint").alias("record"), F.col(tokens).cast("array<bigint>").alias("tokens")).mapInArrow(_count, _PARTIAL)
    part, whole = common_share
    counted = partial.groupBy("token_id").agg(
        F.sum("occurrences").alias("occurrences"),
        F.sum("records").alias("records"),
        F.max("last_record").alias("last_record"),
    )
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * whole > F.lit(part * n), "common")
    none = F.lit(int(np.iinfo(np.int64).min))
    return counted.withColumn("last_record", F.when(F.col("last_record") != none, F.col("last_record"))).withColumn("mark", mark)
