"""Deduplicating new batches against all history: multi-key sorted-neighbourhood runs.

The history is a set of immutable runs in shared storage.  A run holds, per accepted record, its
keys (identifier, form, fields, shingle set), its shingle features, and its near-duplicate
signatures sorted by signature.  A batch is profiled and signed once, its keys are merged with the
runs' keys by sorted merge joins, and only windows around the batch's records are compared: the
window of a record under a key is the run of records with an equal key.  Near-duplicate keys are
the signatures of :mod:`termloom.llm.partenum`, under an order frozen with the history, so windows
lose no similar pair; texts of the history are never read again.  What a batch was signed with is
what its accepted records are stored with.

Runs are merged as in a log-structured tree: whenever there are more than ``MOST_RUNS``, the newest
ones that together outweigh the one before them become one sorted run, so every record is written
again a logarithmic number of times.  ``compact`` merges all runs under a fresh order.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import partenum as pe
from termloom.llm import profiles as pf
from termloom.plans.lineage import cut, store
from termloom.sources.files import Files

#: reasons in order of precedence
REASONS = {1: "doc_id", 2: "copy", 3: "near"}
_FIRST = -(1 << 62)
_RUN = 1 << 44
#: more runs than these are merged
MOST_RUNS = 8
_KEYS = {"i": ("k1", "k2", 1), "l": ("l1", "l2", 2), "m": ("m1", "m2", 2), "s": ("s1", "s2", 3)}


def _keys(profiles: DataFrame) -> DataFrame:
    """(kind, x1, x2, id): the keys under which a record is filed."""
    structs = [F.struct(F.lit(kind).alias("kind"), F.col(a).alias("x1"), F.col(b).alias("x2")) for kind, (a, b, _) in _KEYS.items()]
    return profiles.select("id", F.explode(F.array(*structs)).alias("k")).select("k.kind", "k.x1", "k.x2", "id").where("x1 is not null")


@dataclass(frozen=True)
class Batch:
    """A batch as :meth:`History.check` saw it: its profiles, and its distinct sets' signatures."""

    profiles: DataFrame
    signatures: DataFrame


class History:
    """Accepted records as sorted runs under a path in shared storage."""

    def __init__(self, spark: SparkSession, path: str, shingle: int = 5, threshold: float = 0.8) -> None:
        self.spark, self.path, self.shingle, self.threshold = spark, path.rstrip("/"), shingle, threshold
        self.runs: list[str] = []
        self.next_run = 0
        self.order: Broadcast | None = None  # counters that order the features, frozen until compact()
        self.order_file = ""

    # -- storage ---------------------------------------------------------------------------

    def _profiles(self, runs: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(pf.PROFILE_SCHEMA).parquet(*[f"{r}/profiles" for r in runs or self.runs])

    def _signatures(self, runs: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(pe.TOKEN_SCHEMA).parquet(*[f"{r}/signatures" for r in runs or self.runs])

    def _profile(self, rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(pf.profiler(self.shingle), pf.PROFILE_SCHEMA)

    def _signed(self, profiles: DataFrame) -> DataFrame:
        return pe.signatures(pe.distinct_sets(profiles), self.threshold, self.order, all_features=True)

    def _new_run(self) -> tuple[str, int]:
        run, first = f"{self.path}/run-{self.next_run:06d}", _FIRST + self.next_run * _RUN
        self.next_run += 1
        return run, first

    def _publish(self, runs: list[str]) -> None:
        """Name the runs, and the file with their order, in one rename; then give up other runs."""
        files = Files(self.spark)
        state = {"runs": [r.rsplit("/", 1)[1] for r in runs], "next_run": self.next_run, "order": self.order_file, "shingle": self.shingle, "threshold": self.threshold}
        files.write_json(f"{self.path}/history.json", state)
        gone, self.runs = [r for r in self.runs if r not in runs], runs
        for run in gone:
            files.delete(run)

    def _freeze(self, run: str) -> None:
        """Order the features by their counts in a run."""
        table = pe.rarity_table(self._profiles([run]).where("features is not null"))
        self.order_file = f"order-{run.rsplit('-', 1)[1]}"
        Files(self.spark).write_bytes(f"{self.path}/{self.order_file}", zlib.compress(table, 1))
        self._take_order(table)

    def _take_order(self, table: bytes) -> None:
        """Broadcast an order, once for all batches that are signed under it."""
        if self.order is not None:
            self.order.destroy()
        self.order = self.spark.sparkContext.broadcast(table)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history last published under ``path``."""
        state = Files(spark).read_json(f"{path.rstrip('/')}/history.json")
        self = cls(spark, path, state["shingle"], state["threshold"])
        self.runs, self.next_run = [f"{self.path}/{r}" for r in state["runs"]], state["next_run"]
        self.order_file = state["order"]
        self._take_order(zlib.decompress(spark.read.format("binaryFile").load(f"{self.path}/{self.order_file}").first().content))
        return self

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, id_col: str, doc_id: str, text: str, *, shingle: int = 5, threshold: float = 0.8) -> History:
        """A history of one run that holds all of ``docs``; ``id_col`` from 0 up to 2**44."""
        self = cls(spark, path, shingle, threshold)
        run, first = self._new_run()
        rows = docs.select((F.col(id_col).cast("bigint") + F.lit(first)).alias("id"), F.col(doc_id).cast("string"), F.col(text).cast("string"))
        self._profile(rows).write.parquet(f"{run}/profiles")
        self._freeze(run)
        self._signed(self._profiles([run])).sortWithinPartitions("token").write.parquet(f"{run}/signatures")
        self._publish([run])
        return self

    # -- checking --------------------------------------------------------------------------

    def _near(self, batch: Batch) -> DataFrame:
        """(a, b): similar distinct sets, b in the batch, a in the history (negative) or before b."""
        with pe.meeting(self._signatures(), batch.signatures) as old:
            candidates = pe.meet(batch.signatures, batch.signatures.unionByName(old), self.threshold, lambda x, y: (y < x))
        features = batch.profiles.union(self._profiles()).where("features is not null").select("id", "features")
        return pe.verified(candidates, features, self.threshold)

    def _windows(self, batch: Batch) -> DataFrame:
        """(kind, x1, x2, id, known, code): every batch record under each of its keys; ``known``
        tells that the window holds a record of the history."""
        own = _keys(batch.profiles)
        asked = own.select("kind", "x1", "x2").distinct()
        known = _keys(self._profiles()).join(asked, ["kind", "x1", "x2"], "left_semi").select("kind", "x1", "x2").distinct()
        keyed = own.join(known.withColumn("known", F.lit(True)), ["kind", "x1", "x2"], "left")
        # a pair of similar sets is a window of its own, with the records of both sets
        ends = self._near(batch).select(F.col("a").alias("x1"), F.col("b").alias("x2"), F.explode(F.array("b", "a")).alias("id")).where("id >= 0")
        digests = batch.profiles.select("s1", "s2", "id")
        of_set = digests.join(ends, "id").select("s1", "s2", "x1", "x2")
        near = digests.join(of_set, ["s1", "s2"]).select(F.lit("p").alias("kind"), "x1", "x2", "id", (F.col("x1") < 0).alias("known"))
        code = F.lit(3)
        for kind, (_, _, c) in _KEYS.items():
            code = F.when(F.col("kind") == kind, c).otherwise(code)
        return keyed.select("kind", "x1", "x2", "id", F.coalesce("known", F.lit(False)).alias("known")).union(near).withColumn("code", code)

    def _accepted(self, windows: DataFrame) -> DataFrame:
        """(id) of the records without a known one in any window that are accepted in order and
        that share a window with other such records.

        A record is refused when an accepted one precedes it in a window, and accepted when no
        undecided one does.  Every round decides at least the first undecided record of each
        window chain; a window, however large, needs one row per aggregation and task.
        """
        open_ids = windows.groupBy("id").agg(F.max("known").alias("k")).where("not k").select("id")
        keyed = windows.join(open_ids, "id", "left_semi").select("kind", "x1", "x2", "id")
        crowded = keyed.groupBy("kind", "x1", "x2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        state = cut(keyed.join(crowded, ["kind", "x1", "x2"]).withColumn("accepted", F.lit(None).cast("boolean")))
        while state.where("accepted is null").limit(1).count():
            firsts = state.groupBy("kind", "x1", "x2").agg(
                F.min(F.when(F.col("accepted"), F.col("id"))).alias("first_accepted"),
                F.min(F.when(F.col("accepted").isNull(), F.col("id"))).alias("first_open"),
            )
            seen = state.where("accepted is null").join(firsts, ["kind", "x1", "x2"])
            decided = seen.groupBy("id").agg(
                F.max(F.coalesce(F.col("first_accepted") < F.col("id"), F.lit(False))).alias("refused"),
                F.min(F.col("first_open") == F.col("id")).alias("first"),
            )
            verdict = decided.where("refused or first").select("id", (~F.col("refused")).alias("verdict"))
            state = cut(state.join(verdict, "id", "left").select("kind", "x1", "x2", "id", F.coalesce("accepted", "verdict").alias("accepted")))
        return state.where("accepted").select("id").distinct()

    def _reasons(self, batch: Batch) -> DataFrame:
        windows = cut(self._windows(batch))
        accepted = self._accepted(windows)
        before = windows.join(accepted, "id", "left_semi").groupBy("kind", "x1", "x2").agg(F.min("id").alias("first"))
        hits = windows.join(before, ["kind", "x1", "x2"], "left").where("known or first < id")
        code = hits.groupBy("id").agg(F.min("code").alias("code"))
        reason = F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("code"))
        return cut(code.select(F.col("id").alias("row_no"), reason.alias("reason")))

    def check(self, batch: DataFrame, id_col: str = "row_no", doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Batch]:
        """((row_no, reason) of the records that are already known, the batch for :meth:`absorb`).

        Records count in order of ``id_col`` (from 0).  Known are the history and the batch's
        earlier records that are not known themselves.  ``reason`` is the first that holds:
        ``doc_id``, the identifier equals a known one apart from letter case and blanks at the
        edges; ``copy``, the text is the same in form; ``near``, the shingle sets are similar.

        Null identifiers match nothing, blank ones match each other.  Null, empty and letterless
        texts are neither copies nor near.  Records with a null ``id_col`` are left out.  Empty
        batches and histories give empty results; other columns are ignored.
        """
        rows = batch.select(F.col(id_col).cast("bigint").alias("id"), F.col(doc_id).cast("string"), F.col(text).cast("string"))
        profiles = store(self._profile(rows), "batch")
        seen = Batch(profiles, store(self._signed(profiles), "signatures"))
        return self._reasons(seen), seen

    # -- growth ----------------------------------------------------------------------------

    def absorb(self, known: DataFrame, batch: Batch) -> None:
        """Append the batch's records that are not ``known`` as a new sorted run."""
        run, first = self._new_run()
        fresh = batch.profiles.join(known.select(F.col("row_no").alias("id")), "id", "left_anti")
        # a set's features and signatures may have been written with a record that was refused;
        # of the accepted records no two have one set
        sets = batch.profiles.where("features is not null").groupBy("s1", "s2").agg(F.min("id").alias("owner"), F.first("features").alias("held"))
        light = fresh.drop("features").join(sets.select("s1", "s2", F.col("held").alias("features")), ["s1", "s2"], "left")
        light.withColumn("id", F.col("id") + F.lit(first)).select(*batch.profiles.columns).hint("rebalance").write.parquet(f"{run}/profiles")
        owners = fresh.select("id", "s1", "s2").join(sets.drop("held"), ["s1", "s2"]).select(F.col("id").alias("heir"), "owner")
        signed = batch.signatures.join(owners, F.col("id") == F.col("owner")).withColumn("id", F.col("heir") + F.lit(first))
        signed.select(*batch.signatures.columns).hint("rebalance", "token").sortWithinPartitions("token").write.parquet(f"{run}/signatures")
        self._publish([*self.runs, run])
        self._merge()

    def _merge(self) -> None:
        """If there are too many runs, merge the newest that together outweigh the one before."""
        if len(self.runs) <= MOST_RUNS:
            return
        files = Files(self.spark)
        sizes = [files.size(r) for r in self.runs]
        at = next((k for k in range(len(sizes) - 1) if sum(sizes[k + 1 :]) >= sizes[k]), len(sizes) - 2)
        run, _ = self._new_run()
        self._profiles(self.runs[at:]).hint("rebalance").write.parquet(f"{run}/profiles")
        self._signatures(self.runs[at:]).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{run}/signatures")
        self._publish([*self.runs[:at], run])

    def compact(self) -> None:
        """Merge all runs into one, its signatures in sorted key ranges under a fresh order."""
        run, former = self._new_run()[0], self.order_file
        self._profiles().write.parquet(f"{run}/profiles")
        self._freeze(run)
        self._signed(self._profiles([run])).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{run}/signatures")
        self._publish([run])
        Files(self.spark).delete(f"{self.path}/{former}")
