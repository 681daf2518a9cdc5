"""The index: immutable segments under a versioned manifest, with tombstones.

Layout under the index directory::

    manifest.json                    the current version, replaced in one rename
    manifests/<version>.json         kept versions
    docs/generation=G/segment_no=K/  documents, Parquet, in scan order
    postings/generation=G/           (token_id, ordinal, weight, norm), sorted by token
    tombstones/generation=G/         (doc_id, ordinal) of hidden rows

One writer is assumed.  Readers pin a manifest version and never see later commits.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schema as S
from termloom.functions import vectors
from termloom.functions.encoders import Encoder, model_id_of
from termloom.plans.positions import grouped, staged
from termloom.sources.files import Files

FORMAT = "1.0"
MIB = 1024 * 1024
DEFAULT_SHARD_MB = 32


def segment_hashes(docs: DataFrame) -> DataFrame:
    """(segment_no, segment_id, num_docs, n_bytes): the identity of a segment is the SHA-256 of
    its rows' SHA-256 in order, so equal content has an equal id wherever it is stored."""
    pairs = F.concat_ws("\x1f", F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("\x1e", e["key"], e["value"])))
    vector = F.concat_ws("\x1f", F.concat_ws(",", F.col("token_ids").cast("array<string>")), F.concat_ws(",", F.col("weights").cast("array<string>")))
    row = F.sha2(F.concat_ws("\x1d", F.coalesce("doc_id", F.lit("")), F.coalesce("text", F.lit("")), pairs, vector), 256)
    rows = docs.select("segment_no", "ordinal", "n_bytes", row.alias("h"))
    # a segment is bounded by its target size, so its list of row hashes is too
    ordered = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]))
    return rows.groupBy("segment_no").agg(F.sha2(ordered, 256).alias("segment_id"), F.count(F.lit(1)).alias("num_docs"), F.sum("n_bytes").alias("n_bytes"))


class Snapshot:
    """Read access to one version of an index."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.files = Files(spark)

    def _read(self, kind: str, schema, *, strict: bool = False) -> DataFrame:
        paths = []
        for generation in self.manifest["generations"] if kind != "tombstones" else self.manifest["tombstones"]:
            path = f"{self.path}/{kind}/generation={generation}"
            if self.files.exists(path):
                paths.append(path)
            elif strict:
                raise FileNotFoundError(path)
            else:
                warnings.warn(f"missing part of the index: {path}", stacklevel=3)
        if not paths:
            return self.spark.createDataFrame([], schema)
        # one scan over all generations, however many commits there were
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths).select(*schema.names)

    def documents(self, *, with_text: bool = True, strict: bool = False) -> DataFrame:
        """All stored rows; without text the column stays, null, and is not read."""
        docs = self._read("docs", S.STORED, strict=strict)
        return docs if with_text else docs.withColumn("text", F.lit(None).cast("string"))

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", S.TOMBSTONE).distinct()

    def visible(self, rows: DataFrame) -> DataFrame:
        """Rows whose ordinal is not hidden."""
        return rows.join(self.tombstones().select("ordinal"), "ordinal", "left_anti") if self.manifest["tombstones"] else rows

    def live(self, *, with_text: bool = True) -> DataFrame:
        return self.visible(self.documents(with_text=with_text))

    def postings(self) -> DataFrame:
        return self._read("postings", S.POSTING)

    def lookup(self, doc_id: str) -> DataFrame:
        """The first live row of an id: the filter reaches the Parquet scan."""
        return self.visible(self.documents().where(F.col("doc_id") == doc_id)).orderBy("ordinal").limit(1)

    def lookup_many(self, wanted: DataFrame) -> DataFrame:
        """(pos, doc_id) -> the first live row of each id in order of ``pos``; columns are null for
        missing ids, repeats are kept."""
        asked = wanted.select("doc_id").distinct()
        hits = self.visible(self.documents().join(asked, "doc_id", "left_semi"))
        first = hits.groupBy("doc_id").agg(F.min("ordinal").alias("ordinal"))
        rows = hits.join(first.select("ordinal"), "ordinal", "left_semi")
        return wanted.select("pos", F.col("doc_id").alias("asked")).join(rows, F.col("asked") == F.col("doc_id"), "left").drop("asked").orderBy("pos")

    def stats(self) -> dict:
        live = self.live(with_text=False).agg(F.count(F.lit(1)).alias("n")).first()
        hidden = self.tombstones().agg(F.countDistinct("doc_id").alias("d")).first()
        total = sum(s["n_bytes"] for s in self.manifest["segments"])
        return {"num_docs": live.n, "num_shards": len(self.manifest["segments"]), "deleted_docs": hidden.d, "total_size_mb": total / MIB}


class SparseIndex:
    """Create or open an index of sparse vectors.

    ``add`` and ``add_batch`` gather documents, which become visible together with the next
    commit: on ``commit``, ``delete``, ``stats``, ``compact``, ``reshard`` or leaving the ``with``
    block.  Identifiers need not be unique.  Vectors are normalised on the way in (sorted, of
    repeated tokens the largest weight).  A deletion hides the rows present at that time; an
    identifier added again later is visible.
    """

    def __init__(self, spark: SparkSession, path: str, shard_size_mb: float | None = None) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self._pending: list[tuple] = []
        self._frames: list[DataFrame] = []
        if self.files.exists(f"{self.path}/manifest.json"):
            self.manifest = self.files.read_json(f"{self.path}/manifest.json")
            if shard_size_mb is not None:
                self.manifest["shard_size_mb"] = shard_size_mb
        else:
            self.files.mkdirs(self.path)
            self.manifest = {
                "version": FORMAT, "num_docs": 0, "num_shards": 0, "shard_size_mb": DEFAULT_SHARD_MB if shard_size_mb is None else shard_size_mb,
                "shard_hashes": [], "model_id": None, "commit": 0, "next_ordinal": 0, "generations": [], "tombstones": [], "segments": [],
            }
            self._publish({})

    # -- adding ----------------------------------------------------------------------------

    def add(self, doc: S.Document) -> None:
        self._pending.append(doc.row())

    def add_batch(self, docs: Iterable[S.Document] | DataFrame) -> None:
        if isinstance(docs, DataFrame):
            self._frames.append(self._conform(docs))
        else:
            self._pending.extend(d.row() for d in docs)

    def add_text(self, doc_id: str, text: str, metadata: dict | None, model: Encoder) -> None:
        self.add_texts([doc_id], [text], [metadata or {}], model)

    def add_texts(self, doc_ids: list, texts: list, metadatas: list, model: Encoder) -> None:
        if not len(doc_ids) == len(texts) == len(metadatas):
            raise ValueError("ids, texts and metadata differ in length")
        rows = [S.Document(i, t, m).row()[:3] for i, t, m in zip(doc_ids, texts, metadatas, strict=True)]
        self.add_encoded(self.spark.createDataFrame(rows, "doc_id string, text string, metadata map<string,string>"), model)

    def add_encoded(self, docs: DataFrame, model: Encoder) -> None:
        """Encode the text column of a DataFrame (doc_id, text, metadata) and add it."""
        if not self.manifest["model_id"]:
            self.manifest["model_id"] = model_id_of(model)
        self._frames.append(self._conform(model.encode(docs, "text")))

    def _conform(self, docs: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in docs.schema}
        for name in ("doc_id", "text", "token_ids", "weights"):
            if name not in have:
                raise ValueError(f"missing column {name}")
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in S.DOCUMENT]
        return docs.select(*columns)

    def _waiting(self) -> DataFrame | None:
        frames = list(self._frames)
        if self._pending:
            frames.append(self.spark.createDataFrame(self._pending, S.DOCUMENT))
        return reduce(DataFrame.unionByName, frames) if frames else None

    # -- committing ------------------------------------------------------------------------

    def commit(self) -> None:
        """Write what was added as new segments and publish a new version."""
        waiting = self._waiting()
        if waiting is None:
            return
        entry = self._write(waiting, self.manifest["shard_size_mb"])
        self._pending, self._frames = [], []
        if entry["segments"]:
            # segments are a set: content that is there already is not added again
            known = {s["segment_id"] for s in self.manifest["segments"]}
            repeated = [s["segment_no"] for s in entry["segments"] if s["segment_id"] in known]
            entry["segments"] = [s for s in entry["segments"] if s["segment_id"] not in known]
            if repeated:
                entry = self._drop_segments(entry, repeated)
        if entry["segments"]:
            self._publish(
                {
                    "next_ordinal": entry["next_ordinal"],
                    "generations": [*self.manifest["generations"], entry["generation"]],
                    "segments": [*self.manifest["segments"], *entry["segments"]],
                }
            )

    def _drop_segments(self, entry: dict, repeated: list[int]) -> dict:
        gone = self.spark.read.schema(S.STORED).option("basePath", f"{self.path}/docs/generation={entry['generation']}").parquet(f"{self.path}/docs/generation={entry['generation']}")
        if not entry["segments"]:
            for kind in ("docs", "postings"):
                self.files.delete(f"{self.path}/{kind}/generation={entry['generation']}")
            return entry
        again = gone.where(~F.col("segment_no").isin(repeated)).drop("segment_no")
        kept = self._write(again, self.manifest["shard_size_mb"], first=self.manifest["next_ordinal"])
        for kind in ("docs", "postings"):
            self.files.delete(f"{self.path}/{kind}/generation={entry['generation']}")
        return kept

    def _write(self, docs: DataFrame, shard_mb: float, first: int | None = None) -> dict:
        """Normalise, number, size, group into segments and write documents and postings."""
        generation = uuid.uuid4().hex
        first = self.manifest["next_ordinal"] if first is None else first
        target = max(1, int(shard_mb * MIB))
        columns = [f.name for f in S.DOCUMENT]
        rows = vectors.normalised(docs.select(*columns))
        rows = rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast(S.METADATA)))
        rows = rows.withColumn("norm", vectors.norm(F.col("weights"))).withColumn("n_bytes", S.logical_bytes())
        aside = f"{self.path}/staged-{generation}"
        placed, n = grouped(staged(rows, aside), target, group="segment_no", order="ordinal", start=first)
        names = [f.name for f in S.STORED]
        out = f"{self.path}/docs/generation={generation}"
        if n:
            # tasks hold ranges of the scan order, so a segment is a few sorted files
            placed.select(*names).sortWithinPartitions("segment_no", "ordinal").write.partitionBy("segment_no").parquet(out)
        self.files.delete(aside)
        segments = self._write_postings(out, generation) if n else []
        return {"generation": generation, "next_ordinal": first + n, "segments": segments}

    def _write_postings(self, docs: str, generation: str) -> list[dict]:
        """The postings of stored documents, sorted by token; returns their segments."""
        stored = self.spark.read.schema(S.STORED).option("basePath", docs).parquet(docs)
        pairs = stored.select("ordinal", "norm", F.explode(F.arrays_zip(F.col("token_ids").alias("t"), F.col("weights").alias("w"))).alias("e"))
        postings = pairs.select(F.col("e.t").alias("token_id"), "ordinal", F.col("e.w").alias("weight"), "norm")
        postings.repartitionByRange("token_id", "ordinal").sortWithinPartitions("token_id", "ordinal").write.parquet(f"{self.path}/postings/generation={generation}")
        return [r.asDict() | {"generation": generation} for r in segment_hashes(stored).orderBy("segment_no").collect()]

    def _publish(self, changes: dict) -> None:
        manifest = self.manifest | changes
        manifest["commit"] += 1
        manifest["num_shards"] = len(manifest["segments"])
        manifest["shard_hashes"] = [s["segment_id"] for s in manifest["segments"]]
        if changes:
            view = Snapshot(self.spark, self.path, manifest)
            manifest["num_docs"] = sum(s["num_docs"] for s in manifest["segments"]) - (view.tombstones().select("ordinal").distinct().count() if manifest["tombstones"] else 0)
        self.files.mkdirs(f"{self.path}/manifests")
        self.files.write_json(f"{self.path}/manifests/{manifest['commit']:09d}.json", manifest)
        self.files.write_json(f"{self.path}/manifest.json", manifest)
        self.manifest = manifest

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.path, dict(self.manifest))

    # -- deleting and maintenance ----------------------------------------------------------

    def delete(self, doc_id: str) -> bool:
        """Hide all rows of an id; False if none is live."""
        return self.delete_many(self.spark.createDataFrame([(doc_id,)], "doc_id string")) > 0

    def delete_many(self, ids: DataFrame) -> int:
        """Hide all live rows of the ids (column ``doc_id``); returns how many ids had any."""
        self.commit()
        live = self.snapshot().live(with_text=False).select("doc_id", "ordinal")
        hit = live.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        generation = uuid.uuid4().hex
        path = f"{self.path}/tombstones/generation={generation}"
        hit.orderBy("doc_id", "ordinal").write.parquet(path)
        found = self.spark.read.schema(S.TOMBSTONE).parquet(path).select("doc_id").distinct().count()
        if not found:
            self.files.delete(path)
            return 0
        self._publish({"tombstones": [*self.manifest["tombstones"], generation]})
        return found

    def _rewrite(self, shard_mb: float, keep: bool) -> dict:
        before = dict(self.manifest)
        old = {s["segment_id"] for s in before["segments"]}
        live = self.snapshot().live().orderBy("ordinal").select(*[f.name for f in S.DOCUMENT])
        entry = self._write(live, shard_mb, first=before["next_ordinal"])
        generations = [entry["generation"]] if entry["segments"] else []
        # the new version is complete before the old one is given up
        self._publish({"generations": generations, "tombstones": [], "segments": entry["segments"], "next_ordinal": entry["next_ordinal"], "shard_size_mb": shard_mb})
        if not keep:
            for kind, names in (("docs", before["generations"]), ("postings", before["generations"]), ("tombstones", before["tombstones"])):
                for name in names:
                    self.files.delete(f"{self.path}/{kind}/generation={name}")
        new = {s["segment_id"] for s in entry["segments"]}
        return {"old_shards": len(before["segments"]), "new_shards": len(new), "docs_written": sum(s["num_docs"] for s in entry["segments"]), "replaced": len(old - new)}

    def compact(self) -> None:
        """Rewrite the live rows in scan order and drop all tombstones."""
        self.commit()
        if self.manifest["segments"]:
            self._rewrite(self.manifest["shard_size_mb"], keep=False)

    def reshard(self, target_shard_size_mb: float = DEFAULT_SHARD_MB, keep_originals: bool = False) -> dict:
        """Rewrite the live rows into segments of another size.  With ``keep_originals`` the
        version before stays readable through :meth:`at`."""
        self.commit()
        if not self.manifest["segments"]:
            raise ValueError("No shards found")
        done = self._rewrite(target_shard_size_mb, keep_originals)
        return {k: done[k] for k in ("old_shards", "new_shards", "docs_written")}

    def at(self, commit: int) -> Snapshot:
        return Snapshot(self.spark, self.path, self.files.read_json(f"{self.path}/manifests/{commit:09d}.json"))

    def stats(self) -> dict:
        self.commit()
        return self.snapshot().stats()

    def __len__(self) -> int:
        return self.manifest["num_docs"]

    def __enter__(self) -> SparseIndex:
        return self

    def __exit__(self, *_: Any) -> None:
        self.commit()

    @staticmethod
    def retriever(spark: SparkSession, path: str, mode: str = "disk"):
        from termloom.operators.search import SparseRetriever

        return SparseRetriever(spark, path, mode)


def open_manifest(spark: SparkSession, path: str) -> dict:
    files = Files(spark)
    if not files.exists(f"{path.rstrip('/')}/manifest.json"):
        raise FileNotFoundError(f"Index not found: {path}")
    return files.read_json(f"{path.rstrip('/')}/manifest.json")
