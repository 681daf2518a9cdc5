"""Searching an index: single queries, batches, texts, and lookups by id."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.encoders import Encoder, model_id_of
from termloom.operators import scoring, topk
from termloom.schema import SearchResult
from termloom.sources.store import Snapshot, open_manifest

#: queries with up to this many different tokens push them into the scan of the postings
PUSHED_TOKENS = 1_000


class SparseRetriever:
    """A reader pinned to the version of the index it was opened on.

    ``mode='memory'`` keeps the live documents and postings cached on the executors.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "disk") -> None:
        if mode not in ("disk", "memory"):
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self.snapshot = Snapshot(spark, self.path, open_manifest(spark, path))
        self._postings, self._docs = self.snapshot.postings(), self.snapshot.live()
        if mode == "memory":
            self._postings, self._docs = self._postings.persist(), self._docs.persist()
            self._postings.count(), self._docs.count()

    def close(self) -> None:
        if self.mode == "memory":
            self._postings.unpersist()
            self._docs.unpersist()

    # -- batches ---------------------------------------------------------------------------

    def search_batch(self, queries: DataFrame, top_k: int = 10, *, return_text: bool = False, metric: str = "cosine") -> DataFrame:
        """(query_id, rank, doc_id, score, metadata, text) for queries (query_id, token_id, weight).

        Scores are summed per (query, ordinal) and cut to the best, ties included, before any
        document is touched; only those rows fetch their id, metadata and, on demand, text.
        Order: score rounded to six digits, then doc_id, then place in the index.
        """
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        terms = scoring.query_terms(queries)
        postings = self._postings
        tokens = [r.token_id for r in terms.select("token_id").distinct().limit(PUSHED_TOKENS + 1).collect()]
        if len(tokens) <= PUSHED_TOKENS:
            postings = postings.where(F.col("token_id").isin(tokens))
        scored = self.snapshot.visible(scoring.score(postings, terms, metric=metric))
        best = topk.candidates(scored, top_k)
        columns = ["ordinal", "doc_id", "metadata", *(["text"] if return_text else [])]
        found = best.join(self._docs.select(*columns), "ordinal")
        if not return_text:
            found = found.withColumn("text", F.lit(None).cast("string"))
        keyed = found.withColumn("key", F.struct("doc_id", "ordinal"))
        return topk.top_k(keyed, top_k, "key").select("query_id", "rank", "doc_id", "score", "metadata", "text")

    def search_texts(self, queries: DataFrame, model: Encoder, top_k: int = 10, *, return_text: bool = False) -> DataFrame:
        """Like :meth:`search_batch` for texts (query_id, text)."""
        self._check_model(model)
        encoded = model.encode(queries.select("query_id", "text"), "text")
        pairs = encoded.select("query_id", F.explode(F.arrays_zip(F.col("token_ids").alias("t"), F.col("weights").alias("w"))).alias("e"))
        terms = pairs.select("query_id", F.col("e.t").alias("token_id"), F.col("e.w").alias("weight"))
        return self.search_batch(terms, top_k, return_text=return_text)

    # -- single queries --------------------------------------------------------------------

    def search(
        self, query_tokens: Sequence[int], query_weights: Sequence[float], top_k: int = 10, return_text: bool = False, num_workers: int = 1, *, metric: str = "cosine"
    ) -> list[SearchResult]:
        """The ``top_k`` best documents with a positive score.  ``num_workers`` is accepted and
        left to Spark."""
        if len(query_tokens) != len(query_weights):
            raise ValueError("query_tokens and query_weights differ in length")
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        if not self.snapshot.manifest["segments"] or not len(query_tokens):
            return []
        rows = [(0, int(t), float(w)) for t, w in zip(query_tokens, query_weights, strict=True)]
        queries = self.spark.createDataFrame(rows, "query_id bigint, token_id bigint, weight float")
        return self._results(self.search_batch(queries, top_k, return_text=return_text, metric=metric))

    def search_text(self, query: str, model: Encoder, top_k: int = 10, return_text: bool = False, num_workers: int = 1) -> list[SearchResult]:
        queries = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
        return self._results(self.search_texts(queries, model, top_k, return_text=return_text))

    @staticmethod
    def _results(found: DataFrame) -> list[SearchResult]:
        return [SearchResult(r.doc_id, r.score, dict(r.metadata or {}), r.text) for r in found.orderBy("rank").collect()]

    def _check_model(self, model: Encoder) -> None:
        built, own = self.snapshot.manifest.get("model_id"), model_id_of(model)
        if built and "unknown" not in (built, own) and built != own:
            warnings.warn(f"the index was built with {built!r}, the query is encoded with {own!r}", stacklevel=3)

    # -- lookups ---------------------------------------------------------------------------

    def get(self, doc_id: str) -> dict | None:
        row = self.snapshot.lookup(doc_id).first()
        return self._document(row) if row else None

    def get_batch(self, doc_ids: Sequence[str]) -> list[dict | None]:
        if not doc_ids:
            return []
        wanted = self.spark.createDataFrame(list(enumerate(doc_ids)), "pos bigint, doc_id string")
        return [self._document(r) if r.ordinal is not None else None for r in self.snapshot.lookup_many(wanted).collect()]

    @staticmethod
    def _document(row) -> dict:
        return {k: row[k] for k in ("doc_id", "text", "metadata", "token_ids", "weights")}
