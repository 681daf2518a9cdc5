"""Queries p1 to p10 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import formdup, history, mixing, neardup, packing, sentences, splitting, termcounts, termweights, topn
from termloom.plans.lineage import shared_dir


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scored = termweights.log_entropy(_table(spark, d, "index_docs"), spread="presence", local="raw", normalised=False)
    return termweights.top_terms(scored, 3).select(F.col("record").alias("ordinal"), "token_id")


def p1_log_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Every usable entry with its log-entropy score."""
    scored = termweights.log_entropy(_table(spark, d, "index_docs"))
    return scored.select(F.col("record").alias("ordinal"), "token_id", "records", F.round("score", 6).alias("score"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    marked = termcounts.term_frequencies(_table(spark, d, "index_docs"))
    return marked.where("mark is not null").select("token_id", "mark")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.term_frequencies(_table(spark, d, "index_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_pairs(_table(spark, d, "index_docs"), shingle=3, threshold=0.6)
    return pairs.select(F.col("a").alias("ordinal_a"), F.col("b").alias("ordinal_b"))


def p3_near_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_classes(_table(spark, d, "index_docs")).withColumnRenamed("id", "ordinal")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    hits = _table(spark, d, "search_results").where("score > 0")
    return topn.top_n(hits, 10).select("query_id", "rank_no", "doc_id")


def p4_top_segments(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_table(spark, d, "search_results"), 3, item="segment_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    copies = formdup.form_copies(_table(spark, d, "index_docs"))
    return copies.select(F.col("kept").alias("kept_ordinal"), F.col("copy").alias("copy_ordinal"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formdup.collapse(_table(spark, d, "index_docs").select("ordinal", "doc_id", "text")).select("ordinal", "doc_id", "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(_table(spark, d, "index_docs"))
    return splitting.forced_texts(pieces).withColumnRenamed("id", "ordinal")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, d, "index_docs")).withColumnRenamed("id", "ordinal")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    known = history.History.create(spark, path, _table(spark, d, "index_docs"), "ordinal", "doc_id", "text", shingle=3, threshold=0.6)
    return known.check(_table(spark, d, "incoming_docs"))[0]


def p7_batches(spark: SparkSession, d: str) -> DataFrame:
    """Like ``p7_found``, each batch checked against the history with all batches before it."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    known = history.History.create(spark, path, _table(spark, d, "index_docs"), "ordinal", "doc_id", "text", shingle=3, threshold=0.6)
    incoming, found = _table(spark, d, "incoming_docs"), []
    for r in incoming.select("batch_no").distinct().orderBy("batch_no").collect():
        reasons, batch = known.check(incoming.where(F.col("batch_no").eqNullSafe(F.lit(r.batch_no))))
        known.absorb(reasons, batch)
        found.append(reasons)
    return reduce(DataFrame.union, found, spark.createDataFrame([], "row_no bigint, reason string"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), _table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets")).chosen()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets")).shares()


def p9_whole_shares(spark: SparkSession, d: str) -> DataFrame:
    """Like ``p9_shares``, for a mixture as large as all target sources together: repeats bind."""
    mix = mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))
    mix.aim(sum(mix.available.values()))
    return mix.shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    units = sentences.sentences(_table(spark, d, "documents"))
    return units.select(F.col("id").alias("doc_id"), "start_pos", "end_pos")


QUERIES = {
    "p1_found": p1_found,
    "p1_log_entropy": p1_log_entropy,
    "p2_found": p2_found,
    "p2_frequencies": p2_frequencies,
    "p3_found": p3_found,
    "p3_near_groups": p3_near_groups,
    "p4_found": p4_found,
    "p4_top_segments": p4_top_segments,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_batches": p7_batches,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_whole_shares": p9_whole_shares,
    "p10_found": p10_found,
}

_USABLE = """
entries AS (
  SELECT ordinal, token_id, max(weight) AS weight FROM (
    SELECT ordinal, unnest(token_ids) AS token_id, unnest(weights) AS weight FROM index_docs) e
  WHERE NOT isnan(weight) AND weight > CAST(0.001 AS FLOAT) GROUP BY ordinal, token_id)"""

ORACLES = {
    "p1_found": f"""
WITH {_USABLE},
terms AS (SELECT token_id, count(*) AS n FROM entries GROUP BY token_id),
scored AS (
  SELECT ordinal, token_id, round(CAST(weight AS DOUBLE) * ln(CAST((SELECT count(*) FROM index_docs) AS DOUBLE) / n), 6) AS score
  FROM entries JOIN terms USING (token_id))
SELECT ordinal, token_id FROM (
  SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, token_id) AS r FROM scored) WHERE r <= 3""",
    "p1_log_entropy": f"""
WITH {_USABLE},
totals AS (SELECT token_id, count(*) AS n, sum(CAST(weight AS DOUBLE)) AS total FROM entries GROUP BY token_id),
spread AS (
  SELECT token_id, any_value(n) AS n, 1 + sum(weight / total * ln(weight / total)) / ln((SELECT count(*) FROM index_docs)) AS g
  FROM entries JOIN totals USING (token_id) GROUP BY token_id),
scored AS (
  SELECT ordinal, token_id, n AS records, round(ln(1 + CAST(weight AS DOUBLE)) * g, 6) AS score FROM entries JOIN spread USING (token_id))
SELECT ordinal, token_id, records, score FROM scored""",
    "p2_found": """
WITH n AS (SELECT token_id, count(DISTINCT ordinal) AS n FROM (SELECT ordinal, unnest(token_ids) AS token_id FROM index_docs) GROUP BY token_id)
SELECT token_id, CASE WHEN n <= 2 THEN 'rare' ELSE 'common' END AS mark FROM n
WHERE n <= 2 OR n * 100 > 15 * (SELECT count(*) FROM index_docs)""",
    "p2_frequencies": """
WITH n AS (
  SELECT token_id, count(*) AS occurrences, count(DISTINCT ordinal) AS records, max(ordinal) AS last_record
  FROM (SELECT ordinal, unnest(token_ids) AS token_id FROM index_docs) GROUP BY token_id)
SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > 15 * (SELECT count(*) FROM index_docs) THEN 'common' END AS mark FROM n""",
    "p4_found": """
WITH best AS (
  SELECT query_id, doc_id, max(score) AS score FROM search_results
  WHERE score IS NOT NULL AND NOT isnan(score) AND score > 0 AND doc_id IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id, doc_id)
SELECT query_id, CAST(r AS INT) AS rank_no, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM best) WHERE r <= 10""",
    "p4_top_segments": """
WITH best AS (
  SELECT query_id, segment_id, max(score) AS score FROM search_results
  WHERE score IS NOT NULL AND NOT isnan(score) AND segment_id IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id, segment_id)
SELECT query_id, CAST(r AS INT) AS rank_no, segment_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS r FROM best) WHERE r <= 3""",
    "p6_found": r"""
WITH long AS (
  SELECT ordinal, regexp_extract_all(text,
    '[^ \t\n\r\x0B\f\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？।؟…]+') AS runs
  FROM index_docs WHERE length(text) > 2000)
SELECT ordinal, CAST(coalesce(list_max(list_transform(runs, lambda x: length(x))), 0) > 2000 AS INT) AS forced FROM long""",
}
