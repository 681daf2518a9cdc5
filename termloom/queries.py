"""The engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import display, vectors
from termloom.functions.encoders import LexicalEncoder, UdfEncoder
from termloom.operators import scoring, topk
from termloom.plans.lineage import shared_dir
from termloom.plans.positions import greedy_groups, with_positions
from termloom.schema import logical_bytes
from termloom.sources import ingest
from termloom.sources.store import SparseIndex

SHARD_BYTES = 100_000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dead(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "tombstones").select(F.trim("doc_id").alias("doc_id")).where("doc_id != ''").distinct()


def _live(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "index_docs").join(_dead(spark, d), "doc_id", "left_anti")


# -- scans -----------------------------------------------------------------------------------


def scan_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text", "lang", "source")


def scan_docs_no_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source")


def scan_tombstones(spark, d):
    return _dead(spark, d)


# -- vectors ---------------------------------------------------------------------------------


def _dense(spark, d, threshold=vectors.THRESHOLD):
    return vectors.sparsify_rows(_t(spark, d, "embeddings"), "vec_id", "embedding", threshold)


def dense_sparsify(spark, d):
    return _dense(spark, d)


def dense_sparsify_threshold(spark, d):
    return _dense(spark, d, 0.2)


def vector_nnz(spark, d):
    docs = _t(spark, d, "embeddings")
    counts = _dense(spark, d).groupBy("vec_id").agg(F.count(F.lit(1)).alias("nnz"))
    return docs.select("vec_id").join(counts, "vec_id", "left").select("vec_id", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))


def vector_norm(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def stored_norm(spark, d):
    docs = vectors.normalised(_t(spark, d, "index_docs").select("ordinal", "token_ids", "weights"))
    return docs.select("ordinal", F.size("token_ids").cast("bigint").alias("nnz"), F.round(vectors.norm(F.col("weights")), 6).alias("norm"))


def dedupe_max_weight(spark, d):
    rows = vectors.postings(_t(spark, d, "index_docs"), "ordinal")
    return rows.select("ordinal", "token_id", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def sorted_vector(spark, d):
    docs = vectors.normalised(_t(spark, d, "index_docs").select("ordinal", "token_ids", "weights"))
    return docs.select("ordinal", F.posexplode("token_ids").alias("position", "token_id")).withColumn("position", F.col("position").cast("bigint"))


def duplicate_tokens(spark, d):
    return _t(spark, d, "index_docs").where(vectors.has_duplicates(F.col("token_ids"))).select("ordinal")


def lexical_postings(spark, d):
    rows = LexicalEncoder.postings(_t(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", "token_id", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def lexical_doc_norm(spark, d):
    encoded = LexicalEncoder().encode(_t(spark, d, "documents").select("doc_id", "text"), "text")
    return encoded.select("doc_id", F.size("token_ids").cast("bigint").alias("nnz"), F.round(vectors.norm(F.col("weights")), 5).alias("norm"))


# -- search ----------------------------------------------------------------------------------


def _dense_search(spark, d, queries, metric="cosine"):
    docs = vectors.extract_sparse(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    postings = vectors.postings_with_norm(docs, "vec_id")
    terms = scoring.query_terms(queries.withColumnRenamed("vec_id", "query_id"))
    return scoring.score(postings, terms, "vec_id", metric=metric)


def dense_topk(spark, d):
    scored = _dense_search(spark, d, _dense(spark, d).where("vec_id = 0"))
    return topk.top_k(scored, 10, "vec_id").select("rank", "vec_id", "score")


def dense_topk_dot(spark, d):
    scored = _dense_search(spark, d, _dense(spark, d).where("vec_id = 0"), "dot")
    return topk.top_k(scored, 10, "vec_id").select("rank", "vec_id", "score")


def dense_topk_batch(spark, d):
    scored = _dense_search(spark, d, _dense(spark, d).where("vec_id % 100 = 0"))
    return topk.top_k(scored, 10, "vec_id").select("query_id", "rank", "vec_id", "score")


def dense_positive_count(spark, d):
    scored = _dense_search(spark, d, _dense(spark, d).where("vec_id % 100 = 0"))
    return scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_positive"))


def dense_pair_scores(spark, d):
    """Scores of vectors that stand side by side: every vector with the next one."""
    docs = vectors.extract_sparse(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    nxt = docs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("token_ids").alias("qt"), F.col("weights").alias("qw"))
    both = docs.join(nxt, "vec_id")
    cosine, dot = (scoring.score_pair("token_ids", "weights", "qt", "qw", metric=m) for m in ("cosine", "dot"))
    return both.select("vec_id", F.round(cosine, 6).alias("cosine"), F.round(dot, 6).alias("dot"))


def _index_postings(docs):
    return vectors.postings_with_norm(vectors.normalised(docs.select("ordinal", "token_ids", "weights")), "ordinal")


def _query_vectors(spark, d, where):
    asked = _t(spark, d, "search_queries").where(where)
    pairs = asked.select("query_id", F.explode(F.arrays_zip(F.col("token_ids").alias("t"), F.col("weights").alias("w"))).alias("e"))
    return pairs.select("query_id", F.col("e.t").alias("token_id"), F.col("e.w").alias("weight"))


def vector_search(spark, d):
    scored = scoring.score(_index_postings(_t(spark, d, "index_docs")), scoring.query_terms(_query_vectors(spark, d, "query_id % 100 = 0")))
    return topk.top_k(scored, 10, "ordinal").select("query_id", "rank", "ordinal", "score")


def search_with_tombstones(spark, d):
    scored = scoring.score(_index_postings(_live(spark, d)), scoring.query_terms(_query_vectors(spark, d, "query_id % 100 = 0")))
    return topk.top_k(scored, 10, "ordinal").select("query_id", "rank", "ordinal", "score")


def search_own_k(spark, d):
    """Each query's own ``top_k``: null stands for 10, below 1 asks for nothing."""
    scored = scoring.score(_index_postings(_t(spark, d, "index_docs")), scoring.query_terms(_query_vectors(spark, d, "query_id % 100 = 0")))
    limits = _t(spark, d, "search_queries").select("query_id", F.coalesce("top_k", F.lit(10)).alias("k"))
    most = limits.agg(F.max("k")).first()[0] or 0
    return topk.top_k(scored.join(limits, "query_id"), F.col("k"), "ordinal", most=most).select("query_id", "rank", "ordinal", "score")


def search_no_match(spark, d):
    queries = spark.createDataFrame([(1, 1 << 40, 1.0)], "query_id bigint, token_id bigint, weight float")
    scored = scoring.score(_index_postings(_t(spark, d, "index_docs")), scoring.query_terms(queries))
    return topk.top_k(scored, 10, "ordinal").select("query_id", "rank", "ordinal", "score")


def query_duplicate_tokens(spark, d):
    queries = spark.createDataFrame([(1, 5, 0.4), (1, 1, 0.9), (1, 3, 0.6), (1, 1, 0.2)], "query_id bigint, token_id bigint, weight float")
    scored = _dense_search(spark, d, queries)
    return topk.top_k(scored, 10, "vec_id").select("query_id", "rank", "vec_id", "score")


def partial_final_topk(spark, d):
    """Top 10 from the best 10 of each of eight parts: must equal ``dense_topk``."""
    scored = _dense_search(spark, d, _dense(spark, d).where("vec_id = 0")).withColumn("score", F.round("score", 6))
    from pyspark.sql import Window

    parts = Window.partitionBy("query_id", F.expr("pmod(vec_id, 8)")).orderBy(F.desc("score"), "vec_id")
    partial = scored.withColumn("r", F.row_number().over(parts)).where("r <= 10").drop("r")
    return topk.top_k(partial, 10, "vec_id").select("rank", "vec_id", "score")


def _lexical(spark, d):
    return vectors.postings_with_norm(LexicalEncoder().encode(_t(spark, d, "documents").select("doc_id", "text"), "text"), "doc_id")


def _text_queries(spark, d):
    asked = _t(spark, d, "search_queries").where("query_id % 100 = 0").select("query_id", F.col("query_text").alias("text"))
    return scoring.query_terms(LexicalEncoder.postings(asked, "query_id", "text"))


def text_topk_batch(spark, d):
    scored = scoring.score(_lexical(spark, d), _text_queries(spark, d), "doc_id")
    return topk.top_k(scored, 10).select("query_id", "rank", "doc_id", "score")


def text_topk_with_text(spark, d):
    best = topk.top_k(scoring.score(_lexical(spark, d), _text_queries(spark, d), "doc_id"), 3)
    return best.join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", "rank", "doc_id", "text")


def format_result(spark, d):
    best = dense_topk(spark, d).join(_t(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("id"), F.col("vec_id").cast("string"))
    return best.select("rank", display.format_score(F.col("score")).alias("score_text"), display.format_metadata(meta).alias("metadata_text"))


def encode_udf_topk(spark, d):
    class Lengths:
        def encode(self, texts):
            return [[float(t.lower().count(c)) for c in "etaoinshrdlu"] for t in texts]

    encoded = UdfEncoder(Lengths, "letters").encode(_t(spark, d, "documents").select("doc_id", "text"), "text")
    rows = vectors.postings_with_norm(encoded, "doc_id")
    queries = spark.createDataFrame([(0, 0, 3.0), (0, 1, 2.0), (0, 5, 1.0)], "query_id bigint, token_id bigint, weight float")
    return topk.top_k(scoring.score(rows, scoring.query_terms(queries), "doc_id"), 10).select("rank", "doc_id", "score")


# -- lookups, deletions, maintenance -----------------------------------------------------------


def get_doc(spark, d):
    wanted = _t(spark, d, "index_docs").where("ordinal = 7").select("doc_id")
    hits = _live(spark, d).join(F.broadcast(wanted), "doc_id", "left_semi")
    return hits.orderBy("ordinal").limit(1).select("ordinal", "doc_id", "text")


def get_batch(spark, d):
    """Documents of every query's results: null for missing ones, repeats allowed."""
    wanted = _t(spark, d, "search_queries").select(F.col("query_id").alias("pos"), F.concat(F.lit("doc_"), F.col("top_k").cast("string")).alias("made_up"))
    best = _t(spark, d, "search_results").select(F.col("query_id").alias("pos"), "doc_id").distinct()
    asked = best.union(wanted.select("pos", F.col("made_up").alias("doc_id")))
    first = _live(spark, d).groupBy("doc_id").agg(F.min("ordinal").alias("ordinal"))
    return asked.join(first, "doc_id", "left").select("pos", "doc_id", "ordinal")


def live_docs(spark, d):
    return _live(spark, d).select("ordinal", "doc_id")


def delete_count(spark, d):
    """Per tombstone whether it hides anything, and how many rows."""
    rows = _t(spark, d, "index_docs").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return _dead(spark, d).join(rows, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("hidden_rows"), F.col("n").isNotNull().alias("deleted"))


def compact_result(spark, d):
    return with_positions(_live(spark, d).orderBy("ordinal").select(F.col("ordinal").alias("old_ordinal"), "doc_id"), "new_ordinal")


def shard_assign_greedy(spark, d):
    sizes = _t(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return greedy_groups(sizes, SHARD_BYTES, "doc_id").withColumnRenamed("group_no", "shard_no")


def reshard_stats(spark, d):
    return shard_assign_greedy(spark, d).groupBy("shard_no").agg(F.count(F.lit(1)).alias("num_docs"), F.sum("n_bytes").alias("shard_bytes"))


def index_stats(spark, d):
    docs = _t(spark, d, "index_docs").select("ordinal", "doc_id", "text", "metadata", "token_ids", "segment_id")
    live = docs.select("ordinal", "doc_id", "segment_id", logical_bytes().alias("n_bytes")).join(_dead(spark, d).withColumn("gone", F.lit(1)), "doc_id", "left")
    return live.agg(
        F.sum(F.col("gone").isNull().cast("bigint")).alias("num_docs"),
        F.countDistinct("segment_id").alias("num_shards"),
        F.countDistinct(F.when(F.col("gone").isNotNull(), F.col("doc_id"))).alias("deleted_docs"),
        F.sum("n_bytes").alias("total_bytes"),
    )


def manifest_check(spark, d):
    """Segments listed once, with the rows they really hold beside the stale count."""
    listed = _t(spark, d, "index_segments").groupBy("segment_id").agg(F.max("num_docs").alias("listed_docs"))
    held = _t(spark, d, "index_docs").groupBy("segment_id").agg(F.count(F.lit(1)).alias("held_docs"))
    return listed.join(held, "segment_id", "full").select("segment_id", "listed_docs", F.coalesce("held_docs", F.lit(0)).cast("bigint").alias("held_docs"))


def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_id"))


def set_difference(spark, d):
    segments = _t(spark, d, "index_segments").select("segment_id").distinct()
    used = _t(spark, d, "search_results").select("segment_id").distinct()
    return used.join(segments, "segment_id", "left_anti")


# -- ingest ------------------------------------------------------------------------------------


def _parts(spark, d):
    return _t(spark, d, "part").withColumn("ordinal", F.col("p_partkey"))


def make_doc_id(spark, d):
    parts = _parts(spark, d)
    return parts.select("p_partkey", ingest.doc_id(parts, ["p_name", "p_brand", "missing"]).alias("doc_id"))


def make_text(spark, d):
    parts = _parts(spark, d)
    return parts.select("p_partkey", ingest.text_of(parts, ["p_name", "p_brand", "p_type", "p_size"], " | ").alias("text"))


def make_metadata(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", display.format_metadata(ingest.metadata_of(docs, ["lang", "source"])).alias("metadata_text"))


def ingest_limit(spark, d):
    return _t(spark, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "lang")


def resume_anti(spark, d):
    incoming = _t(spark, d, "incoming_docs").select("row_no", "doc_id")
    return incoming.join(_t(spark, d, "index_docs").select("doc_id"), "doc_id", "left_anti").select("row_no", "doc_id")


# -- the stored index --------------------------------------------------------------------------


def _stored(spark, d) -> SparseIndex:
    index = SparseIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 0.25)
    index.add_batch(_t(spark, d, "index_docs").orderBy("ordinal").where("doc_id is not null"))
    index.commit()
    return index


def store_roundtrip(spark, d):
    docs = _stored(spark, d).snapshot().live()
    return docs.select("ordinal", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.size("token_ids").cast("bigint").alias("nnz"))


def store_search(spark, d):
    """The stored index, with the tombstones applied as deletions, answers a batch of queries."""
    index = _stored(spark, d)
    index.delete_many(_dead(spark, d))
    queries = _query_vectors(spark, d, "query_id % 100 = 0")
    return index.retriever(spark, index.path).search_batch(queries, 10).select("query_id", "rank", "doc_id", "score")


def snapshot_isolation(spark, d):
    """Rows seen by a reader opened before the deletions, and by one opened after."""
    index = _stored(spark, d)
    before = index.snapshot()
    index.delete_many(_dead(spark, d))
    count = lambda s, name: s.live(with_text=False).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("reader"), "rows")
    return count(before, "before").union(count(index.snapshot(), "after"))


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, scan_docs, scan_docs_no_text, scan_tombstones, dense_sparsify, dense_sparsify_threshold, vector_nnz, vector_norm, stored_norm,
        dedupe_max_weight, sorted_vector, duplicate_tokens, lexical_postings, lexical_doc_norm, dense_topk_dot, dense_topk_batch, dense_positive_count,
        dense_pair_scores, vector_search, search_with_tombstones, search_own_k, search_no_match, query_duplicate_tokens, partial_final_topk,
        text_topk_batch, text_topk_with_text, format_result, encode_udf_topk, get_doc, get_batch, live_docs, delete_count, compact_result,
        shard_assign_greedy, reshard_stats, index_stats, manifest_check, content_hash, set_difference, make_doc_id, make_text, make_metadata,
        ingest_limit, resume_anti, store_roundtrip, store_search, snapshot_isolation,
    )
}

# -- SQL ---------------------------------------------------------------------------------------

_CUT = "CAST(0.001 AS FLOAT)"
_DENSE = f"""
dense AS (
  SELECT vec_id, i - 1 AS token_id, w AS weight FROM (
    SELECT vec_id, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS i FROM embeddings)
  WHERE w > {_CUT} AND NOT isnan(w)),
norms AS (SELECT vec_id, sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))) AS norm FROM dense GROUP BY vec_id)"""


def _dense_sql(where: str, metric: str = "cosine") -> str:
    value = "sum(CAST(d.weight AS DOUBLE) * CAST(q.weight AS DOUBLE))"
    if metric == "cosine":
        value += " / (any_value(n.norm) * any_value(m.norm))"
    return f"""{_DENSE},
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, {value} AS s
  FROM dense d JOIN dense q USING (token_id) JOIN norms n ON n.vec_id = d.vec_id JOIN norms m ON m.vec_id = q.vec_id
  WHERE q.vec_id {where} GROUP BY q.vec_id, d.vec_id HAVING s > 0),
ranked AS (SELECT query_id, vec_id, round(s, 6) AS score FROM scored),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM ranked)"""


_STORED = """
stored AS (
  SELECT ordinal, token_id, max(weight) AS weight FROM (
    SELECT ordinal, unnest(token_ids) AS token_id, unnest(weights) AS weight FROM {docs})
  WHERE token_id IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) GROUP BY ordinal, token_id),
norms AS (SELECT ordinal, sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))) AS norm FROM stored GROUP BY ordinal),
asked AS (
  SELECT query_id, token_id, max(weight) AS weight FROM (
    SELECT query_id, unnest(token_ids) AS token_id, unnest(weights) AS weight FROM search_queries WHERE query_id % 100 = 0)
  WHERE token_id IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) GROUP BY query_id, token_id),
qnorms AS (SELECT query_id, sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))) AS norm FROM asked GROUP BY query_id),
scored AS (
  SELECT q.query_id, s.ordinal, sum(CAST(s.weight AS DOUBLE) * CAST(q.weight AS DOUBLE)) / nullif(any_value(n.norm) * any_value(m.norm), 0) AS s
  FROM stored s JOIN asked q USING (token_id) JOIN norms n ON n.ordinal = s.ordinal JOIN qnorms m ON m.query_id = q.query_id
  GROUP BY q.query_id, s.ordinal HAVING s > 0),
ranked AS (SELECT query_id, ordinal, round(s, 6) AS score FROM scored),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS INT) AS rank FROM ranked)"""
_DEAD = "dead AS (SELECT DISTINCT trim(doc_id, ' ') AS doc_id FROM tombstones WHERE trim(doc_id, ' ') <> '')"
_LIVE = f"{_DEAD}, live AS (SELECT * FROM index_docs WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM dead))"


def _lexical_sql(name: str, table: str, key: str, text: str, where: str = "true") -> str:
    return f"""
{name}_terms AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {table} WHERE {where}),
{name}_counts AS (SELECT id, term, count(*) AS n FROM {name}_terms GROUP BY id, term),
{name} AS (
  SELECT id, CAST(('0x' || substr(md5(term), 1, 7)) AS BIGINT) % 30522 AS token_id, max(CAST(ln(1 + n) AS FLOAT)) AS weight
  FROM {name}_counts GROUP BY 1, 2)"""


_TEXT_BEST = f"""{_lexical_sql("d", "documents", "doc_id", "text")}, {_lexical_sql("q", "search_queries", "query_id", "query_text", "query_id % 100 = 0")},
dn AS (SELECT id, sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))) AS norm FROM d GROUP BY id),
qn AS (SELECT id, sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))) AS norm FROM q GROUP BY id),
scored AS (
  SELECT q.id AS query_id, d.id AS doc_id, sum(CAST(d.weight AS DOUBLE) * CAST(q.weight AS DOUBLE)) / (any_value(dn.norm) * any_value(qn.norm)) AS s
  FROM d JOIN q USING (token_id) JOIN dn ON dn.id = d.id JOIN qn ON qn.id = q.id GROUP BY q.id, d.id HAVING s > 0),
ranked AS (SELECT query_id, doc_id, round(s, 6) AS score FROM scored),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM ranked)"""

_GREEDY = f"""
n AS (SELECT doc_id, octet_length(encode(text)) AS n_bytes, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
walk AS (
  SELECT i, doc_id, n_bytes, CAST(0 AS BIGINT) AS shard_no, n_bytes AS filled FROM n WHERE i = 1
  UNION ALL
  SELECT n.i, n.doc_id, n.n_bytes, CASE WHEN w.filled >= {SHARD_BYTES} THEN w.shard_no + 1 ELSE w.shard_no END,
         CASE WHEN w.filled >= {SHARD_BYTES} THEN n.n_bytes ELSE w.filled + n.n_bytes END
  FROM walk w JOIN n ON n.i = w.i + 1)"""

ORACLES = {
    "scan_docs": "SELECT doc_id, text, lang, source FROM documents",
    "scan_docs_no_text": "SELECT doc_id, CAST(NULL AS VARCHAR) AS text, lang, source FROM documents",
    "scan_tombstones": f"WITH {_DEAD} SELECT doc_id FROM dead",
    "dense_sparsify": f"WITH {_DENSE} SELECT * FROM dense",
    "dense_sparsify_threshold": f"WITH {_DENSE.replace(_CUT, 'CAST(0.2 AS FLOAT)')} SELECT * FROM dense",
    "vector_nnz": f"WITH {_DENSE} SELECT e.vec_id, count(d.vec_id) AS nnz FROM embeddings e LEFT JOIN dense d ON d.vec_id = e.vec_id GROUP BY e.vec_id",
    "vector_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings",
    "stored_norm": f"""WITH {_STORED.format(docs="index_docs")}
SELECT i.ordinal, coalesce(any_value(s.n), 0) AS nnz, round(coalesce(any_value(n.norm), 0), 6) AS norm FROM index_docs i
LEFT JOIN norms n USING (ordinal) LEFT JOIN (SELECT ordinal, count(*) AS n FROM stored GROUP BY ordinal) s USING (ordinal) GROUP BY i.ordinal""",
    "dedupe_max_weight": f"WITH {_STORED.format(docs='index_docs')} SELECT ordinal, token_id, round(CAST(weight AS DOUBLE), 6) AS weight FROM stored",
    "sorted_vector": f"""WITH {_STORED.format(docs="index_docs")}
SELECT ordinal, token_id, row_number() OVER (PARTITION BY ordinal ORDER BY token_id) - 1 AS position FROM stored""",
    "duplicate_tokens": "SELECT ordinal FROM index_docs WHERE len(list_distinct(token_ids)) < len(token_ids)",
    "lexical_postings": f"WITH {_lexical_sql('d', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, token_id, round(CAST(weight AS DOUBLE), 5) AS weight FROM d",
    "lexical_doc_norm": f"""WITH {_lexical_sql("d", "documents", "doc_id", "text")}
SELECT t.doc_id, count(d.id) AS nnz, round(coalesce(sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))), 0), 5) AS norm
FROM documents t LEFT JOIN d ON d.id = t.doc_id GROUP BY t.doc_id""",
    "dense_topk": f"WITH {_dense_sql('= 0')} SELECT rank, vec_id, score FROM best WHERE rank <= 10",
    "dense_topk_dot": f"WITH {_dense_sql('= 0', 'dot')} SELECT rank, vec_id, score FROM best WHERE rank <= 10",
    "dense_topk_batch": f"WITH {_dense_sql('% 100 = 0')} SELECT query_id, rank, vec_id, score FROM best WHERE rank <= 10",
    "dense_positive_count": f"WITH {_dense_sql('% 100 = 0')} SELECT query_id, count(*) AS n_positive FROM scored GROUP BY query_id",
    "dense_pair_scores": f"""WITH {_DENSE}
SELECT a.vec_id, round(coalesce(sum(CAST(x.weight AS DOUBLE) * CAST(y.weight AS DOUBLE)), 0) / (any_value(n.norm) * any_value(m.norm)), 6) AS cosine,
       round(coalesce(sum(CAST(x.weight AS DOUBLE) * CAST(y.weight AS DOUBLE)), 0), 6) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN norms n ON n.vec_id = a.vec_id JOIN norms m ON m.vec_id = b.vec_id
LEFT JOIN dense x ON x.vec_id = a.vec_id LEFT JOIN dense y ON y.vec_id = b.vec_id AND y.token_id = x.token_id GROUP BY a.vec_id""",
    "vector_search": f"WITH {_STORED.format(docs='index_docs')} SELECT query_id, rank, ordinal, score FROM best WHERE rank <= 10",
    "search_with_tombstones": f"WITH {_LIVE}, {_STORED.format(docs='live')} SELECT query_id, rank, ordinal, score FROM best WHERE rank <= 10",
    "search_own_k": f"""WITH {_STORED.format(docs="index_docs")}
SELECT query_id, rank, ordinal, score FROM best JOIN search_queries USING (query_id) WHERE rank <= coalesce(top_k, 10)""",
    "search_no_match": "SELECT CAST(NULL AS BIGINT) AS query_id, CAST(NULL AS INT) AS rank, ordinal, CAST(NULL AS DOUBLE) AS score FROM index_docs WHERE ordinal IS NULL AND false",
    "query_duplicate_tokens": f"""WITH {_DENSE},
q AS (SELECT * FROM (VALUES (5, CAST(0.4 AS FLOAT)), (1, CAST(0.9 AS FLOAT)), (3, CAST(0.6 AS FLOAT))) v(token_id, weight)),
scored AS (
  SELECT d.vec_id, sum(CAST(d.weight AS DOUBLE) * CAST(q.weight AS DOUBLE))
    / (any_value(n.norm) * (SELECT sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE))) FROM q)) AS s
  FROM dense d JOIN q USING (token_id) JOIN norms n USING (vec_id) GROUP BY d.vec_id HAVING s > 0),
best AS (SELECT vec_id, round(s, 6) AS score FROM scored)
SELECT CAST(1 AS BIGINT) AS query_id, CAST(r AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM best) WHERE r <= 10""",
    "partial_final_topk": f"WITH {_dense_sql('= 0')} SELECT rank, vec_id, score FROM best WHERE rank <= 10",
    "text_topk_batch": f"WITH {_TEXT_BEST} SELECT query_id, rank, doc_id, score FROM best WHERE rank <= 10",
    "text_topk_with_text": f"WITH {_TEXT_BEST} SELECT query_id, rank, doc_id, text FROM best JOIN documents USING (doc_id) WHERE rank <= 3",
    "format_result": f"""WITH {_dense_sql("= 0")}
SELECT rank, printf('%.3f', score) AS score_text, 'id=' || vec_id || ', label=' || label AS metadata_text FROM best JOIN embeddings USING (vec_id) WHERE rank <= 10""",
    "get_doc": f"""WITH {_LIVE} SELECT ordinal, doc_id, text FROM live
WHERE doc_id = (SELECT doc_id FROM index_docs WHERE ordinal = 7) ORDER BY ordinal LIMIT 1""",
    "get_batch": f"""WITH {_LIVE},
asked AS (SELECT DISTINCT query_id AS pos, doc_id FROM search_results
  UNION ALL SELECT query_id, 'doc_' || top_k FROM search_queries),
first AS (SELECT doc_id, min(ordinal) AS ordinal FROM live GROUP BY doc_id)
SELECT pos, a.doc_id, f.ordinal FROM asked a LEFT JOIN first f ON f.doc_id = a.doc_id""",
    "live_docs": f"WITH {_LIVE} SELECT ordinal, doc_id FROM live",
    "delete_count": f"""WITH {_DEAD}
SELECT d.doc_id, count(i.ordinal) AS hidden_rows, count(i.ordinal) > 0 AS deleted FROM dead d LEFT JOIN index_docs i ON i.doc_id = d.doc_id GROUP BY d.doc_id""",
    "compact_result": f"WITH {_LIVE} SELECT ordinal AS old_ordinal, doc_id, row_number() OVER (ORDER BY ordinal) - 1 AS new_ordinal FROM live",
    "shard_assign_greedy": f"WITH RECURSIVE {_GREEDY} SELECT doc_id, n_bytes, shard_no FROM walk",
    "reshard_stats": f"WITH RECURSIVE {_GREEDY} SELECT shard_no, count(*) AS num_docs, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM walk GROUP BY shard_no",
    "index_stats": f"""WITH {_DEAD}
SELECT CAST(sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_docs, count(DISTINCT segment_id) AS num_shards,
       count(DISTINCT d.doc_id) AS deleted_docs,
       CAST(sum(4 + coalesce(octet_length(encode(i.doc_id)), 0) + coalesce(octet_length(encode(text)), 0) + 8 * coalesce(len(token_ids), 0)
         + coalesce(list_sum(list_transform(map_entries(metadata), lambda e: octet_length(encode(e.key)) + coalesce(octet_length(encode(e.value)), 0))), 0)) AS BIGINT) AS total_bytes
FROM index_docs i LEFT JOIN dead d ON d.doc_id = i.doc_id""",
    "manifest_check": """
WITH l AS (SELECT segment_id, max(num_docs) AS listed_docs FROM index_segments GROUP BY segment_id),
h AS (SELECT segment_id, count(*) AS held_docs FROM index_docs GROUP BY segment_id)
SELECT coalesce(l.segment_id, h.segment_id) AS segment_id, listed_docs, coalesce(held_docs, 0) AS held_docs FROM l FULL JOIN h ON l.segment_id = h.segment_id""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_id FROM documents",
    "set_difference": "SELECT segment_id FROM search_results EXCEPT SELECT segment_id FROM index_segments",
    "make_doc_id": """
SELECT p_partkey, 'doc_' || p_partkey || '_' || substr(sha256(coalesce(p_name, 'None') || coalesce(p_brand, 'None')), 1, 16) AS doc_id FROM part""",
    "make_text": """
SELECT p_partkey, concat_ws(' | ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''), CASE WHEN p_size <> 0 THEN CAST(p_size AS VARCHAR) END) AS text FROM part""",
    "make_metadata": """
SELECT doc_id, concat_ws(', ', 'lang=' || lang, 'source=' || source) AS metadata_text FROM documents""",
    "ingest_limit": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "resume_anti": "SELECT row_no, doc_id FROM incoming_docs i WHERE NOT EXISTS (SELECT 1 FROM index_docs d WHERE d.doc_id = i.doc_id)",
    "store_roundtrip": f"""WITH {_STORED.format(docs="index_docs")},
c AS (SELECT ordinal, count(*) AS nnz FROM stored GROUP BY ordinal)
SELECT i.ordinal, doc_id, sha256(coalesce(text, '')) AS text_hash, coalesce(nnz, 0) AS nnz FROM index_docs i LEFT JOIN c USING (ordinal)""",
    "store_search": f"""WITH {_LIVE}, {_STORED.format(docs="live")},
named AS (SELECT query_id, doc_id, ordinal, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS INT) AS rank
  FROM ranked JOIN index_docs USING (ordinal))
SELECT query_id, rank, doc_id, score FROM named WHERE rank <= 10""",
    "snapshot_isolation": f"""WITH {_LIVE}
SELECT 'before' AS reader, count(*) AS rows FROM index_docs UNION ALL SELECT 'after', count(*) FROM live""",
}
