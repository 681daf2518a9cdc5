import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import vectors
from termloom.functions.encoders import DenseEncoder, LexicalEncoder, UdfEncoder, model_id_of
from termloom.operators import scoring, topk


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, token_ids array<bigint>, weights array<float>")


def test_sparsify_is_strict_in_float32(spark):
    value = float(np.float32(0.001))
    df = spark.createDataFrame([(1, [0.0, value, 0.002, -1.0, float("nan"), None, 0.5])], "id int, v array<float>")
    found = df.select(vectors.sparsify(F.col("v")).alias("p")).first().p
    assert [(p.token_id, round(p.weight, 4)) for p in found] == [(2, 0.002), (6, 0.5)]
    exploded = vectors.sparsify_rows(df, "id", "v").collect()
    assert sorted(r.token_id for r in exploded) == [2, 6]


def test_normalise_sorts_and_keeps_the_largest(spark):
    df = _rows(spark, (1, [5, 1, 3, 1], [0.4, 0.2, 0.6, 0.9]), (2, [], []), (3, None, None), (4, [7], [0.5]), (5, [2, 2], [float("nan"), 0.1]))
    out = {r.id: r for r in vectors.normalised(df).collect()}
    assert out[1].token_ids == [1, 3, 5] and [round(w, 2) for w in out[1].weights] == [0.9, 0.6, 0.4]
    assert out[2].token_ids == [] and out[3].token_ids is None and out[4].token_ids == [7]
    assert out[5].token_ids == [2] and round(out[5].weights[0], 2) == 0.1


def test_normalise_without_deduplication_is_stable(spark):
    out = vectors.normalised(_rows(spark, (1, [3, 1, 3], [0.9, 0.5, 0.1])), deduplicate=False).first()
    assert out.token_ids == [1, 3, 3] and [round(w, 1) for w in out.weights] == [0.5, 0.9, 0.1]


def test_extract_kinds(spark):
    df = spark.createDataFrame([([1, 5, 10], [0.8, 0.5, 0.3])], "i array<bigint>, v array<double>")
    packed = df.select(F.struct(F.col("i").alias("indices"), F.col("v").alias("values")).alias("e"))
    assert vectors.extract_sparse(packed, "e").first().token_ids == [1, 5, 10]
    dense = spark.createDataFrame([([0.0, 0.5, 0.0, 0.0, 0.0, 0.6, 0.0, 0.0, 0.0, 0.7],)], "e array<double>")
    assert vectors.extract_sparse(dense, "e").first().token_ids == [1, 5, 9]
    matrix = spark.createDataFrame([([[0.0, 1.0], [1.0, 0.0]],)], "e array<array<double>>")
    assert DenseEncoder().encode(matrix, "e").first().token_ids == [1]
    with pytest.raises(ValueError):
        vectors.extract_sparse(spark.createDataFrame([("invalid",)], "e string"), "e")


def test_norm_and_postings_round_trip(spark):
    df = _rows(spark, (1, [1, 2], [3.0, 4.0]), (2, [9, 9, 8], [1.0, 2.0, 1.0]))
    norms = {r.id: r.n for r in df.select("id", vectors.norm(F.col("weights")).alias("n")).collect()}
    assert norms[1] == 5.0 and math.isclose(norms[2], math.sqrt(6))
    back = {r.id: r.token_ids for r in vectors.to_arrays(vectors.postings(df, "id"), "id").collect()}
    assert back == {1: [1, 2], 2: [8, 9]}
    assert [r.d for r in df.select(vectors.has_duplicates(F.col("token_ids")).alias("d")).collect()] == [False, True]


def test_lexical_encoder_agrees_with_its_postings(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT! 42"), (2, ""), (3, None), (4, "ünïcode ß")], "id int, text string")
    arrays = LexicalEncoder().encode(df, "text").select("id", F.explode(F.arrays_zip("token_ids", "weights")).alias("e"))
    a = {(r.id, r.e.token_ids, round(r.e.weights, 5)) for r in arrays.collect()}
    b = {(r.id, r.token_id, round(r.weight, 5)) for r in LexicalEncoder.postings(df, "id", "text").collect()}
    assert a == b and len({x for x in a if x[0] == 1}) == 3


def test_udf_encoder(spark):
    class Model:
        model_id = "lengths"

        def encode(self, texts):
            return [[float(len(t)), 0.0, 1.0] for t in texts]

    encoder = UdfEncoder(Model)
    out = encoder.encode(spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string"), "text").orderBy("id").collect()
    assert encoder.model_id == "lengths" and [r.token_ids for r in out] == [[0, 2], [2]]
    assert model_id_of(object()) == "unknown"


def _pair(spark, dt, dw, qt, qw, metric="cosine"):
    df = spark.createDataFrame([(dt, dw, qt, qw)], "dt array<bigint>, dw array<float>, qt array<bigint>, qw array<float>")
    return df.select(scoring.score_pair("dt", "dw", "qt", "qw", metric=metric).alias("s")).first().s


@pytest.mark.parametrize(
    ("d", "q", "dot", "cosine"),
    [
        ({1: 0.8, 5: 0.5, 10: 0.3}, {1: 0.9, 10: 0.6, 20: 0.4}, 0.90, 0.788322),
        ({1: 0.8, 5: 0.5, 10: 0.3}, {1: 0.8, 5: 0.5, 10: 0.3}, 0.98, 1.0),
        ({1: 0.8}, {2: 0.8}, 0.0, 0.0),
        ({}, {1: 1.0}, 0.0, 0.0),
        ({1: 1.0}, {}, 0.0, 0.0),
    ],
)
def test_pair_scores(spark, d, q, dot, cosine):
    args = list(d), list(d.values()), list(q), list(q.values())
    assert abs(_pair(spark, *args, metric="dot") - dot) < 1e-5 and abs(_pair(spark, *args) - cosine) < 1e-5


def test_scaling_keeps_the_cosine(spark):
    a, b = ([1, 2], [0.4, 0.4], [1, 2], [0.3, 0.9]), ([1, 2], [2.0, 2.0], [1, 2], [0.3, 0.9])
    assert abs(_pair(spark, *a) - _pair(spark, *b)) < 1e-6
    assert abs(_pair(spark, *a, metric="dot") - _pair(spark, *b, metric="dot")) > 0.1


def test_joined_scores_equal_pair_scores(spark):
    rng = np.random.default_rng(42)
    docs = [(i, sorted(rng.choice(300, 40, replace=False).tolist()), rng.random(40).astype(float).tolist()) for i in range(20)]
    df = _rows(spark, *docs)
    rows = scoring.with_norms(vectors.postings(df, "id"), "id")
    queries = vectors.postings(df.where("id < 3"), "id").withColumnRenamed("id", "query_id")
    found = {(r.query_id, r.id): r.score for r in scoring.score(rows, scoring.query_terms(queries), "id").collect()}
    for q in range(3):
        for i, t, w in docs:
            expected = _pair(spark, t, w, docs[q][1], docs[q][2]) if i == q + 1 else None
            if expected is not None:
                assert abs(found.get((q, i), 0.0) - expected) < 1e-9
    assert all(abs(found[q, q] - 1) < 1e-9 for q in range(3)) and all(0 < s <= 1 + 1e-9 for s in found.values())
    with pytest.raises(ValueError):
        scoring.score(rows, scoring.query_terms(queries), "id", metric="other")


def test_own_limits_with_ties_and_a_hot_query(spark):
    rng = np.random.default_rng(5)
    hits = [(int(q), f"d{i}", round(float(rng.integers(1, 9)) / 8 + 1e-9 * i, 10)) for i in range(60) for q in (1, 2, 3, 4)] + [(5, f"e{i}", 0.5) for i in range(3000)]
    limits = {1: 3, 2: 0, 3: None, 4: 100, 5: 7}
    scored = spark.createDataFrame(hits, "query_id bigint, doc_id string, score double").repartition(5)
    asked = scored.join(spark.createDataFrame(list(limits.items()), "query_id bigint, k int"), "query_id")
    best = topk.top_k(asked, F.col("k"), most=100)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in best.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.doc_id)
    expected = {q: [d for _, d in sorted((-round(s, 6), d) for p, d, s in hits if p == q)][: limits[q] or 0] for q in limits}
    assert found == {q: d for q, d in expected.items() if d}
    with pytest.raises(ValueError):
        topk.top_k(asked, F.col("k"))
