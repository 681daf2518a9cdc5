import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import termcounts, termweights, topn

SCHEMA = "ordinal bigint, token_ids array<bigint>, weights array<float>, record string, token_id string, score string"
NAN = float("nan")
ROWS = [
    (0, [5, 3, 5, 9], [0.5, 1.0, 2.0, 0.0], "x", "y", "z"),
    (1, [3], [1.0], None, None, None),
    (2, None, None, "", "", ""),
    (3, [], [], "", "", ""),
    (4, [3, 7, 7, None], [NAN, 0.25, NAN, 1.0], "", "", ""),
    (5, [3, 5], [float(np.float32(0.001)), 3.0], "", "", ""),
    (None, [5, 11], [1.0, 1.0], "", "", ""),
    (7, [8, 8, 2], [1.0], "", "", ""),
    (8, list(range(3000)) * 2, [1.0 + i for i in range(6000)], "", "", ""),
]


def _usable(rows):
    for o, tokens, weights, *_ in rows:
        best = {}
        for t, w in zip(tokens or [], weights or []):
            if t is not None and w is not None and not math.isnan(w) and np.float32(w) > np.float32(0.001):
                best[t] = max(best.get(t, 0), w)
        yield o, best


def test_log_entropy_against_brute_force(spark):
    rows = list(_usable(ROWS))
    n, by_term = len(ROWS), defaultdict(list)
    for _, best in rows:
        for t, w in best.items():
            by_term[t].append(w)
    expected = set()
    for o, best in rows:
        for t, w in best.items():
            total = sum(by_term[t])
            spread = 1 + sum(x / total * math.log(x / total) for x in by_term[t]) / math.log(n)
            expected.add((o, t, len(by_term[t]), round(math.log1p(w) * spread, 6)))
    for limit in (10**6, 0):  # broadcast, and joined
        found = termweights.log_entropy(spark.createDataFrame(ROWS, SCHEMA), broadcast_terms=limit).collect()
        assert {(r.record, r.token_id, r.records, round(r.score, 6)) for r in found} == expected and len(found) == len(expected)


def test_presence_spread_is_inverse_document_frequency(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = termweights.log_entropy(df, spread="presence", local="raw", normalised=False)
    counts = Counter(t for _, best in _usable(ROWS) for t in best)
    for r in found.collect():
        assert abs(r.score - r.weight * math.log(len(ROWS) / counts[r.token_id])) < 1e-9
    top = termweights.top_terms(found, 2).where("record = 0").orderBy("rank_no").collect()
    assert [r.token_id for r in top] == [5, 3] or top[0].score >= top[1].score


def test_top_terms_break_ties_by_token(spark):
    df = spark.createDataFrame([(1, [9, 4, 6], [1.0, 1.0, 1.0]), (2, [1], [1.0])], "ordinal bigint, token_ids array<bigint>, weights array<float>")
    top = termweights.top_terms(termweights.log_entropy(df), 2).where("record = 1").orderBy("rank_no").collect()
    assert [r.token_id for r in top] == [4, 6]
    one = termweights.log_entropy(df.limit(1)).collect()
    assert {round(r.score, 6) for r in one} == {round(math.log(2), 6)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert termweights.log_entropy(empty).collect() == [] and termcounts.term_frequencies(empty).collect() == []
    assert topn.top_n(spark.createDataFrame([], "query_id bigint, doc_id string, score double"), 3).collect() == []


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("flush", [2, 10**6])
def test_frequencies_against_brute_force(spark, parts, flush, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(t) for t in rng.zipf(1.5, rng.integers(0, 30)) if t < 50]) for i in range(200)]
    rows += [(500, None), (501, [None, 4, 4]), (None, [4, 60]), (502, [61]), (503, [61, 61]), (503, [62, 63, 64]), (504, [62]), (505, [62])]
    df = spark.createDataFrame(rows, "ordinal bigint, token_ids array<bigint>").repartition(parts)
    monkeypatch.setattr(termcounts, "FLUSH_TERMS", flush)
    found = {r.token_id: (r.occurrences, r.records, r.last_record, r.mark) for r in termcounts.term_frequencies(df).collect()}
    occurrences, records, last = Counter(), Counter(), {}
    for o, tokens in rows:
        own = [t for t in tokens or [] if t is not None]
        occurrences.update(own)
        records.update(set(own))
        for t in own:
            last[t] = o if last.get(t) is None else max(last[t], -1 if o is None else o)
    for t, n in records.items():
        mark = "rare" if n <= 2 else "common" if n * 100 > 15 * len(rows) else None
        assert found[t] == (occurrences[t], n, last[t], mark), t
    assert len(found) == len(records)


def test_last_seen_counter_spans_batches():
    state = termcounts.LastSeenCounters()
    one = lambda *x: np.array(x, dtype=np.int64)
    state.add(one(7, 7, 8), one(0, 0, 0), one(10, 10, 10))
    state.add(one(7, 9, 7), one(0, 1, 1), one(10, 11, 11))  # record 0 goes on
    state.add(one(), one(), one())
    assert state.terms.tolist() == [7, 8, 9] and state.occurrences.tolist() == [4, 1, 1] and state.records.tolist() == [2, 1, 1]
    assert state.last.tolist() == [11, 10, 11]


@pytest.mark.parametrize(("gather", "flush"), [(10**6, 10**6), (16, 10**6), (16, 8)])
def test_top_n_against_brute_force(spark, gather, flush, monkeypatch):
    monkeypatch.setattr(topn, "GATHER", gather)
    monkeypatch.setattr(topn, "FLUSH_ROWS", flush)
    rng = np.random.default_rng(5)
    rows = [(int(g), f"d{rng.integers(0, 40)}", float(rng.integers(0, 6)) / 4) for g in rng.choice([1, 2, 3], 900, p=[0.8, 0.1, 0.1])]
    rows += [(None, "d1", 1.0), (1, None, 9.0), (1, "d1", None), (1, "é", NAN), (4, "only", float("inf")), (4, "Z", 1.0), (4, "a", 1.0), (4, "é", 1.0)]
    df = spark.createDataFrame([(*r, "grp", "item") for r in rows], "query_id bigint, doc_id string, score double, grp string, item string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = {(r.query_id, r.rank_no): (r.doc_id, r.score) for r in topn.top_n(df, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(s, best[g].get(i, -math.inf))
    expected = {}
    for g, items in best.items():
        for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:4]):
            expected[g, k + 1] = (i, s)
    assert found == expected
    with pytest.raises(ValueError):
        topn.top_n(df, 0)
