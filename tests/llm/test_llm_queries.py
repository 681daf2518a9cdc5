from fractions import Fraction

import pytest

from termloom.llm import termweights
from termloom.llm.queries import ORACLES, QUERIES
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    compare(spark, data, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p7_found", "p8_fill", "p9_shares", "p10_found"])
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_entry_has_a_score(spark, data):
    entries = termweights.usable_entries(spark.read.parquet(f"{data}/index_docs.parquet"), "ordinal", "token_ids", "weights")
    scored = QUERIES["p1_log_entropy"](spark, data).collect()
    assert {(r.ordinal, r.token_id) for r in scored} == {(r.record, r.token_id) for r in entries.collect()}
    assert len(scored) > 10 * len({r.ordinal for r in scored})


def test_shares_of_a_whole_mixture_show_shortfalls(spark, data):
    rows = QUERIES["p9_whole_shares"](spark, data).collect()
    total = sum(r.available_tokens for r in rows)
    short = [r for r in rows if r.available_tokens and not r.reached]
    assert short and all(r.budget_tokens == r.available_tokens * r.max_repeats < int(r.target_share * total + 1e-6) for r in short)
    assert all(r.budget_tokens == int(Fraction(r.target_share).limit_denominator(10**12) * total) for r in rows if r.reached)
