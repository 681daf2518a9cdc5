import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from termloom.queries import ORACLES, QUERIES


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 8)
    return x


def compare(spark, data, name, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    df = query(spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    result = con.execute(sql)
    labels = [c[0] for c in result.description]
    assert sorted(labels) == columns, name
    at = [labels.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr), name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    compare(spark, data, name, QUERIES[name], ORACLES[name])


def test_entry_points(spark, data):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert QUERIES["encode_udf_topk"](spark, data).count() == 10
    top = [tuple(r) for r in QUERIES["dense_topk"](spark, data).collect()]
    assert top == [tuple(r) for r in QUERIES["partial_final_topk"](spark, data).collect()] and top[0] == (1, 0, 1.0)


def test_batch_of_lookups_asks_for_every_result(spark, data):
    asked = {(r.pos, r.doc_id) for r in QUERIES["get_batch"](spark, data).collect()}
    results = {(r.query_id, r.doc_id) for r in spark.read.parquet(f"{data}/search_results.parquet").collect()}
    assert results <= asked and len({pos for pos, _ in results}) > 1 and sum(pos == 7 for pos, _ in results) > 10
