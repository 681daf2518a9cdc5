import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom import cli
from termloom.plans.lineage import cut, store
from termloom.plans.positions import greedy_groups, grouped, staged, with_positions
from termloom.sources import ingest
from termloom.sources.store import SparseIndex
from termloom.streaming.sink import index_stream, stream_documents


def test_positions_are_dense_and_in_order(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 = 0").repartitionByRange(5, "id")
    rows = with_positions(df, "p", 10).orderBy("id").collect()
    assert [r.p for r in rows] == list(range(10, 10 + len(rows)))
    assert with_positions(spark.createDataFrame([], "x int"), "p").collect() == []


def _greedy(sizes, target):
    out, group, filled = [], 0, 0
    for s in sizes:
        out.append(group)
        filled += s
        if filled >= target:
            group, filled = group + 1, 0
    return out


_SIZES = np.random.default_rng(1)


@pytest.mark.parametrize(
    ("sizes", "target"),
    [
        ([6, 6, 3, 3, 6, 20, 1, 1], 10), ([], 10), ([100], 10), ([0, 0, 0, 10, 0], 10), ([None, 7, 3, 0, 4], 7), ([5] * 300, 45),
        (list(_SIZES.integers(0, 9, 500)), 1), (list(_SIZES.integers(0, 9, 500)), 5000), (list(_SIZES.integers(0, 90, 400)), 300),
    ],
)
def test_greedy_groups(spark, sizes, target):
    df = spark.createDataFrame([(i, None if s is None else int(s)) for i, s in enumerate(sizes)], "ordinal bigint, n_bytes bigint")
    found = [r.group_no for r in greedy_groups(df.repartition(3), target).orderBy("ordinal").collect()]
    assert found == _greedy([s or 0 for s in sizes], target)


def test_rows_are_grouped_and_numbered_in_their_order(spark):
    sizes = list(np.random.default_rng(2).integers(0, 30, 400))
    rows = spark.range(0, 400, 1, 17).select("id", F.element_at(F.lit([int(s) for s in sizes]), F.col("id").cast("int") + 1).alias("n_bytes"))
    placed, n = grouped(staged(rows), 100, order="ordinal", start=7)
    assert n == 400 and sorted((r.id, r.ordinal - 7, r.group_no) for r in placed.collect()) == [(i, i, g) for i, g in enumerate(_greedy(sizes, 100))]
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        grouped(staged(rows), 0)


def test_store_and_cut(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert store(df).where("id = 3").first().x == 6 and cut(df).count() == 10


def test_ingest_expressions(spark):
    rows = [("a", "", 0, None, True), (None, "b", 5, "m", False)]
    df = with_positions(spark.createDataFrame(rows, "t string, u string, n int, m string, f boolean").coalesce(1))
    ids = [r.d for r in df.orderBy("ordinal").select(ingest.doc_id(df, ["t", "u"]).alias("d")).collect()]
    assert ids[0].startswith("doc_0_") and len(ids[0]) == 22 and ids[0] != ids[1]
    assert df.select(ingest.doc_id(df, ["t"], "n").alias("d")).orderBy("d").first().d == "0"
    texts = [r.t for r in df.orderBy("ordinal").select(ingest.text_of(df, ["t", "u", "n", "missing"], "|").alias("t")).collect()]
    assert texts == ["a", "b|5"]
    meta = [r.m for r in df.orderBy("ordinal").select(ingest.metadata_of(df, ["n", "m", "u", "f"]).alias("m")).collect()]
    assert meta == [{"n": "0", "u": "", "f": "True"}, {"n": "5", "m": "m", "u": "b", "f": "False"}]


def test_ingest_job_and_resume(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(json.dumps({"id": i, "text": f"word{i} common"}) for i in range(5)))
    config = f"""
# a job
dataset:
  format: json
  path: "{tmp_path}/in.json"
  subset: null
text_columns:
  - "text"
metadata_columns:
  - id
id_column: id
index:
  path: {tmp_path}/ix
  shard_size_mb: 32
"""
    (tmp_path / "job.yaml").write_text(config)
    assert ingest.parse_yaml(config)["index"]["shard_size_mb"] == 32
    job = ingest.DatasetIngest(spark, str(tmp_path / "job.yaml"))
    assert job.ingest(max_docs=3)["num_docs"] == 3 and job.ingest(resume=True)["num_docs"] == 5
    assert cli.ingest_main([str(tmp_path / "job.yaml"), "--resume"], spark) == 0
    with pytest.raises(ValueError):
        ingest.DatasetIngest(spark, {"dataset": {"format": "magic", "path": "x"}, "text_columns": []}).source()


def test_tombstones_from_text(spark, tmp_path):
    (tmp_path / "dead.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.doc_id for r in ingest.tombstones_from_text(spark, str(tmp_path / "dead.txt")).collect()) == ["a", "b"]


def test_stream_is_added_once(spark, tmp_path):
    schema = "doc_id string, text string, token_ids array<bigint>, weights array<float>"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "x", [1], [1.0]), ("b", "y", [2], [1.0])], schema).write.parquet(source)
    for _ in range(2):
        docs = stream_documents(spark, source, schema)
        index_stream(docs, str(tmp_path / "ix"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(SparseIndex(spark, str(tmp_path / "ix"))) == 2
    with pytest.raises(FileNotFoundError):
        stream_documents(spark, str(tmp_path / "none"), schema)


def test_console(spark, tmp_path, monkeypatch, capsys):
    path = str(tmp_path / "ix")
    assert cli.search_main([path], spark) == 1 and cli.reshard_main([path], spark) == 1
    with SparseIndex(spark, path) as index:
        index.add_encoded(spark.createDataFrame([("a", "red apple", {"k": "v"})], "doc_id string, text string, metadata map<string,string>"), cli.LexicalEncoder())
    said = []
    console = cli.Console(spark, path, write=said.append, embed=lambda texts: [[1.0, float(len(t))] for t in texts])
    console.run(["apple", "", ":help", ":STATS", ":topk 0", ":topk 3", ":mode memory", ":mode x", ":what", "nothing here", ":q", "apple"])
    assert "a " in said[0] and "k=v" in said[0] and "cosine" in said[0] and "num_docs" in said[2]
    assert said[3].startswith("usage") and console.top_k == 3 and console.mode == "memory" and "unknown" in said[7] and said[8] == "No results" and len(said) == 9
    assert cli.parse_command(":") == (None, []) and cli.parse_command("x") == (None, [])
    monkeypatch.setattr("sys.stdin", io.StringIO(":stats\n"))
    assert cli.search_main([path, "--top-k", "0"], spark) == 0 and cli.reshard_main([path, "--shard-size", "1"], spark) == 0
    assert "new_shards" in capsys.readouterr().out and cli.main(["nope"]) == 2
