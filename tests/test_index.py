import warnings

import pytest
from pyspark.sql import functions as F

from termloom import Document, SparseIndex, SparseRetriever
from termloom.functions.encoders import LexicalEncoder
from termloom.schema import DOCUMENT
from termloom.sources.files import Files

DOCS = [
    Document("ml_doc", "machine learning", {"topic": "AI"}, [1, 2, 3], [0.9, 0.7, 0.5]),
    Document("dl_doc", "deep learning", {"topic": "AI"}, [1, 4, 5], [0.8, 0.6, 0.4]),
    Document("python_doc", "python", {"topic": "Programming"}, [10, 11, 12], [0.7, 0.5, 0.3]),
]


@pytest.fixture(scope="module")
def populated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "ix")
    with SparseIndex(spark, path) as index:
        index.add(DOCS[0])
        index.add_batch(DOCS[1:])
    return path


@pytest.fixture(scope="module")
def reader(spark, populated):
    return SparseRetriever(spark, populated)


def _scores(results):
    return [(r.doc_id, round(r.score, 6)) for r in results]


@pytest.mark.parametrize(
    ("tokens", "weights", "k", "expected"),
    [
        ([1, 2], [1, 0.5], 10, [("ml_doc", 0.898027), ("dl_doc", 0.664364)]),
        ([999, 1000], [1, 1], 10, []),
        ([1, 4, 10], [1, 1, 1], 2, [("dl_doc", 0.750479), ("python_doc", 0.443607)]),
        ([1, 2, 3], [1, 0.8, 0.6], 10, [("ml_doc", 0.999613), ("dl_doc", 0.525226)]),
        ([1, 1, 2], [0.5, 0.8, 0.3], 10, [("ml_doc", 0.87429), ("dl_doc", 0.695488)]),
        ([5, 1, 3], [0.4, 0.9, 0.6], 10, [("ml_doc", 0.773092), ("dl_doc", 0.70848)]),
    ],
)
def test_golden_rankings(reader, tokens, weights, k, expected):
    assert _scores(reader.search(tokens, weights, top_k=k)) == expected


def test_text_flag_memory_mode_and_metadata(spark, populated, reader):
    plain, full = reader.search([1], [1.0]), reader.search([1], [1.0], return_text=True, num_workers=4)
    assert [r.text for r in plain] == [None, None] and full[0].text == "deep learning"
    memory = SparseRetriever(spark, populated, "memory")
    assert _scores(memory.search([1], [1.0])) == _scores(plain) and memory.search([1], [1.0])[0].text is None
    assert plain[0].metadata == {"topic": "AI"}
    memory.close()


def test_bad_arguments(spark, reader, tmp_path):
    with pytest.raises(ValueError):
        reader.search([1], [1.0], top_k=0)
    with pytest.raises(ValueError):
        reader.search([1, 2], [1.0])
    with pytest.raises(FileNotFoundError):
        SparseRetriever(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        SparseRetriever(spark, reader.path, "other")
    with pytest.raises(ValueError):
        Document("x", "", {}, [1], []).row()


def test_lookups(reader):
    assert reader.get("ml_doc")["token_ids"] == [1, 2, 3] and reader.get("nope") is None
    found = reader.get_batch(["ml_doc", "python_doc", "nope", "ml_doc"])
    assert [f and f["doc_id"] for f in found] == ["ml_doc", "python_doc", None, "ml_doc"] and reader.get_batch([]) == []


def test_batch_search_equals_single(spark, reader):
    rows = [(1, 1, 1.0), (1, 2, 0.5), (2, 10, 1.0), (3, 999, 1.0)]
    found = reader.search_batch(spark.createDataFrame(rows, "query_id bigint, token_id bigint, weight float"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == [(1, 1, "ml_doc"), (1, 2, "dl_doc"), (2, 1, "python_doc")]


def test_delete_snapshot_readd_compact_reshard(spark, tmp_path):
    path = str(tmp_path / "ix")
    index = SparseIndex(spark, path, shard_size_mb=0.001)
    index.add_batch([Document(f"doc_{i}", "t" * 300, {"num": i}, [i, i + 1], [0.8, 0.6]) for i in range(10)])
    assert len(index) == 0  # not visible before the commit
    index.commit()
    assert len(index) == 10 and index.manifest["num_shards"] > 1
    assert all(len(h) == 64 for h in index.manifest["shard_hashes"])
    before = SparseRetriever(spark, path)
    assert index.delete("doc_0") and not index.delete("doc_0") and not index.delete("unknown")
    assert index.delete_many(spark.createDataFrame([(f"doc_{i}",) for i in (1, 2, 77)], "doc_id string")) == 2
    assert len(index) == 7 and index.stats()["deleted_docs"] == 3
    assert before.get("doc_0") is not None and SparseRetriever(spark, path).get("doc_0") is None
    index.add(Document("doc_0", "back", {}, [0], [0.5]))
    index.commit()
    assert SparseRetriever(spark, path).get("doc_0")["text"] == "back"
    answers = _scores(SparseRetriever(spark, path).search([3, 4], [1.0, 0.5]))
    index.compact()
    assert index.stats()["deleted_docs"] == 0 and len(index) == 8 and not index.manifest["tombstones"]
    kept = index.manifest["commit"]
    done = index.reshard(32, keep_originals=True)
    assert done["docs_written"] == 8 and done["new_shards"] == 1 < done["old_shards"]
    assert index.at(kept).live().count() == 8
    fresh = SparseRetriever(spark, path)
    assert _scores(fresh.search([3, 4], [1.0, 0.5])) == answers and fresh.get("doc_5")["metadata"] == {"num": "5"}
    assert SparseIndex(spark, path).manifest["shard_size_mb"] == 32


def test_equal_content_is_one_segment(spark, tmp_path):
    index = SparseIndex(spark, str(tmp_path / "ix"))
    for _ in range(2):
        index.add_batch(DOCS)
        index.commit()
    assert index.manifest["num_shards"] == 1 and len(index) == 3


def test_equal_scores_and_duplicates(spark, tmp_path):
    with SparseIndex(spark, str(tmp_path / "ix")) as index:
        index.add_batch([Document(f"d{i % 7}", str(i), {}, [3, 1, 2], [0.5, 0.5, 0.5]) for i in range(10)])
    found = SparseRetriever(spark, index.path).search([1], [1.0], top_k=5)
    assert [r.doc_id for r in found] == ["d0", "d0", "d1", "d1", "d2"] and len({r.score for r in found}) == 1


def test_empty_index(spark, tmp_path):
    index = SparseIndex(spark, str(tmp_path / "ix"))
    index.commit()
    assert SparseRetriever(spark, index.path).search([1], [1.0]) == [] and index.stats()["num_docs"] == 0
    with pytest.raises(ValueError, match="No shards"):
        index.reshard()


def test_texts_and_model_warning(spark, tmp_path):
    with SparseIndex(spark, str(tmp_path / "ix")) as index:
        index.add_texts(["a", "b"], ["red apple pie", "green pear"], [{"n": 1, "ok": True}, {}], LexicalEncoder())
        index.add_text("c", "", None, LexicalEncoder())
        with pytest.raises(ValueError):
            index.add_texts(["a"], [], [], LexicalEncoder())
    reader = SparseRetriever(spark, index.path)
    assert [r.doc_id for r in reader.search_text("apple", LexicalEncoder())] == ["a"] and reader.get("a")["metadata"] == {"n": "1", "ok": "True"}
    other = LexicalEncoder()
    other.model_id = "other"
    with pytest.warns(UserWarning, match="built with"):
        reader.search_text("apple", other)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        other.model_id = "unknown"
        reader.search_text("apple", other)


def test_missing_parts_warn_or_raise(spark, tmp_path):
    with SparseIndex(spark, str(tmp_path / "ix")) as index:
        index.add_batch(DOCS)
    files = Files(spark)
    files.delete(f"{index.path}/docs/generation={index.manifest['generations'][0]}")
    with pytest.warns(UserWarning, match="missing part"):
        assert index.snapshot().documents().count() == 0
    with pytest.raises(FileNotFoundError):
        index.snapshot().documents(strict=True)


def test_segments_follow_the_greedy_rule_however_rows_are_spread(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "x" * (1 + 37 * i % 300), {}, [i], [1.0]) for i in range(60)], DOCUMENT).coalesce(1)
    segments = []
    for parts in (1, 9):
        with SparseIndex(spark, str(tmp_path / f"ix{parts}"), shard_size_mb=0.0005) as index:
            index.add_batch(docs.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, "n").sortWithinPartitions("n"))
        segments.append([(s["segment_id"], s["num_docs"]) for s in index.manifest["segments"]])
    assert segments[0] == segments[1] and len(segments[0]) > 3
