"""termloom: a Spark-native sparse-retrieval and data-processing engine."""

from termloom.functions.vectors import extract_sparse
from termloom.operators.search import SparseRetriever
from termloom.schema import Document, SearchResult
from termloom.sources.store import SparseIndex

__all__ = ["Document", "SearchResult", "SparseIndex", "SparseRetriever", "extract_sparse"]
