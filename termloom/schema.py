"""Row types of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_IDS = T.ArrayType(T.LongType())
WEIGHTS = T.ArrayType(T.FloatType())
METADATA = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("token_ids", TOKEN_IDS),
        T.StructField("weights", WEIGHTS),
    ]
)
#: a stored document: its place in scan order, segment, L2 norm and logical size
STORED = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("segment_no", T.LongType()),
        *DOCUMENT.fields,
        T.StructField("norm", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)
POSTING = T.StructType(
    [
        T.StructField("token_id", T.LongType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("weight", T.FloatType()),
        T.StructField("norm", T.DoubleType()),
    ]
)
TOMBSTONE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("ordinal", T.LongType())])


@dataclass
class Document:
    doc_id: str
    text: str
    metadata: dict = field(default_factory=dict)
    token_ids: list = field(default_factory=list)
    weights: list = field(default_factory=list)

    def row(self) -> tuple:
        tokens, weights = [int(t) for t in self.token_ids], [float(w) for w in self.weights]
        if len(tokens) != len(weights):
            raise ValueError("token_ids and weights differ in length")
        # values become strings the way str() writes them, so True gives "True"
        return self.doc_id, self.text, {str(k): str(v) for k, v in (self.metadata or {}).items()}, tokens, weights


@dataclass
class SearchResult:
    doc_id: str
    score: float
    metadata: dict
    text: str | None = None


def metadata_string(value: Column, data_type: T.DataType) -> Column:
    """A metadata value as a string; booleans in capitals, as True and False."""
    text = value.cast("string")
    return F.initcap(text) if isinstance(data_type, T.BooleanType) else text


def logical_bytes() -> Column:
    """Size of a document: a length prefix, its strings, and eight bytes per vector entry."""
    pairs = F.aggregate(
        F.map_entries(F.coalesce("metadata", F.create_map().cast(METADATA))),
        F.lit(0).cast("bigint"),
        lambda acc, e: acc + F.coalesce(F.octet_length(e["key"]), F.lit(0)) + F.coalesce(F.octet_length(e["value"]), F.lit(0)),
    )
    strings = F.coalesce(F.octet_length("doc_id"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))
    return (F.lit(4) + strings + pairs + 8 * F.coalesce(F.greatest(F.size("token_ids"), F.lit(0)), F.lit(0))).cast("bigint")
