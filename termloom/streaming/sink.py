"""Adding a stream of documents to an index, one commit per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from termloom.functions.encoders import Encoder
from termloom.sources.files import Files
from termloom.sources.store import SparseIndex


def index_stream(docs: DataFrame, path: str, checkpoint: str, encoder: Encoder | None = None, shard_size_mb: float | None = None) -> DataStreamWriter:
    """A writer (call ``start``) that adds (doc_id, text, metadata[, token_ids, weights]).

    With ``encoder`` the text is encoded in the batch.  A batch that was committed before a
    failure is recognised by its number in the manifest and is not added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = SparseIndex(spark, path, shard_size_mb)
        if index.manifest.get("stream_batch", -1) >= number:
            return
        index.manifest["stream_batch"] = number  # published together with the segments
        if encoder is None:
            index.add_batch(batch)
        else:
            index.add_encoded(batch, encoder)
        index.commit()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")


def stream_documents(spark, path: str, schema, file_format: str = "parquet") -> DataFrame:
    """Documents that arrive as files under ``path``."""
    if not Files(spark).exists(path):
        raise FileNotFoundError(path)
    return spark.readStream.schema(schema).format(file_format).load(path)
