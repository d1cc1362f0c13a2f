"""Scoring a stream of new documents with a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.clustering import predict_topics


def assign_topics(stream: DataFrame, topic_vectors: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ``(doc_id, topic, similarity)`` of a stream ``(doc_id, embedding)`` to a parquet table.

    The assignment keeps no state, so no watermark is needed.
    """
    scored = predict_topics(stream.select("doc_id", "embedding"), topic_vectors).select("doc_id", "topic", "similarity")
    writer = scored.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)
